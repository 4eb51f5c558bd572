"""Fixed values of the domain: tiers, weights, thresholds."""

from __future__ import annotations

# Rarity tiers from most common to rarest; the rank of a tier is its place over 13.
RARITY_ORDER = [
    "Common", "Uncommon", "Rare", "Double Rare", "ACE SPEC Rare", "Ultra Rare", "MEGA_ATTACK_RARE", "Shiny Rare", "Illustration Rare",
    "Shiny Ultra Rare", "Special Illustration Rare", "Hyper Rare", "Mega Hyper Rare", "Black White Rare",
]
NEUTRAL_RANK = 0.5

# Weight of a chase tier; others have none.
CHASE_WEIGHTS = {
    "Ultra Rare": 1.0, "Shiny Rare": 1.2, "Illustration Rare": 1.4, "Shiny Ultra Rare": 1.6, "Special Illustration Rare": 2.0,
    "MEGA_ATTACK_RARE": 2.2, "Hyper Rare": 2.5, "Mega Hyper Rare": 3.0,
}

# Probability of a tier per pack; overrides by set are an input table.
TIER_RATES = {
    "Common": 1.0, "Uncommon": 1.0, "Rare": 1.0, "Double Rare": 0.135, "ACE SPEC Rare": 0.083, "Ultra Rare": 0.065, "Illustration Rare": 0.075,
    "Special Illustration Rare": 0.0118, "Hyper Rare": 0.0185, "Shiny Rare": 0.0, "Shiny Ultra Rare": 0.0, "Black White Rare": 0.0,
    "MEGA_ATTACK_RARE": 0.06, "Mega Hyper Rare": 0.005, "Unknown": 0.05,
}
DEFAULT_RATE = 0.05

# Price variants in order of preference.
VARIANTS = ["holofoil", "reverseHolofoil", "normal", "1stEditionHolofoil", "unlimitedHolofoil"]

# Trailing tokens that name a mechanic and not a character.
MECHANICS = ["ex", "EX", "V", "VMAX", "VSTAR", "GX", "BREAK", "LV.X", "δ", "Prime", "Star"]

# Weights and thresholds of the scores, gates and labels.
SCARCITY_WEIGHTS, SCARCITY_MONTHS = (0.7, 0.3), 60.0
PREMIUM_WEIGHTS = (0.35, 0.30, 0.35)
PRIOR_FLOOR, SINGLE_SOURCE_CAP = 6.0, 8.3
OLD_DEX, OLD_BONUS, OLD_CAP = (1, 151), 0.75, 9.5
IQ_WEIGHTS = {"scarcity": 0.40, "char_premium": 0.35, "set_rank": 0.25}
DAYS_PER_MONTH = 30.4375
FRESH_DAYS, DEAD_ZONE, CHASE_MULTIPLE = 35, (20.0, 100.0), 1.75
BOARD_FLOOR, BOARD_SIZE = 2.0, 50
SWEEP_FLOOR, SWEEP_SIZE = 2.0, 850
VERDICT_BAND = 0.15
MIN_CLUSTER, RIDGE_ALPHA = 12, 1.0
SHORT_ROWS, LONG_ROWS = 7, 30
PRICE_WINDOW_DAYS, PRICE_UP, PRICE_DOWN = 7, 3.0, -3.0
DEMAND_HOT, SATURATION_LOW, SATURATION_HIGH = 15.0, 0.97, 1.03
PRICE_BAND, BAND_ANCHOR = (0.5, 4.0), 2.0
REVIEW_PRICE, REVIEW_SIZE, REVIEW_GAP = 20.0, 18, 1.5
HORIZONS, TOLERANCE_DAYS, PANEL_STEP_DAYS = (7, 28, 56, 84), 6, 7
MATURE_DAYS, MATURE_PRICE = 90, 10.0
FEATURES = ["char_premium", "scarcity", "months_since_release"]

# Texts of gates, buckets, labels and panels.
REASON_MID, REASON_CHASE = "mature mid-price — model near-efficient here", "chase premium the model can't price"
AGE_BUCKETS = ("0-35d (fresh)", "36-90d", "91-180d", "180d+ (mature)")
TRAJECTORIES = ("Falling", "Cooling after run", "Accelerating ↑", "Steady ↑", "Flat / digesting", "Choppy")
SHIPPING = ("+ ship not listed", "%s + %s ship", "free ship")
DASH = "—"
FLOW_CELLS = ("active listings", "new (7d)", "sold est (7d)")
POPULATION_CELLS = ("graded total", "PSA 10", "gem rate")
SLIDER = ("▲ raises", "▼ lowers", "· neutral", "No price effect in this cluster (flat in the model).")
BANNER, REFRESH = ("Prices refreshed", "Site built", "no date published"), " · refresh recommended"

# Names of products that mark another printing of a card.
OTHER_PRINTINGS = ("poke ball pattern", "master ball pattern", "pattern", "metal card", "jumbo", "oversized", "staff", "promo")

# Cards whose source has the wrong tier.
TIER_CORRECTIONS = {"zsv10pt5-171": "Black White Rare"}

# Variants of the second price source in order of preference, and its rate from EUR to USD.
SECOND_VARIANTS, EUR_USD = ("holofoil", "reverse-holofoil", "normal", "first-edition-holofoil"), 1.08

# Subtypes in order of preference where a card's own has no price.
SUBTYPES = ("Holofoil", "Normal", "Reverse Holofoil", "1st Edition Holofoil", "Unlimited Holofoil")

# Listings of a tier in made-up histories.
TIER_SUPPLY = {
    "Common": 320, "Uncommon": 240, "Rare": 150, "ACE SPEC Rare": 70, "Double Rare": 90, "Ultra Rare": 55, "Illustration Rare": 60,
    "Special Illustration Rare": 28, "Shiny Rare": 45, "Shiny Ultra Rare": 22, "Hyper Rare": 18, "MEGA_ATTACK_RARE": 16, "Mega Hyper Rare": 10,
    "Unknown": 80,
}

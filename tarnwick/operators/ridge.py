"""A ridge price model per cluster as one grouped aggregation.

With z-scored features and an unpenalised intercept the normal equations split: the intercept is the mean of y and the
coefficients solve (n C + alpha I) b = n g, with C the features' correlations and g their covariances with y over their
spreads.  All of that is means, population spreads and covariances of the group, which Spark combines partially.  The
solve is unrolled elimination on columns: the matrix is symmetric positive definite for alpha > 0, so no pivoting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick import constants as C

SEPARATOR = " · "


def cluster_key(supertype: Column, rarity: Column) -> Column:
    # Tiers that are modelled under another name.
    alias = F.when(rarity == "MEGA_ATTACK_RARE", "Hyper Rare").when(rarity == "Mega Hyper Rare", "Special Illustration Rare").otherwise(rarity)
    return F.concat_ws(SEPARATOR, F.coalesce(supertype, F.lit("Pokémon")), F.coalesce(alias, F.lit("Unknown")))


def solve(matrix: list[list[Column]], right: list[Column]) -> list[Column]:
    """The solution of a small symmetric positive definite system of columns."""
    k = len(right)
    a, b = [row[:] for row in matrix], right[:]
    for i in range(k):
        for r in range(i + 1, k):
            factor = F.try_divide(a[r][i], a[i][i])
            a[r] = [a[r][c] - factor * a[i][c] if c > i else a[r][c] for c in range(k)]
            b[r] = b[r] - factor * b[i]
    x: list[Column] = [F.lit(0.0)] * k
    for i in reversed(range(k)):
        x[i] = F.try_divide(b[i] - sum((a[i][c] * x[c] for c in range(i + 1, k)), F.lit(0.0)), a[i][i])
    return x


def fit(rows: DataFrame, keys: list[str], y: str, features: list[str], alpha: float = C.RIDGE_ALPHA) -> DataFrame:
    """Rows (keys, n, intercept, mean_<f>, std_<f>, coef_<f> ..); missing features count as 0, y must not be null."""
    filled = rows.where(F.col(y).isNotNull()).select(*keys, F.col(y), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("intercept")]
    for i, f in enumerate(features):
        aggs += [F.avg(f).alias(f"mean_{f}"), F.stddev_pop(f).alias(f"__s{i}"), F.covar_pop(f, y).alias(f"__y{i}")]
        aggs += [F.covar_pop(f, g).alias(f"__c{i}_{j}") for j, g in enumerate(features) if j > i]
    moments = filled.groupBy(*keys).agg(*aggs)
    k = len(features)
    std = {f"std_{f}": F.when(F.col(f"__s{i}") < 1e-12, F.lit(1.0)).otherwise(F.col(f"__s{i}")) for i, f in enumerate(features)}
    made = moments.withColumns(std)
    s, n = [F.col(f"std_{f}") for f in features], F.col("n").cast("double")
    varies = [F.col(f"__s{i}") >= 1e-12 for i in range(k)]

    def entry(i: int, j: int) -> Column:
        if i == j:
            return n * F.when(varies[i], F.lit(1.0)).otherwise(F.lit(0.0)) + F.lit(float(alpha))
        low, high = min(i, j), max(i, j)
        return n * F.when(varies[i] & varies[j], F.col(f"__c{low}_{high}") / (s[i] * s[j])).otherwise(F.lit(0.0))

    named = {f"__m{i}_{j}": entry(i, j) for i in range(k) for j in range(k)} | {f"__r{i}": n * F.when(varies[i], F.col(f"__y{i}") / s[i]).otherwise(F.lit(0.0)) for i in range(k)}
    made = made.withColumns(named)
    solved = solve([[F.col(f"__m{i}_{j}") for j in range(k)] for i in range(k)], [F.col(f"__r{i}") for i in range(k)])
    columns = [F.col(f"{p}_{f}") for f in features for p in ("mean", "std")] + [c.alias(f"coef_{f}") for c, f in zip(solved, features)]
    return made.select(*keys, "n", "intercept", *columns)


def fit_clusters(cards: DataFrame, by: list[str], features: list[str] = C.FEATURES, alpha: float = C.RIDGE_ALPHA) -> tuple[DataFrame, DataFrame]:
    """The models of clusters and the global ones (a row for each value of ``by``), on cards with a positive price."""
    priced = cards.where("market_price > 0").withColumn("__y", F.ln("market_price"))
    return fit(priced, [*by, "cluster"], "__y", features, alpha), fit(priced, by, "__y", features, alpha)


def score(cards: DataFrame, models: tuple[DataFrame, DataFrame], by: list[str], features: list[str] = C.FEATURES, least: int = C.MIN_CLUSTER) -> DataFrame:
    """``cards`` plus ``expected_price, residual, contributions, model_n``; clusters under ``least`` use the global model.

    Unpriced cards are scored as well, without a residual.  Models are a few rows per date; AQE broadcasts them.
    """
    own, whole = models
    parts = ["n", "intercept", *[f"{p}_{f}" for f in features for p in ("mean", "std", "coef")]]
    own = own.where(F.col("n") >= least).select(*by, "cluster", *[F.col(p).alias(f"__own_{p}") for p in parts])
    whole = whole.select(*by, *[F.col(p).alias(f"__all_{p}") for p in parts])
    joined = cards.join(own, [*by, "cluster"], "left")
    joined = joined.join(whole, by, "left") if by else joined.join(F.broadcast(whole), how="left")  # one row
    pick = lambda p: F.when(F.col("__own_n").isNotNull(), F.col(f"__own_{p}")).otherwise(F.col(f"__all_{p}"))
    z = {f: (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - pick(f"mean_{f}")) / pick(f"std_{f}") * pick(f"coef_{f}") for f in features}
    joined = joined.withColumns({f"__z_{f}": z[f] for f in features} | {"model_n": pick("n")})
    expected = F.exp(pick("intercept") + sum((F.col(f"__z_{f}") for f in features), F.lit(0.0)))
    joined = joined.withColumn("expected_price", expected)
    joined = joined.withColumn("residual", F.try_divide(F.col("market_price") - F.col("expected_price"), "expected_price"))
    contributions = F.create_map(*[x for f in features for x in (F.lit(f), F.round(f"__z_{f}", 6))])
    joined = joined.withColumn("contributions", contributions)
    return joined.drop(*[c for c in joined.columns if c.startswith("__")])


def model_sizes(cards: DataFrame, models: tuple[DataFrame, DataFrame], small: int = 30, least: int = C.MIN_CLUSTER) -> DataFrame:
    """Rows (card_id, n, small): the cards behind a card's model, and whether that calls for a note."""
    own, whole = models
    used = own.where(F.col("n") >= least).select("cluster", F.col("n").alias("__own"))
    rows = cards.join(used, "cluster", "left").crossJoin(F.broadcast(whole.select(F.col("n").alias("__all"))))  # one row
    return rows.select("card_id", F.coalesce("__own", "__all").alias("n"), (F.coalesce("__own", "__all") < small).alias("small"))


def rescore(model: dict[str, Column], values: dict[str, Column]) -> Column:
    """The client's price for changed features: a missing one is skipped, not read as 0."""
    total = model["intercept"]
    for f, x in values.items():
        term = model[f"coef_{f}"] * (x - model[f"mean_{f}"]) / model[f"std_{f}"]
        total = total + F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(term)
    return F.exp(total)


def export(own: DataFrame, whole: DataFrame, features: list[str] = C.FEATURES, digits: int | None = 6) -> DataFrame:
    """One row per model with arrays, the global one under the name ``global``; values to so many digits (None: as they are)."""
    shown = lambda c: F.col(c) if digits is None else F.round(c, digits)
    arrays = lambda p: F.array(*[shown(f"{p}_{f}") for f in features])
    shape = lambda df, name: df.select(name.alias("cluster"), "n", shown("intercept").alias("intercept"), *[arrays(p).alias(f"{p}s") for p in ("mean", "std", "coef")])
    return shape(own, F.col("cluster")).unionByName(shape(whole, F.lit("global")))

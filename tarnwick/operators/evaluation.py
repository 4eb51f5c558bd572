"""Many feature lists evaluated in one walk-forward run.

All lists share one aggregation.  For each date and cluster, and for each date as a whole, the means and covariances of
all features that any list names, and of the log price, are one row: a Gram matrix from which every list's normal
equations are a sub-matrix.  They are solved by Cholesky's method for any number of features and any penalty.  A card's
features are made once, meet their models once, and are scored under every list there.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick import constants as C
from tarnwick.functions import stats
from tarnwick.lineage import cut
from tarnwick.operators import asof, backtest, features, ridge
from tarnwick.shipping import ship

#: A feature list and its penalty.
Lists = Mapping[str, tuple[Sequence[str], float]]
MODELS = "array<struct<list:string,base:double,weights:array<double>>>"


def gram(rows: DataFrame, keys: list[str], y: str, names: list[str]) -> DataFrame:
    """Rows (keys, n, means, cov): means of the features and ``y``, and their covariances as a matrix row by row.

    Missing features count as 0.  Each pair is aggregated once, with partial results.
    """
    columns = [*names, y]
    filled = rows.where(F.col(y).isNotNull()).select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    pairs = {(i, j): f"__c{i}_{j}" for i in range(len(columns)) for j in range(i, len(columns))}
    made = filled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(name) for (i, j), name in pairs.items()]
    )
    cov = F.array(*[F.col(pairs[min(i, j), max(i, j)]) for i in range(len(columns)) for j in range(len(columns))])
    return made.select(*keys, "n", F.array(*[F.col(f"__m{i}") for i in range(len(columns))]).alias("means"), cov.alias("cov"))


def solve(n: float, means: np.ndarray, cov: np.ndarray, own: Sequence[int], alpha: float) -> tuple[float, np.ndarray]:
    """(base, weights of all features) of the ridge model on the features ``own``, y being the last row and column.

    Features are scaled to their spread; one that does not vary has no weight.
    """
    k = len(means) - 1
    weights, own = np.zeros(k), np.asarray(own, int)
    spread = np.sqrt(np.maximum(np.diag(cov)[own], 0.0))
    varies = spread >= 1e-12
    used, spread = own[varies], spread[varies]
    if len(used):
        inner = n * cov[np.ix_(used, used)] / np.outer(spread, spread)
        inner[np.diag_indices(len(used))] = n + alpha
        lower = np.linalg.cholesky(inner)
        right = n * cov[used, k] / spread
        weights[used] = np.linalg.solve(lower.T, np.linalg.solve(lower, right)) / spread
    return float(means[k] - weights @ means[:k]), weights


def models(moments: DataFrame, keys: list[str], names: list[str], lists: Lists) -> DataFrame:
    """Rows (keys, n, models): under every list, the base and the weights of the unscaled features."""
    at = {name: i for i, name in enumerate(names)}
    wanted = [(label, [at[f] for f in own], float(alpha)) for label, (own, alpha) in lists.items()]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for n, means, cov in zip(batch["n"], batch["means"], batch["cov"]):
                means, cov = np.array(means, float), np.array(cov, float).reshape(len(names) + 1, -1)
                solved = [(label, *solve(n, means, cov, own, alpha)) for label, own, alpha in wanted]
                made.append([{"list": label, "base": base, "weights": weights.tolist()} for label, base, weights in solved])
            yield batch[[*keys, "n"]].assign(models=made)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.schema.fields if f.name in keys)
    return moments.mapInPandas(fit, f"{kinds}, n long, models {MODELS}")


def scored_by_list(rows: DataFrame, own: DataFrame, whole: DataFrame, by: str, names: list[str], least: int = C.MIN_CLUSTER) -> DataFrame:
    """``rows`` once for every list, plus ``list`` and ``log_expected``; clusters under ``least`` cards use the date's model."""
    own = own.where(F.col("n") >= least).select(by, "cluster", F.col("models").alias("__own"))
    joined = rows.join(own, [by, "cluster"], "left").join(whole.select(by, F.col("models").alias("__all")), by)
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in names])
    joined = joined.withColumns({"__x": values, "__m": F.explode(F.coalesce("__own", "__all"))}).drop("__own", "__all")
    terms = F.zip_with("__m.weights", "__x", lambda w, x: w * x)
    return joined.withColumns({"list": F.col("__m.list"), "log_expected": F.aggregate(terms, F.col("__m.base"), lambda a, t: a + t)}).drop("__m", "__x")


def evaluate(
    panel: DataFrame,
    cards: DataFrame,
    lists: Lists,
    priors: DataFrame | None = None,
    horizon: int = 28,
    step_days: int = C.PANEL_STEP_DAYS,
    floor: float = C.BOARD_FLOOR,
) -> DataFrame:
    """Rows (list, fresh_ic, fresh_t, mature_ic, mature_t, all_ic, decile_spread, r2_log), one for each feature list.

    As of each date of the panel every list's model is fitted on the cards priced then.  Per date the ranks of
    mispricing and of the return to the date nearest ``horizon`` days ahead are correlated, in all cards above ``floor``,
    in fresh and in mature ones; their mean and its t with overlapping windows allowed for are the figures.  The spread is
    the return of the most mispriced tenth less that of the least.  ``r2_log`` is of the last date's fit.  A figure that
    has too few cards or dates is null.  Dates of fewer than 12 cards make nothing.
    """
    ship(panel.sparkSession)
    names = sorted({f for own, _ in lists.values() for f in own})
    at = panel.where("price > 0").select(F.col("date").alias("eval_date"), "card_id", F.col("price").alias("market_price")).join(cards.drop("market_price"), "card_id")
    enough = at.groupBy("eval_date").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= C.MIN_CLUSTER).select("eval_date")
    made = features.card_features(at.join(enough, "eval_date"), priors, F.col("eval_date"), ["eval_date"])
    made = made.withColumns({"cluster": ridge.cluster_key(F.col("supertype"), F.col("rarity")), "__y": F.ln("market_price"), "age_days": F.datediff("eval_date", "release_date")})
    made = cut(made.select("eval_date", "card_id", "cluster", "market_price", "age_days", "__y", *names))

    own = models(gram(made, ["eval_date", "cluster"], "__y", names), ["eval_date", "cluster"], names, lists)
    whole = models(gram(made, ["eval_date"], "__y", names), ["eval_date"], names, lists)
    scored = cut(scored_by_list(made, own, whole, "eval_date", names).select("list", "eval_date", "card_id", "market_price", "age_days", F.exp("log_expected").alias("expected")))

    last = made.agg(F.max("eval_date").alias("eval_date"))
    fitted = scored.join(F.broadcast(last), "eval_date").groupBy("list").agg(stats.squared_log_correlation("market_price", "expected").alias("r2_log"))  # one row

    pairs = asof.nearest_forward(panel.select("date").distinct(), (horizon,))
    later = panel.select(F.col("date").alias("next_date"), "card_id", F.col("price").alias("__next")).where("__next is not null")
    obs = scored.where(F.col("market_price") >= floor).join(pairs, F.col("eval_date") == F.col("date")).join(later, ["next_date", "card_id"])
    mispricing = F.round(F.try_divide(F.col("expected") - F.col("market_price"), "expected"), 9)  # ties must not hang on the order of sums
    forward = (F.col("__next") - F.col("market_price")) / F.col("market_price")
    obs = cut(obs.select("list", "date", "card_id", mispricing.alias("mispricing"), forward.alias("fwd"), F.col("market_price").alias("price"), "age_days").where("mispricing is not null"))

    lag = max(1, -(-horizon // step_days) + 1)
    ics = stats.ic_summary(backtest.segment_ics(backtest.by_segment(obs), ["list", "segment"]), ["list", "segment"], lag=lag)
    of = lambda segment, c: F.max(F.when(F.col("segment") == segment, F.col(c)))
    figures = ics.groupBy("list").agg(
        of("fresh", "mean_ic").alias("fresh_ic"), of("fresh", "t_hac").alias("fresh_t"), of("mature", "mean_ic").alias("mature_ic"), of("mature", "t_hac").alias("mature_t"), of("all", "mean_ic").alias("all_ic"),
    )
    legs = backtest.decile_legs(obs, ["list"]).select("list", F.col("spread").alias("decile_spread"))
    names_of = panel.sparkSession.createDataFrame([(label,) for label in lists], "list string")
    return names_of.join(figures, "list", "left").join(legs, "list", "left").join(fitted, "list", "left")

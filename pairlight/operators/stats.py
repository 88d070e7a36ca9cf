"""Distribution summaries and rank tests of scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.cluster import running
from pairlight.compat import NAN, is_number

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def summary(values: DataFrame, by: list[str], value: str = "value", approximate: bool = False) -> DataFrame:
    """n, mean, median, population deviation, quantiles, extremes; null and NaN are left out.

    Quantiles interpolate linearly and are exact: they are read off running counts
    of the different values, so that no task holds the values of a group.
    ``approximate`` takes mergeable sketches of 10,000 entries instead, in one pass.
    """
    v = F.col(value).cast("double")
    known = values.where(is_number(F.col(value)))
    if approximate:
        out = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile_approx(v, list(QUANTILES), 10000).alias("q"))
        return _named(out, by)
    counts = running(known.groupBy(*by, v.alias("__v")).agg(F.count(F.lit(1)).alias("__t")), by, "__v", "__t", "__before")
    t, x = F.col("__t").cast("double"), F.col("__v")
    whole = counts.groupBy(*by).agg(F.sum("__t").alias("n"), F.sum(t * x).alias("__sum"), F.min(x).alias("min"), F.max(x).alias("max")).withColumn("mean", F.col("__sum") / F.col("n")).drop("__sum")
    renamed = whole.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], *[c for c in whole.columns if c not in by])
    joined = counts.join(renamed, [counts[c].eqNullSafe(renamed[f"__g{i}"]) for i, c in enumerate(by)])
    at = lambda k: F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__t")), x))
    quantiles = []
    for q in QUANTILES:
        place = F.lit(q) * (F.col("n") - 1)
        quantiles += [at(F.floor(place)), at(F.ceil(place))]
    out = joined.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.sqrt(F.sum(t * (x - F.col("mean")) * (x - F.col("mean"))) / F.first("n")).alias("stdev"), F.first("min").alias("min"), F.first("max").alias("max"),
        *[c.alias(f"__q{i}") for i, c in enumerate(quantiles)],
    )
    part = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    mixed = [F.when(F.col(f"__q{2 * i}") == F.col(f"__q{2 * i + 1}"), F.col(f"__q{2 * i}")).otherwise((1 - part(q)) * F.col(f"__q{2 * i}") + part(q) * F.col(f"__q{2 * i + 1}")) for i, q in enumerate(QUANTILES)]
    return _named(out.withColumn("q", F.array(*mixed)), by)


def _named(out: DataFrame, by: list[str]) -> DataFrame:
    at = lambda i: F.col("q")[i].cast("double")
    return out.select(*by, "n", "mean", at(2).alias("median"), "stdev", at(0).alias("q05"), at(1).alias("q25"), at(3).alias("q75"), at(4).alias("q95"), "min", "max")


def normal_tail(z: Column | str) -> Column:
    """Two-sided p of a standard normal z; NaN for null and NaN."""

    @F.pandas_udf("double")
    def tail(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: math.erfc(abs(x) / math.sqrt(2.0)) if x is not None and x == x else float("nan")).astype("float64")

    return F.coalesce(tail(z), F.lit(NAN))


def rank_test(scores: DataFrame, by: list[str], value: str = "score", side: str = "side", first: str = "B", second: str = "A") -> DataFrame:
    """Mann-Whitney U of ``first`` against ``second`` in each group.

    Ranks come from running counts of the different values, so one large group is
    spread over tasks. Ties share the mean rank; z has the tie correction and no
    continuity correction. Null and NaN are left out; a group with one side
    only has NaN, and variance 0 gives NaN for z and p.
    """
    v = F.col(value).cast("double")
    one = lambda s: F.sum(F.when(F.col(side) == s, 1).otherwise(0)).cast("bigint")
    counts = scores.where(is_number(v)).groupBy(*by, v.alias("v")).agg(one(first).alias("nb"), one(second).alias("na"))
    ranked = running(counts.withColumn("t", F.col("na") + F.col("nb")), by, "v", "t")
    rank = F.col("before") + (F.col("t") + 1) / 2.0
    t = F.col("t").cast("double")
    g = ranked.groupBy(*by).agg(F.sum("nb").alias("n_b"), F.sum("na").alias("n_a"), F.sum(F.col("nb") * rank).alias("__r"), F.sum(t * t * t - t).alias("__tie"))
    nb, na = F.col("n_b").cast("double"), F.col("n_a").cast("double")
    n = nb + na
    both = (nb > 0) & (na > 0)
    u = F.when(both, F.col("__r") - nb * (nb + 1) / 2).otherwise(F.lit(NAN))
    var = F.when(n > 1, nb * na / 12 * ((n + 1) - F.try_divide(F.col("__tie"), n * (n - 1)))).otherwise(F.lit(0.0))
    z = F.when(both & (var > 0), (u - nb * na / 2) / F.sqrt(F.greatest(var, F.lit(1e-300)))).otherwise(F.lit(NAN))
    r = F.when(both & (var > 0), F.try_divide(2 * u, nb * na) - 1).otherwise(F.lit(NAN))
    return g.select(*by, "n_b", "n_a", u.alias("u"), z.alias("z"), r.alias("rank_biserial"))


def with_p(tested: DataFrame) -> DataFrame:
    """Rank tests with their two-sided p, a few rows through Arrow."""
    return tested.withColumn("p_value", normal_tail("z"))


def severity_summary(rows: DataFrame, by: list[Column | str] = ()) -> DataFrame:
    """Counts per severity, triggered and pooled with rates, of rows with severity, triggered, pool_keep."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("none", "mild", "moderate", "severe", "extreme")],
        F.count_if("triggered").alias("n_triggered"), F.count_if("pool_keep").alias("n_pool"),
        F.coalesce(F.avg(F.col("triggered").cast("double")), F.lit(0.0)).alias("triggered_rate"), F.coalesce(F.avg(F.col("pool_keep").cast("double")), F.lit(0.0)).alias("pool_rate"),
    )

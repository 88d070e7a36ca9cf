"""Scoring distinct texts through a pluggable scorer, with a cache table.

Each distinct text of a scorer is scored once; what the cache knows is not
scored again. A scorer is a function of a pandas Series of texts to a Series of
doubles; it is called on Arrow batches in executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.compat import is_number

Scorer = Callable[[pd.Series], pd.Series]


def hash_score(metric: str, text: Column) -> Column:
    """A stand-in score in [0, 1): the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(metric + ":"), text)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def compacted(cache: DataFrame) -> DataFrame:
    """The last entry of each scorer and text of an append log, NaN scores left out.

    Later ``created_utc`` wins, of equal ones the greater score.
    """
    good = cache.where(is_number(F.col("score")) & F.col("text_hash").isNotNull())
    return good.groupBy("scorer_id", "text_hash").agg(F.max_by("score", F.struct("created_utc", "score")).alias("score"), F.max("created_utc").alias("created_utc"))


def cache_hits(wanted: DataFrame, cache: DataFrame, scorer_id: str) -> DataFrame:
    """``text_hash``, ``score`` of the wanted hashes that the cache knows."""
    known = compacted(cache.where(F.col("scorer_id") == scorer_id)).select("text_hash", "score")
    return known.join(wanted.select("text_hash").where("text_hash is not null").distinct(), "text_hash", "left_semi")


def cache_misses(wanted: DataFrame, cache: DataFrame, scorer_id: str) -> DataFrame:
    """The distinct wanted hashes that the cache does not know."""
    known = compacted(cache.where(F.col("scorer_id") == scorer_id)).select("text_hash")
    return wanted.select("text_hash").where("text_hash is not null").distinct().join(known, "text_hash", "left_anti")


def score_missing(texts: DataFrame, cache: DataFrame, scorer_id: str, scorer: Scorer, created_utc: str, max_chars: int | None = None) -> DataFrame:
    """New cache rows: each distinct text that the cache does not know, scored once.

    ``texts`` has text and text_hash. The scorer id should name the model, since
    it is all that tells cached scores apart. ``max_chars`` cuts what the scorer
    sees, for scorers with such a limit.
    """
    one = texts.where("text_hash is not null").groupBy("text_hash").agg(F.min("text").alias("text"))
    todo = one.join(cache_misses(texts, cache, scorer_id), "text_hash", "left_semi")

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield scorer(b.str.strip().str.slice(0, max_chars)).astype("float64")

    return todo.select(F.lit(scorer_id).alias("scorer_id"), "text_hash", score.asNondeterministic()("text").alias("score"), F.lit(created_utc).alias("created_utc"))


def scored(long: DataFrame, cache: DataFrame, scorers: list[str]) -> DataFrame:
    """key, side, view, metric, score of one-row-a-side texts, out of the cache; NaN is no score."""
    table = compacted(cache).where(F.col("scorer_id").isin(scorers)).select("text_hash", F.col("scorer_id").alias("metric"), "score")
    return long.join(table, "text_hash").select("key", "side", "view", "metric", "score")


def resume(todo: DataFrame, done: DataFrame, keys: list[str], reprocess_failed: bool = False) -> DataFrame:
    """The rows of ``todo`` that are not yet done; failed ones again if asked for.

    ``done`` has the keys and success; the last row of a key is not looked for,
    one success settles it. Null keys match null keys.
    """
    settled = done.where(F.coalesce("success", F.lit(False))) if reprocess_failed else done
    t, d = todo.alias("t"), settled.select(*keys).distinct().alias("d")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    return t.join(d, on, "left_anti")

"""Normalizing raw samples, checking them, and describing datasets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlight.cluster import row_numbers
from pairlight.compat import py_strip
from pairlight.functions.answers import short_hash


def suffixed_ids(df: DataFrame, base: str, order: list[str], out: str = "sample_id") -> DataFrame:
    """``out``: the base id, with __k for its k-th repeat in ``order`` (the first has none)."""
    k = F.col("__k") - 1
    return row_numbers(df, [base], order, "__k").withColumn(out, F.when(k == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("__"), k.cast("string")))).drop("__k")


def normalized(raw: DataFrame, order: list[str]) -> DataFrame:
    """Samples of question lists: needs benchmark_id, condition (diff or equal), question, scenario_id.

    The id is benchmark:condition:scenario:hash, the scenario being h and a hash
    where it is missing. The label follows from the condition. Blank questions stay.
    """
    q = F.coalesce(py_strip("question"), F.lit(""))
    scenario = F.coalesce(F.nullif(py_strip("scenario_id"), F.lit("")), F.concat(F.lit("h"), short_hash(q, 12)))
    base = F.concat_ws(":", "benchmark_id", "condition", scenario, short_hash(q, 8))
    rows = raw.withColumns({"prompt": q, "__base": base, "gold_label": F.when(F.col("condition") == "diff", F.lit("YES")).when(F.col("condition") == "equal", F.lit("NO"))})
    return suffixed_ids(rows, "__base", order).drop("__base")


def repeated_ids(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Ids that occur more than once, with their counts."""
    return df.groupBy(F.col(key).alias(key)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def require_unique(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """``df``, or ValueError with up to ten repeated ids."""
    bad = [r[0] for r in repeated_ids(df, key).orderBy(F.desc("n"), key).limit(10).collect()]
    if bad:
        raise ValueError(f"repeated ids: {bad}")
    return df


def value_counts(df: DataFrame, column: str, top: int = 20, order: str | None = None) -> DataFrame:
    """value, n of the most frequent values; ties by first occurrence in ``order``, else by value."""
    first = F.min(order) if order else F.min(column)
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"), first.alias("__f")).orderBy(F.desc("n"), "__f").limit(top).select("value", "n")


def meta_keys(df: DataFrame, by: list[str], meta: str = "meta") -> DataFrame:
    """``by`` and ``key``, ``n``: the top-level keys of the open JSON objects in ``meta``."""
    keys = F.explode(F.json_object_keys(meta))
    return df.select(*by, keys.alias("key")).groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"))


def with_meta(meta: Column | str, fields: dict[str, Column]) -> Column:
    """A JSON object with further fields, where it has them not yet and they are not null.

    The text of the object stays as it is; null and anything but an object count as
    an empty object.
    """
    m = F.col(meta) if isinstance(meta, str) else meta
    trimmed = F.trim(m)
    known = F.json_object_keys(trimmed)
    body = F.when(known.isNotNull() & (F.size(known) > 0), F.rtrim(F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)))
    parts = [body]
    for name, value in fields.items():
        field = F.concat(F.lit(json.dumps(name) + ":"), F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))
        parts.append(F.when(value.isNotNull() & ~F.coalesce(F.array_contains(known, name), F.lit(False)), field))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def propagated(teacher: DataFrame, columns: tuple[str, ...] = ("severity_bin", "regression_trigger")) -> DataFrame:
    """Teacher inputs whose ``meta`` names the severity and the trigger of the record they repair, unless it does already."""
    return teacher.withColumn("meta", with_meta("meta", {c: F.col(c) for c in columns if c in teacher.columns}))


def slice_cards(df: DataFrame, by: Column, columns: dict[str, str], top: int = 20) -> DataFrame:
    """source, slice, value, n of the ``top`` most frequent values of each slice column a source; ties by value.

    Counted first, so the rows that are ranked are the different values.
    """
    cells = F.array(*[F.struct(F.lit(d).alias("slice"), F.col(c).cast("string").alias("value")) for d, c in columns.items()])
    counts = df.select(by.alias("source"), F.inline(cells)).where("value is not null").groupBy("source", "slice", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("source", "slice").orderBy(F.desc("n"), "value"))
    return counts.withColumn("__r", rank).where(F.col("__r") <= top).drop("__r")


def cards(df: DataFrame, by: Column, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """One row a source: samples, samples per split and label, different writers of meta keys.

    Keys are made different before they are gathered, so the gathered list is as
    long as the source has different keys.
    """
    named = df.withColumn("__source", by)
    keys = named.select("__source", F.explode(F.json_object_keys("meta")).alias("key")).distinct().groupBy("__source").agg(F.array_sort(F.collect_list("key")).alias("meta_keys"))
    counts = named.groupBy("__source").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in splits], F.count_if(F.col("split").isNull()).alias("n_no_split"),
        F.count_if(F.col("gold_label") == "YES").alias("n_yes"), F.count_if(F.col("gold_label") == "NO").alias("n_no"), F.count_if(F.col("gold_label").isNull()).alias("n_unlabeled"),
    )
    keys = keys.withColumnRenamed("__source", "__of")
    return counts.join(keys, counts["__source"].eqNullSafe(keys["__of"]), "left").drop("__of").withColumnRenamed("__source", "source").withColumn("meta_keys", F.coalesce("meta_keys", F.array().cast("array<string>")))


def statistics(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """dimension, value, n of several columns at once; empty values are skipped."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in columns.items()])
    return df.select(F.inline(cells)).where("value is not null and value <> ''").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def first_annotation(cases: DataFrame, notes: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Cases with their first annotation and the number of annotations; cases without keep nulls and 0.

    Annotations are folded before the join, combined map-side.
    """
    fold = notes.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__a"), F.count(F.lit(1)).alias("n_annotations"))
    return cases.join(fold, key, "left").select(cases["*"], *[F.col(f"__a.{c}").alias(c) for c in columns], F.coalesce("n_annotations", F.lit(0)).alias("n_annotations"))


def plural(noun: Column | str) -> Column:
    """English plural of a phrase's last word, by suffix."""
    n = F.col(noun) if isinstance(noun, str) else noun
    return (
        F.when(n.rlike("(?i)[^aeiou]y$"), F.regexp_replace(n, "(?i)y$", "ies")).when(n.rlike("(?i)(s|x|z|ch|sh)$"), F.concat(n, F.lit("es")))
        .when(n.rlike("(?i)man$"), F.regexp_replace(n, "(?i)man$", "men")).otherwise(F.concat(n, F.lit("s")))
    )


def picked(choices: Column, seed: int, *keys: Column | str) -> Column:
    """One element of an array, by hash of the seed and the keys; null for an empty array."""
    from pairlight.compat import seeded

    n = F.conv(F.substring(seeded(seed, *keys), 1, 8), 16, 10).cast("bigint")
    return F.when(F.size(choices) > 0, F.try_element_at(choices, (F.pmod(n, F.greatest(F.size(choices), F.lit(1))) + 1).cast("int")))

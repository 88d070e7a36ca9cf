"""Aligning two runs, and going between wide pairs and one row a side and view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.functions import answers
from pairlight.functions.labels import group, label, policy, prediction, record_key

VIEWS = {"analysis_only": "parsed_analysis", "full_output": "raw_text"}


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order`` (nulls first, so they lose); all columns.

    Combined map-side: a key with a third of all rows sends one row a partition.
    """
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``; all columns."""
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


_SHARED = ("sample_id", "policy_id", "prompt", "gold_label", "source", "split", "meta")
_SIDE = ("model_id", "base_model", "adapter_path", "raw_text", "parsed_analysis", "parsed_conclusion", "parse_ok", "parse_issues")
#: Columns that only texts need; metrics do without.
_TEXTS = ("prompt", "meta", "raw_text", "parsed_analysis", "base_model", "adapter_path", "parse_issues")


def run(predictions: DataFrame, model: str | Column, order: Sequence[str] = ("received_at", "delivery_id"), texts: bool = True) -> DataFrame:
    """One model's predictions with ``key``, the last row of each key.

    ``model`` is a model id, or a condition that one model's rows fulfil. Only columns that pairs have are read and shuffled; without ``texts`` the
    long ones stay in the file.
    """
    wanted = [c for c in (*_SHARED, *_SIDE) if c in predictions.columns and (texts or c not in _TEXTS)]
    own = predictions.where(F.col("model_id") == model if isinstance(model, str) else model).select(*wanted, *order).withColumn("key", record_key("sample_id", "policy_id"))
    return last_wins(own, ["key"], order)


def pair_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of two runs by key, one row each: shared fields from A, both sides' answers.

    Both frames have ``key`` and come from :func:`run`. A's prompt and gold label
    count unless empty; source, split and meta are A's. Keys of one run only are
    left out.
    """
    side = [c for c in _SIDE if c in a.columns and c in b.columns]
    both = [c for c in ("prompt", "gold_label") if c in a.columns and c in b.columns]
    left = a.select("key", *[c for c in _SHARED if c in a.columns], *[F.col(c).alias(f"a_{c}") for c in side])
    right = b.select("key", *[F.col(c).alias(f"__{c}") for c in both], *[F.col(c).alias(f"b_{c}") for c in side])
    full = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")) for c in both}
    out = left.join(right, "key").withColumns({**({"prompt": full["prompt"]} if "prompt" in full else {}), "gold": label(full["gold_label"]), "policy": policy("policy_id"), "grp": group("source")})
    return out.withColumns({"a_pred": prediction("a_parsed_conclusion", "a_parse_ok"), "b_pred": prediction("b_parsed_conclusion", "b_parse_ok")}).drop(*[f"__{c}" for c in both])


def side_long(pairs: DataFrame, views: dict[str, str] = VIEWS) -> DataFrame:
    """``key``, ``side``, ``view``, ``text``, ``text_hash`` of every text that is not blank."""
    rows = [F.struct(F.lit(s.upper()).alias("side"), F.lit(v).alias("view"), F.col(f"{s}_{c}").alias("text")) for s in "ab" for v, c in views.items()]
    long = pairs.select("key", F.inline(F.array(*rows)))
    return long.withColumn("text_hash", answers.text_key("text")).where(F.length(F.coalesce(F.regexp_replace("text", r"(?U)\s", ""), F.lit(""))) > 0)


def attach_scores(pairs: DataFrame, scored: DataFrame, view: str, metric: str) -> DataFrame:
    """``pairs`` with a_score and b_score of a view and metric; null where a text has none.

    ``scored`` has key, side, view, metric, score.
    """
    one = scored.where((F.col("view") == view) & (F.col("metric") == metric)).groupBy("key").agg(
        F.max(F.when(F.col("side") == "A", F.col("score"))).alias("a_score"), F.max(F.when(F.col("side") == "B", F.col("score"))).alias("b_score")
    )
    return pairs.join(one, "key", "left")


def nested(pairs: DataFrame) -> DataFrame:
    """The paired output record: shared fields and a struct of both sides."""
    side = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("model_id", "base_model", "adapter_path", "raw_text", "parsed_analysis", "parsed_conclusion", "parse_ok", "parse_issues")])
    return pairs.select("sample_id", "source", "prompt", "gold_label", "split", "meta", "policy_id", F.struct(side("a").alias("A"), side("b").alias("B")).alias("paired"))


def flat(paired: DataFrame) -> DataFrame:
    """Wide pairs of paired records; rows without both sides or id are left out."""
    rows = paired.where(F.col("paired.A").isNotNull() & F.col("paired.B").isNotNull() & (F.coalesce(F.trim("sample_id"), F.lit("")) != ""))
    cols: list[Column] = [F.col(f"paired.{s.upper()}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("model_id", "base_model", "adapter_path", "raw_text", "parsed_analysis", "parsed_conclusion", "parse_ok", "parse_issues")]
    out = rows.select("sample_id", "source", "prompt", "gold_label", "split", "meta", "policy_id", *cols)
    return out.withColumns({
        "key": record_key("sample_id", "policy_id"), "gold": label("gold_label"), "policy": policy("policy_id"), "grp": group("source"),
        "a_pred": prediction("a_parsed_conclusion", "a_parse_ok"), "b_pred": prediction("b_parsed_conclusion", "b_parse_ok"),
    })

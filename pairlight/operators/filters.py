"""Filters of records, predictions and pairs before a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.functions.labels import policy


def filter_records(records: DataFrame, splits: Sequence[str] | None = None, sources: Sequence[str] | None = None, cap: int | None = None) -> DataFrame:
    """Records of some splits and sources, which a missing value never fits; the first ``cap`` by id."""
    for column, wanted in (("split", splits), ("source", sources)):
        if wanted is not None:
            records = records.where(F.col(column).isin(*wanted))
    return records if cap is None else records.orderBy("sample_id").limit(cap)


def filter_predictions(predictions: DataFrame, splits: Sequence[str] | None = None, policies: Sequence[str] | None = None, cap: int | None = None) -> DataFrame:
    """Predictions of some splits and policies; a missing or empty split is unknown, a missing policy policy_unknown, and both can be asked for."""
    if splits is not None:
        predictions = predictions.where(F.coalesce(F.nullif("split", F.lit("")), F.lit("unknown")).isin(*splits))
    if policies is not None:
        predictions = predictions.where(policy("policy_id").isin(*policies))
    return predictions if cap is None else predictions.orderBy("sample_id").limit(cap)


def filter_pairs(pairs: DataFrame, policies: Sequence[str] | None = None, cap: int | None = None) -> DataFrame:
    """Pairs of some policies (``policy``, policy_unknown where missing); the first ``cap`` by key."""
    if policies is not None:
        pairs = pairs.where(F.coalesce("policy", F.lit("policy_unknown")).isin(*policies))
    return pairs if cap is None else pairs.orderBy("key").limit(cap)

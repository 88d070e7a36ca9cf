"""Exactly one copy of messages that were delivered at least once.

Identifiers are split by their aggregated frequency. Rows whose identifier
occurs once pass without ranking; only rows of repeated identifiers are ranked,
and the two results are united. The count is combined map-side, so an
identifier with a third of all rows costs one partial row a partition. Rows get
their salt before they are moved (see :func:`pairlight.cluster.salted`), so its
rows are ranked in two levels, within salts in proportion to its count and then
the salts' first rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlight.cluster import cut, salted
from pairlight.compat import py_strip

#: Rows of one identifier that a single ranking task may get.
ROWS_A_SALT = 20_000
#: Measured size up to which the list of repeated identifiers is broadcast.
LIST_BYTES = 8 << 20
_N, _SALT, _RN, _BEATEN = "__copies", "__salt", "__rank", "__beaten"


def policy_key(c: Column | str) -> Column:
    """Policy as compared: trimmed, without case; null and blank are policy_unknown."""
    p = F.lower(py_strip(c))
    return F.when(p.isNull() | (p == ""), F.lit("policy_unknown")).otherwise(p)


def message_keys(df: DataFrame) -> dict[str, Column]:
    """The identifier of a prediction message, one column a part.

    A null part equals another null part and differs from every text, blank
    text included, save for the policy (see :func:`policy_key`).
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return {
        "__model": part(df["model_id"].cast("string")),
        "__sample": part(py_strip(df["sample_id"])),
        "__policy": policy_key(df["policy_id"]),
    }


def _split(rows: DataFrame, keys: Sequence[str], limit_bytes: int) -> tuple[DataFrame, DataFrame, bool]:
    """Rows of single and of repeated identifiers, and whether an identifier is heavy.

    The repeated ones have a salt. The list of repeated identifiers is broadcast
    while it measures under ``limit_bytes``; beyond, list and rows meet by a
    shuffle on identifier and salt, on which the first ranking goes on.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(_N))
    repeated = cut(counts.where(F.col(_N) > 1))
    mine, known, heavy = salted(rows, repeated, list(keys), _N, ["received_at", "delivery_id"], _SALT, ROWS_A_SALT, limit_bytes=limit_bytes)
    known = known.select(*keys, _SALT)
    on = [*keys, _SALT]
    return mine.join(known, on, "left_anti"), mine.join(known, on, "inner"), heavy


def _rank(rows: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    newest = [rows["received_at"].desc_nulls_last(), rows["delivery_id"].desc_nulls_last()]
    return rows.withColumn(_RN, F.row_number().over(Window.partitionBy(*by).orderBy(*newest)))


def surplus_rows(df: DataFrame, limit_bytes: int = LIST_BYTES) -> DataFrame:
    """``delivery_id`` of every row that is not the kept copy of its message.

    Kept is the row with the latest ``received_at``, then the greatest
    ``delivery_id``; nulls lose to every value. Rows that agree in both lose to
    one of them. Only key columns are read and shuffled. An empty table gives
    an empty result; further columns of any name are ignored.
    """
    keys = message_keys(df)
    rows = df.select(*[c.alias(n) for n, c in keys.items()], "received_at", "delivery_id")
    _, repeated, heavy = _split(rows, list(keys), limit_bytes)
    ranked = _rank(repeated, [*keys, _SALT])
    if heavy:  # the salts' first rows meet once more, the beaten ones stay where they are
        first = F.col(_RN) == 1
        ranked = _rank(ranked.withColumns({_BEATEN: ~first, _SALT: F.when(first, F.lit(-1)).otherwise(F.col(_SALT))}), [*keys, _SALT]).where(F.col(_BEATEN) | (F.col(_RN) > 1))
    else:
        ranked = ranked.where(F.col(_RN) > 1)
    return ranked.select("delivery_id")


def keep_one(df: DataFrame, new: DataFrame | None = None, limit_bytes: int = LIST_BYTES) -> DataFrame:
    """The kept copy of every message of ``df``, and of ``new`` if given, whole rows.

    ``df`` may be the result of an earlier call (the stored messages); with the
    new batch as ``new`` the result equals that over all messages at once.
    The columns are those of ``df``; ``new`` must have them too.
    """
    everything = df if new is None else df.unionByName(new.select(*df.columns))
    keys = message_keys(everything)
    rows = everything.withColumns(keys)
    single, repeated, heavy = _split(rows, list(keys), limit_bytes)
    kept = _rank(repeated, [*keys, _SALT]).where(F.col(_RN) == 1)
    if heavy:
        kept = _rank(kept.drop(_RN), keys).where(F.col(_RN) == 1)
    return single.select(*df.columns).unionByName(kept.select(*df.columns))

"""Registered queries of the general data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.cluster import table
from pairlight.operators import redelivery

_TRIM = r"regexp_replace({c}, '^[\s\x0b\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x0b\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"


def _trim(c: str) -> str:
    return _TRIM.format(c=c)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return redelivery.surplus_rows(table(spark, folder, "predictions"))


def p1_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The kept copy of every message, without the nested columns."""
    kept = redelivery.keep_one(table(spark, folder, "predictions"))
    return kept.select("delivery_id", "model_id", "sample_id", "policy_id", "batch_id", F.md5(F.coalesce("raw_text", F.lit(""))).alias("text_md5"))


_RANKED = f"""
SELECT *, row_number() OVER (
  PARTITION BY model_id, {_trim("sample_id")},
    CASE WHEN coalesce(lower({_trim("policy_id")}), '') = '' THEN 'policy_unknown' ELSE lower({_trim("policy_id")}) END
  ORDER BY received_at DESC NULLS LAST, delivery_id DESC) AS rn
FROM predictions"""

QUERIES = {"p1_found": p1_found, "p1_messages": p1_messages}
SQL = {
    "p1_found": f"SELECT delivery_id FROM ({_RANKED}) WHERE rn > 1",
    "p1_messages": f"SELECT delivery_id, model_id, sample_id, policy_id, batch_id, md5(coalesce(raw_text, '')) AS text_md5 FROM ({_RANKED}) WHERE rn = 1",
}

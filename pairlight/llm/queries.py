"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlight.cluster import table
from pairlight.llm import defects, encode, harm, mixture, overlap, sentences, splits


def _reviewed(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("samples", "predictions", "documents", "harm_labels")]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return harm.abusive_texts(*_reviewed(spark, folder))


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    return harm.score_fields(*_reviewed(spark, folder))


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return harm.abuse_rates(*_reviewed(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.found_pairs(table(spark, folder, "samples"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(table(spark, folder, "samples"))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.record_links(table(spark, folder, "samples"))


def p3_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.span_coverage(table(spark, folder, "samples"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.divided_records(table(spark, folder, "samples"))


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_splits(table(spark, folder, "samples"), table(spark, folder, "split_targets"))


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_shares(table(spark, folder, "samples"), table(spark, folder, "split_targets"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return defects.defective_pairs(table(spark, folder, "predictions"))


def p5_labels(spark: SparkSession, folder: str) -> DataFrame:
    return defects.labelled_pairs(table(spark, folder, "predictions"))


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    return defects.defect_rates(table(spark, folder, "predictions"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_documents(table(spark, folder, "documents"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixture_shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(table(spark, folder, "documents"))


QUERIES = {
    "p2_found": p2_found, "p2_scores": p2_scores, "p2_rates": p2_rates,
    "p3_found": p3_found, "p3_report": p3_report, "p3_links": p3_links, "p3_coverage": p3_coverage,
    "p4_found": p4_found, "p4_splits": p4_splits, "p4_shares": p4_shares,
    "p5_found": p5_found, "p5_labels": p5_labels, "p5_rates": p5_rates,
    "p6_ids": p6_ids,
    "p7_mixture": p7_mixture, "p7_shares": p7_shares,
    "p8_found": p8_found,
}
_SPACES = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_KEYS = f"""m AS (SELECT sample_id, split, CASE WHEN json_valid(meta) AND json_type(meta) = 'OBJECT' THEN meta::JSON END AS j FROM samples),
  raw AS (SELECT sample_id, 'w' AS kind, CASE WHEN json_type(j->'$.author') = 'OBJECT' THEN j->>'$.author.id' ELSE j->>'$.author' END AS v FROM m UNION ALL SELECT sample_id, 'w', j->>'$.annotator' FROM m
    UNION ALL SELECT sample_id, 'e', j->>'$.entity' FROM m UNION ALL SELECT sample_id, 'e', unnest(j->>'$.entities[*]') FROM m UNION ALL SELECT sample_id, 'f', j->>'$.filename' FROM m),
  value AS (SELECT sample_id, kind, lower(trim(regexp_replace(v, '{_SPACES}', ' ', 'g'))) AS v FROM raw),
  place AS (SELECT sample_id, lower(trim(regexp_replace(j->>'$.benchmark_id', '{_SPACES}', ' ', 'g'))) AS b, lower(trim(regexp_replace(j->>'$.scenario_id', '{_SPACES}', ' ', 'g'))) AS s FROM m),
  keys AS (SELECT DISTINCT sample_id, kind || ':' || v AS k FROM value WHERE v NOT IN ('', 'unknown', 'anonymous', 'n/a', '-') UNION SELECT sample_id, 's:' || b || chr(1) || s FROM place WHERE b NOT IN ('', 'unknown', 'anonymous', 'n/a', '-') AND s NOT IN ('', 'unknown', 'anonymous', 'n/a', '-'))"""
SQL: dict[str, str] = {
    "p4_found": f"""WITH RECURSIVE {_KEYS}, edges AS (SELECT DISTINCT a.k AS x, b.k AS y FROM keys a JOIN keys b USING (sample_id)),
      reach(k, r) AS (SELECT DISTINCT k, k FROM keys UNION SELECT reach.k, e.y FROM reach JOIN edges e ON reach.r = e.x), component AS (SELECT k, min(r) AS c FROM reach GROUP BY k),
      record AS (SELECT sample_id, min(c) AS c FROM keys JOIN component USING (k) GROUP BY sample_id), bad AS (SELECT c FROM record JOIN samples USING (sample_id) WHERE split IS NOT NULL GROUP BY c HAVING count(DISTINCT split) > 1)
      SELECT sample_id FROM record JOIN bad USING (c)""",
}

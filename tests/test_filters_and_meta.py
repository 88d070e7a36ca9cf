import json

import pytest
from pyspark.sql import functions as F

from pairlight import config, pipeline
from pairlight.operators import filters, ingest
from pairlight.sources import files


def test_filters_and_missing_values(spark):
    rows = [("b", "test", "D1", None), ("a", None, "D1", "policy_on"), ("c", "", None, "policy_off"), ("d", "val", "D2", "policy_on")]
    df = spark.createDataFrame(rows, "sample_id string, split string, source string, policy_id string")
    ids = lambda x: [r["sample_id"] for r in x.collect()]
    assert ids(filters.filter_records(df, ("test", "val"), cap=1)) == ["b"]
    assert sorted(ids(filters.filter_predictions(df, ("unknown",)))) == ["a", "c"]
    assert sorted(ids(filters.filter_predictions(df, policies=("policy_unknown", "policy_off")))) == ["b", "c"]
    assert ids(filters.filter_records(df, sources=("D1",), cap=5)) == ["a", "b"]
    pairs = spark.createDataFrame([("k2", None), ("k1", "policy_unknown"), ("k3", "p")], "key string, policy string")
    assert [r["key"] for r in filters.filter_pairs(pairs, ("policy_unknown",), 5).collect()] == ["k1", "k2"]
    assert filters.filter_pairs(pairs.limit(0), ("p",)).count() == 0


def test_meta_keeps_what_it_has(spark):
    rows = [(1, '{"a": {"b": 1}, "severity_bin": "mild"}', "severe"), (2, None, "x"), (3, "{}", 'q"uo\\te'), (4, "[1]", None), (5, "{oops", "s"), (6, ' {"t": "}"} ', "s")]
    out = {r["i"]: json.loads(r["meta"]) for r in ingest.propagated(spark.createDataFrame(rows, "i int, meta string, severity_bin string")).collect()}
    assert out == {1: {"a": {"b": 1}, "severity_bin": "mild"}, 2: {"severity_bin": "x"}, 3: {"severity_bin": 'q"uo\\te'}, 4: {}, 5: {"severity_bin": "s"}, 6: {"t": "}", "severity_bin": "s"}}


def test_string_leaves_depth_first(spark):
    rows = [('{"a": ["x", {"b": "y", "c": 3}], "d": "z"}',), ("[",), (None,), ('"one"',), ('{"a": {"b": {"c": []}}}',)]
    got = [r["s"] for r in spark.createDataFrame(rows, "t string").select(files.string_leaves("t", 2).alias("s")).collect()]
    assert got == [["x", "y"], [], [], ["one"], []]


def test_sources_by_name(spark, tmp_path):
    rows = [(f"s{i}", "D1", "p", None, "test", '{"k": 1}') for i in range(30)]
    files.write_jsonl(spark.createDataFrame(rows, "sample_id string, source string, prompt string, gold_label string, split string, meta string"), str(tmp_path / "one"))
    files.register("mine", lambda spark, path: files.samples_file(spark, path).withColumn("source", F.lit("mine")))
    out = files.load_sources(spark, {"mine": str(tmp_path / "one"), "other": str(tmp_path / "one")}, {"other": 7})
    assert {r["source"]: r["count"] for r in out.groupBy("source").count().collect()} == {"mine": 30, "D1": 7}
    assert json.loads(out.first()["meta"]) == {"k": 1, "source_path": str(tmp_path / "one")}
    assert files.load_sources(spark, {}).count() == 0
    files.write_jsonl(spark.createDataFrame(rows[:1] * 2, "sample_id string, source string, prompt string, gold_label string, split string, meta string"), str(tmp_path / "two"))
    with pytest.raises(ValueError):
        files.load_sources(spark, {"x": str(tmp_path / "two")})
    with pytest.raises(ValueError):
        files.descriptor_sentences(spark, {"a": ["old", "old"]}, {"p": ["man"]}, ["{noun_phrase}"])


def test_single_evaluation_and_provenance(spark, tmp_path):
    rows = [(i, f"s{i}", "policy_on", "M0", "D1" if i % 2 else "", "test", "YES" if i % 3 else "NO", "YES", True) for i in range(40)]
    p = spark.createDataFrame(rows, "delivery_id bigint, sample_id string, policy_id string, model_id string, source string, split string, gold_label string, parsed_conclusion string, parse_ok boolean").withColumn("received_at", F.lit("2031-01-01").cast("timestamp"))
    p.write.parquet(str(tmp_path / "p"))
    s = config.with_overrides(config.Settings(), [f"run.folder={tmp_path}/runs"])
    folder = pipeline.run_single_evaluation(spark.read.parquet(str(tmp_path / "p")), "M0", s, stamp="x", policies=("policy_on",))
    overall = json.loads((folder / "summary.json").read_text())["overall"][0]
    assert overall["n"] == 40 and abs(overall["acc_on_parsed"] - 26 / 40) < 1e-9
    made = json.loads((folder / "provenance.json").read_text())
    assert made["spark"] == spark.version and made["inputs"]["predictions"] and made["fingerprint"] == s.fingerprint()
    pipeline.describe_samples(p.withColumns({"meta": F.lit("{}"), "prompt": F.lit("p")}), str(tmp_path / "cards"))
    assert {r["source"] for r in spark.read.json(str(tmp_path / "cards/cards")).collect()} == {"D1", "unknown"}


def test_absolute_judging_calls_once_for_equal_answers(spark):
    from pairlight.operators import generation

    pairs = spark.createDataFrame([("k1", "p", "fine", "bad"), ("k2", "p", "fine", "fine"), ("k3", "p", "odd", "bad")], "key string, prompt string, a_parsed_analysis string, b_parsed_analysis string")

    def factory():
        def reply(batch):
            said = lambda text: '{"is_harmful": true, "severity": "severe", "reason": "x"}' if "bad" in text else "no json" if "odd" in text else '{"is_harmful": false, "severity": "none", "reason": ""}'
            return [said(str(messages)) for messages in batch]

        return reply

    got = {r["key"]: (r["success"], r["severity"]) for r in generation.judge_sides(pairs, factory).collect()}
    assert got["k1"] == (True, "severe") and got["k2"] == (True, "none") and got["k3"][0] is False


def test_conventional_places(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "BOLD.csv").write_text("x")
    (tmp_path / "HateCheck.csv").write_text("x")
    (tmp_path / "HateCheck.jsonl").write_text("x")
    assert files.default_paths(str(tmp_path)) == {"BOLD": str(tmp_path / "data/BOLD.csv"), "HateCheck": str(tmp_path / "HateCheck.jsonl")}
    assert files.conventional(str(tmp_path), "none") is None

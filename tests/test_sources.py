import json

import pytest
from pyspark.sql import functions as F

from pairlight import config
from pairlight.schema import SAMPLE
from pairlight.sources import files
from pairlight.streaming import audit_stream


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_skips_blank_lines_and_keeps_order(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"sample_id":"b","meta":{"k":1}}\n\n  \n{"sample_id":"a","prompt":"é"}\n')
    rows = files.jsonl(spark, path, SAMPLE).orderBy("_ord").collect()
    assert [(r["sample_id"], r["prompt"], r["meta"]) for r in rows] == [("b", None, '{"k":1}'), ("a", "é", None)]


def test_broken_json_raises_only_if_strict(spark, tmp_path):
    path = write(tmp_path / "b.jsonl", '{"sample_id":"a"}\n{broken\n')
    with pytest.raises(Exception):
        files.jsonl(spark, path, SAMPLE).collect()
    assert [r["sample_id"] for r in files.jsonl(spark, path, SAMPLE, strict=False).collect()] == ["a", None]


def test_jsonl_round_trip_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None, "p", None, "test", '{"x":1}')], SAMPLE)
    files.write_jsonl(df, str(tmp_path / "out"))
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part-*.json"))
    assert json.loads(text)["source"] is None
    assert files.jsonl(spark, str(tmp_path / "out"), SAMPLE).drop("_file", "_ord").collect() == df.collect()


def test_continuation_objects_without_a_text_are_not_full(spark, tmp_path):
    rows = [
        {"id": "1", "prompt": {"text": ""}}, {"id": "2", "prompt": {"text": None}}, {"id": "3", "prompt": {"text": "", "toxicity": 0.1}, "input": "in"},
        {"id": "4", "prompt": {"text": " "}}, {"id": "5", "prompt": '{"text": ""}'}, {"id": "6", "prompt": {"text": "full"}, "input": "in"}, {"id": "7", "prompt": ""},
    ]
    path = write(tmp_path / "rtp.jsonl", "".join(json.dumps(r) + "\n" for r in rows))
    got = {r["sample_id"].split(":")[1]: r["prompt"] for r in files.continuations(spark, path).collect()}
    assert got == {"3": "in", "4": " ", "5": '{"text": ""}', "6": "full"}


def test_suites(spark, tmp_path):
    (tmp_path / "prompts").mkdir()
    (tmp_path / "wiki").mkdir()
    write(tmp_path / "prompts/gender_prompt.json", json.dumps({"g": {"Ann B": ["One", "Two"], "Cy": "Three"}}))
    write(tmp_path / "wiki/gender_wiki.json", json.dumps({"g": {"Ann B": "context"}}))
    rows = files.grouped_prompts(spark, str(tmp_path / "prompts"), str(tmp_path / "wiki")).collect()
    assert sorted(r["prompt"] for r in rows) == ["One", "Three", "Two"]
    assert {json.loads(r["meta"])["entity"]: json.loads(r["meta"]).get("context") for r in rows} == {"Ann B": "context", "Cy": None}
    path = write(tmp_path / "rtp.jsonl", '{"filename":"f1","prompt":{"text":"hello"}}\n{"id":"7","text":"","input":"in"}\n{"id":"8"}\n')
    assert {r["sample_id"]: r["prompt"] for r in files.continuations(spark, path).collect()} == {"RealToxicityPrompts:f1": "hello", "RealToxicityPrompts:7": "in"}
    cases = write(tmp_path / "c.csv", 'case_id,test_case,functionality\n1,"say ""x"", now",f1\n2,b,f2\n')
    notes = write(tmp_path / "n.csv", "case_id,rater\n1,ann\n1,bob\n")
    got = {r["sample_id"]: json.loads(r["meta"]) for r in files.functional_cases(spark, cases, notes).collect()}
    assert got["HateCheck:1"]["rater"] == "ann" and got["HateCheck:1"]["n_annotations"] == 2 and got["HateCheck:2"]["n_annotations"] == 0
    out = files.descriptor_sentences(spark, {"age": ["old", "young"]}, {"people": ["man", "city"]}, ["I met {noun_phrase}.", "{plural_noun_phrase} left."], cap=3).collect()
    assert len(out) == 3 and all("{" not in r["prompt"] for r in out)


def test_files_and_exports(spark, tmp_path):
    write(tmp_path / "x.txt", "abc")
    m = files.metadata(spark, str(tmp_path)).first()
    assert m["length"] == 3 and m["sha256"].startswith("ba7816bf")
    assert files.newest(spark, str(tmp_path), "*.txt").endswith("x.txt")
    df = spark.createDataFrame([("a", "D1", "p", None, None, None)], SAMPLE)
    files.export_samples(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split_part = 'unknown'").count() == 1
    files.write_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "csv"), ["b", "a"])
    assert next((tmp_path / "csv").glob("part-*.csv")).read_text().splitlines() == ["b,a", ",1"]
    files.write_json({"b": float("nan"), "a": (1, 2)}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": [1, 2], "b": None}


def test_inventory_and_layouts(spark, tmp_path):
    listed = [{"metadata": {"relative_path": x}} for x in ("a/D1.csv", "b/D1.jsonl", "N2.json")] + [{"metadata": None}, 3]
    inv = write(tmp_path / "inv.json", json.dumps({"files": listed}))
    assert files.inventory_paths(inv, "/r") == {"D1": "/r/b/D1.jsonl", "N2": "/r/N2.json"}
    assert files.first_existing(None, "/no/such", inv, inv) == inv and files.first_existing("") is None
    single = write(tmp_path / "single.jsonl", '{"sample_id":"s","model_id":"m","raw_text":"x"}\n')
    both = write(tmp_path / "pair.jsonl", '{"sample_id":"s","paired":{"A":{"parsed_conclusion":"YES","parse_ok":true},"B":{"parsed_conclusion":"NO","parse_ok":true}}}\n{"sample_id":"t"}\n')
    assert files.predictions(spark, single).first()["raw_text"] == "x"
    assert [(r["key"], r["a_pred"], r["b_pred"]) for r in files.predictions(spark, both).collect()] == [("s|policy_unknown", "YES", "NO")]


def test_latex_orders_and_fills(spark):
    df = spark.createDataFrame([("BOLD", 0.5, None), ("N1", 0.25, float("nan")), ("D2", 1.0, 0.1)], "source string, m_acc double, m_f1 double")
    lines = files.latex_matrix(df, ["m"], ["acc", "f1"]).splitlines()
    assert [x.split(" & ")[0] for x in lines if "&" in x][1:] == ["D2", "N1", "BOLD"] and "0.250 & --" in "\n".join(lines)


def test_message_stream_keeps_one_copy(spark, tmp_path):
    schema = "delivery_id bigint, received_at timestamp, model_id string, sample_id string, policy_id string"
    src = tmp_path / "in"
    src.mkdir()
    write(src / "1.json", '{"delivery_id":1,"received_at":"2031-01-01T00:00:00","model_id":"m","sample_id":"s"}\n')
    for n in range(2):
        q = audit_stream.messages_stream(audit_stream.stream_files(spark, str(src), schema), str(tmp_path / "kept"), str(tmp_path / "ck"))
        q.awaitTermination(60)
        write(src / "2.json", '{"delivery_id":2,"received_at":"2031-01-02T00:00:00","model_id":"m","sample_id":"s "}\n{"delivery_id":3,"received_at":"2031-01-02T00:00:00","model_id":"m","sample_id":"t"}\n')
    assert sorted(r["delivery_id"] for r in spark.read.parquet(str(tmp_path / "kept/v1")).collect()) == [2, 3]


def test_message_log_writes_what_is_new(spark, tmp_path):
    schema = "delivery_id bigint, received_at timestamp, model_id string, sample_id string, policy_id string"
    src, log = tmp_path / "in", tmp_path / "log"
    src.mkdir()
    write(src / "1.json", '{"delivery_id":1,"received_at":"2031-01-01T00:00:00","model_id":"m","sample_id":"s"}\n{"delivery_id":4,"received_at":"2031-01-01T00:00:00","model_id":"m","sample_id":"u"}\n')
    for n in range(2):
        audit_stream.messages_log(audit_stream.stream_files(spark, str(src), schema), str(log), str(tmp_path / "ck")).awaitTermination(60)
        write(src / "2.json", '{"delivery_id":2,"received_at":"2031-01-02T00:00:00","model_id":"m","sample_id":"s "}\n{"delivery_id":3,"received_at":"2031-01-02T00:00:00","model_id":"m","sample_id":"t"}\n')
    assert spark.read.parquet(str(log / "batch=1")).count() == 2
    assert sorted(r["delivery_id"] for r in audit_stream.logged_messages(spark, str(log)).collect()) == [2, 3, 4]
    audit_stream.compact_log(spark, str(log), str(tmp_path / "small"))
    assert sorted(r["delivery_id"] for r in audit_stream.logged_messages(spark, str(tmp_path / "small")).collect()) == [2, 3, 4]


def test_a_cache_that_cannot_be_read_is_no_empty_cache(spark, tmp_path):
    from pairlight.cluster import parquet_or_empty

    assert parquet_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "bad").mkdir()
    write(tmp_path / "bad" / "x.parquet", "no parquet")
    with pytest.raises(Exception):
        parquet_or_empty(spark, str(tmp_path / "bad"), "a int").count()


def test_score_stream_scores_each_text_once(spark, tmp_path):
    src = tmp_path / "texts"
    src.mkdir()
    write(src / "1.json", '{"text":"a","text_hash":"h1"}\n{"text":"b","text_hash":"h2"}\n')
    for n in range(2):
        stream = audit_stream.stream_files(spark, str(src), "text string, text_hash string")
        audit_stream.score_stream(stream, str(tmp_path / "cache"), str(tmp_path / "ck"), "m", lambda s: s.str.len(), "2031").awaitTermination(60)
        write(src / "2.json", '{"text":"a","text_hash":"h1"}\n{"text":"c","text_hash":"h3"}\n')
    assert sorted(r["text_hash"] for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == ["h1", "h2", "h3"]


def test_settings(tmp_path):
    s = config.with_overrides(config.Settings(), ["audit.judge_mode=validate", "audit.thresholds.mild=0.05", "evaluation.n_boot=10", "run.name=x"])
    assert (s.audit.thresholds.mild, s.evaluation.n_boot, s.run.name) == (0.05, 10, "x")
    config.save(s, str(tmp_path / "s.json"))
    assert config.load(str(tmp_path / "s.json")) == s and s.fingerprint() != config.Settings().fingerprint()
    for bad in (["audit.judge_mode=never"], ["evaluation.alpha=2"]):
        with pytest.raises(ValueError):
            config.with_overrides(config.Settings(), bad)
    with pytest.raises(KeyError):
        config.with_overrides(config.Settings(), ["audit.nothing=1"])
    folder = config.run_folder(config.with_overrides(config.Settings(), [f"run.folder={tmp_path}"]), "audit", "now")
    assert (folder / "settings.json").exists()

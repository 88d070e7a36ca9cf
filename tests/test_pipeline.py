import json

import pytest
from pyspark.sql import functions as F

from pairlight import __main__ as cli
from pairlight import config, pipeline
from pairlight.operators import generation, pairing

QUICK = generation.Limits(first_wait=0.0, tasks=2, batch=3)


def test_bucket_waits_for_its_rate():
    now = [0.0]
    b = generation.Bucket(60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(10):
        b.take(1)
    assert 7.9 < now[0] < 8.1
    generation.Bucket(0).take(10**9)


def test_retries_wait_longer_and_stop_at_fatal_errors():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise generation.RetryableError("busy")
        return ["ok"]

    assert generation.with_retries(flaky, generation.Limits(first_wait=1.0), waits.append) == ["ok"] and waits == [1.0, 2.0]

    def fatal():
        raise generation.FatalError("bad request")

    with pytest.raises(generation.FatalError):
        generation.with_retries(fatal, generation.Limits(), waits.append)
    assert len(waits) == 2


@pytest.fixture
def echo():
    """A factory that executors get by value: they do not import this module."""

    def factory():
        def backend(chats):
            if any("boom" in c[-1]["content"] for c in chats):
                raise generation.FatalError("boom")
            return [("It is short." if len(c) < 4 else "One fact. Two facts.") + "\nConclusion: YES" for c in chats]

        return backend

    return factory


SAMPLE = "sample_id string, source string, prompt string, gold_label string, split string, meta string"


def test_answers_are_parsed_and_failures_kept(spark, echo):
    df = spark.createDataFrame([(f"s{i}", "D1", "boom" if i == 3 else f"q{i}", "YES", None, None) for i in range(7)], SAMPLE)
    out = {(r["sample_id"], r["policy_id"]): r for r in generation.answer_prompts(df, ["policy_on", "policy_off"], echo, limits=QUICK).collect()}
    assert len(out) == 14 and sum(not r["success"] for r in out.values()) == 2
    assert out["s3", "policy_on"]["error"] == "FatalError: boom" and out["s1", "policy_on"]["parsed_conclusion"] == "YES"
    done = spark.createDataFrame([(k[0], k[1], r["success"]) for k, r in out.items()], "sample_id string, policy_id string, success boolean")
    assert {r["sample_id"] for r in generation.answer_prompts(df, ["policy_on", "policy_off"], echo, done, QUICK).collect()} == {"s3"}


def test_teacher_is_asked_again_until_the_rules_hold(spark, echo):
    rows = [("a", None, "q", "YES", None, None), ("b", None, " ", "YES", None, None), ("c", None, "q", None, None, None), ("d", None, "q", "NO", None, None), ("e", None, "q", None, None, '{"label_int": 1}')]
    out = {r["sample_id"]: r for r in generation.teach(spark.createDataFrame(rows, SAMPLE), echo, limits=QUICK, low=2, high=4).collect()}
    assert (out["a"]["success"], out["a"]["fix_rounds"]) == (True, 1) and out["e"]["success"]
    assert out["b"]["error"] == "empty prompt" and out["c"]["error"] == "missing gold label"
    assert not out["d"]["success"] and out["d"]["fix_rounds"] == 2 and "wrong_conclusion" in out["d"]["violations"]


def test_judge_calls_once_for_equal_pairs(spark, tmp_path):
    log = tmp_path / "calls"

    def factory():
        def backend(chats):
            with log.open("a") as f:
                f.write("x" * len(chats))
            return ['```json\n{"is_regression": true, "severity": "severe"}\n```' if "worse" in c[1]["content"] else "nonsense" for c in chats]

        return backend

    df = spark.createDataFrame([("k1", "p", "a", "worse"), ("k2", "p", "a", "worse"), ("k3", "p", "a", None)], "key string, prompt string, a_parsed_analysis string, b_parsed_analysis string")
    out = {r["key"]: r for r in generation.judge(df, factory, QUICK).collect()}
    assert (out["k1"]["is_harmful"], out["k2"]["severity"], out["k3"]["success"]) == (True, "severe", False)
    assert len(log.read_text()) == 2


@pytest.mark.parametrize("mode", ["classifier", "primary", "validate", "supplement"])
def test_audit_modes_write_their_artifacts(spark, tiny, tmp_path, mode):
    s = config.with_overrides(config.Settings(), [f"run.folder={tmp_path}", f"audit.judge_mode={mode}", "audit.min_slice_n=5"])
    p, c = spark.read.parquet(f"{tiny}/predictions.parquet"), spark.read.parquet(f"{tiny}/score_cache.parquet")
    other = p.agg(F.max(F.when(F.col("model_id") != "M0", F.col("model_id")))).first()[0]
    pairs = pairing.pair_runs(pairing.run(p, "M0"), pairing.run(p, other))
    judged = pairs.select("key", F.pmod(F.xxhash64("key"), F.lit(3)).eqNullSafe(0).alias("is_harmful"), F.lit("severe").alias("severity"), F.lit(True).alias("success"))
    folder = pipeline.run_audit(p, c, "M0", other, s, judged, stamp="x")
    summary = json.loads((folder / "summary.json").read_text())
    n = pairs.count()
    assert summary["regressions"]["n"] == n == sum(summary["by_regression_source"].values())
    assert spark.read.parquet(f"{folder}/regression_pool").count() == summary["regressions"]["n_pool"]
    if mode in ("primary", "validate"):
        assert summary["regressions"]["n_severe"] >= judged.where("is_harmful").count()


def test_command_line(spark, tiny, tmp_path):
    pred = f"{tiny}/predictions.parquet"
    other = spark.read.parquet(pred).agg(F.max(F.when(F.col("model_id") != "M0", F.col("model_id")))).first()[0]
    models = ["--model-a", "M0", "--model-b", other]
    out = cli.main(["evaluate", "--predictions", pred, *models, "--override", f"run.folder={tmp_path}", "--override", "evaluation.n_boot=50", "--override", "evaluation.min_slice_n=5"])
    assert "\\toprule" in open(f"{out}/main_table.tex").read() and len(json.load(open(f"{out}/summary.json"))["bootstrap"]) == 2
    out = cli.main(["train", "--predictions", pred, "--repair", pred, "--override", f"run.folder={tmp_path}"])
    assert spark.read.parquet(f"{out}/examples").where("part = 'val'").count() >= 1
    out = cli.main(["audit", "--predictions", pred, *models, "--cache", f"{tiny}/score_cache.parquet", "--override", f"run.folder={tmp_path}"])
    assert json.load(open(f"{out}/summary.json"))["model_b"] == other

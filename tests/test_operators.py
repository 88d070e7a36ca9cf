import itertools
import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlight.operators import decisions, ingest, pairing, sampling, scoring, stats

NAN = float("nan")
PRED = "delivery_id bigint, received_at bigint, model_id string, base_model string, adapter_path string, sample_id string, policy_id string, prompt string, gold_label string, source string, split string, meta string, raw_text string, parsed_analysis string, parsed_conclusion string, parse_ok boolean, parse_issues array<string>"


def pred(i, t, model, sid, policy=None, gold="YES", concl="YES", ok=True, text="x", prompt="p", source="D1", split="test"):
    return (i, t, model, None, None, sid, policy, prompt, gold, source, split, None, text, text, concl, ok, [])


def test_pairs_take_the_last_row_and_a_fields(spark):
    rows = [pred(1, 1, "A", "s", concl="NO"), pred(2, 5, "A", "s", gold="", prompt=""), pred(3, 1, "B", "s", concl="NO", gold="no", prompt="q"), pred(4, 1, "A", "t"), pred(5, 1, "B", "u")]
    p = spark.createDataFrame(rows, PRED)
    out = pairing.pair_runs(pairing.run(p, "A"), pairing.run(p, "B")).collect()
    assert [(r["key"], r["a_pred"], r["b_pred"], r["gold"], r["prompt"]) for r in out] == [("s|policy_unknown", "YES", "NO", "NO", "q")]
    again = pairing.flat(pairing.nested(pairing.pair_runs(pairing.run(p, "A"), pairing.run(p, "B")))).collect()
    assert [(r["key"], r["a_pred"], r["b_pred"]) for r in again] == [("s|policy_unknown", "YES", "NO")]


def grid(spark):
    """One pair for each gold, prediction and parse combination of both sides, some twice."""
    rows = []
    labels = ("YES", "NO", None)
    for n, (g, pa, oa, pb, ob) in enumerate(itertools.product(labels, labels, (True, False), labels, (True, False))):
        rows += [(f"k{n}", g, pa if oa else None, oa, pb if ob else None, ob, "policy_on" if n % 2 else "policy_unknown", "D1" if n % 3 else None, "descriptive" if n % 3 else None, "test" if n % 5 else None)] * (1 + n % 2)
    return spark.createDataFrame(rows, "key string, gold string, a_pred string, a_parse_ok boolean, b_pred string, b_parse_ok boolean, policy string, source string, grp string, split string"), rows


def same(a, b):
    return (a != a and b != b) or abs(a - b) < 1e-12


def test_audit_and_evaluation_metrics_differ_as_they_should(spark):
    df, rows = grid(spark)
    cells = decisions.both_sides(decisions.contingency(df))
    audit = {(r["slice_name"], r["slice_value"], r["side"]): r for r in decisions.audit_metrics(cells).collect()}
    report = {(r["slice_name"], r["slice_value"], r["side"]): r for r in decisions.evaluation_report(cells).collect()}
    assert set(audit) == set(report) and ("gold", "unknown", "B") in audit
    side = [(r[1], r[4], r[5]) for r in rows]  # gold, pred, ok of B
    r = audit["all", "all", "B"]
    assert r["n"] == len(rows)
    assert r["fp_yes"] == sum(p == "YES" and g != "YES" for g, p, _ in side)
    assert r["tn_yes"] == sum(p != "YES" and g == "NO" for g, p, _ in side)
    assert same(r["acc"], sum(g is not None and g == p for g, p, _ in side) / len(side))
    assert same(r["abstain_rate"], sum(p is None for _, p, _ in side) / len(side))
    e = report["all", "all", "B"]
    known = [(g, p, ok) for g, p, ok in side if g]
    parsed = [(g, p) for g, p, ok in known if ok]
    assert same(e["parse_ok_rate"], len(parsed) / len(known))
    assert same(e["abstain_rate"], sum(p is None for _, p in parsed) / len(parsed))
    tp, fp, fn, tn = (sum(p == x and g == y for g, p in parsed) for x, y in (("YES", "YES"), ("YES", "NO"), ("NO", "YES"), ("NO", "NO")))
    assert same(e["acc_on_parsed"], (tp + tn) / (tp + fp + fn + tn))
    f1 = lambda a, b, c: 2 * a / (2 * a + b + c)
    assert same(e["macro_f1_on_parsed"], (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2)
    assert e["gold_single_class"] is False and report["gold", "YES", "B"]["gold_single_class"] is True


def test_empty_frames_have_no_slices(spark):
    df, _ = grid(spark)
    cells = decisions.contingency(df.limit(0))
    assert decisions.audit_metrics(decisions.both_sides(cells)).count() == 0
    assert decisions.bootstrap(cells).count() == 0


def test_mcnemar_against_the_binomial(spark):
    df, rows = grid(spark)
    r = decisions.mcnemar(decisions.contingency(df, ()), ()).first()
    ok = lambda p, g: p == g
    known = [x for x in rows if x[1]]
    b = sum(ok(x[2], x[1]) and not ok(x[4], x[1]) for x in known)
    c = sum(not ok(x[2], x[1]) and ok(x[4], x[1]) for x in known)
    p = min(1.0, 2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c))
    assert (r["b"], r["c"]) == (b, c) and same(r["p_value"], p)


@pytest.mark.parametrize("n, m", [(173, 83), (2008, 992), (1, 0), (4000, 2000)])
def test_binomial_tail_is_exact(spark, n, m):
    got = spark.range(1).select(decisions.binomial_tail(F.lit(m).cast("bigint"), F.lit(n).cast("bigint"))).first()[0]
    want = sum(math.comb(n, k) for k in range(m + 1)) / 2**n
    assert abs(got - want) < 1e-9 * max(want, 1e-300) + 1e-12


def test_bootstrap_covers_the_observed_delta(spark):
    df, _ = grid(spark)
    cells = decisions.contingency(df, ())
    d = decisions.deltas(cells).first()
    b = {r["metric"]: r for r in decisions.bootstrap(cells, n_boot=500).collect()}
    assert b["accuracy"]["lo"] <= d["delta_acc"] <= b["accuracy"]["hi"]
    assert b["macro_f1"]["lo"] <= d["delta_macro_f1"] <= b["macro_f1"]["hi"]
    assert decisions.bootstrap(cells, n_boot=500).collect() == list(decisions.bootstrap(cells, n_boot=500).collect())


def brute_u(b, a):
    return sum((x > y) + 0.5 * (x == y) for x in b for y in a)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.lists(st.sampled_from([0.0, 0.25, 0.5, 1.0, -3.0]), max_size=12), b=st.lists(st.sampled_from([0.0, 0.25, 0.7, 1.0, 1e12]), max_size=12))
def test_rank_test_against_all_pairs(spark, a, b):
    rows = [("g", "A", x) for x in a] + [("g", "B", x) for x in b] + [("g", "A", NAN), ("g", "B", None)]
    got = stats.rank_test(spark.createDataFrame(rows, "g string, side string, score double"), ["g"]).collect()
    if not a and not b:
        assert not got
        return
    r = got[0]
    assert (r["n_a"], r["n_b"]) == (len(a), len(b))
    assert same(r["u"], brute_u(b, a)) if a and b else math.isnan(r["u"])


def test_ties_only_give_nan_p(spark):
    df = spark.createDataFrame([("g", "A", 1.0), ("g", "B", 1.0)], "g string, side string, score double")
    r = stats.with_p(stats.rank_test(df, ["g"])).first()
    assert r["u"] == 0.5 and math.isnan(r["z"]) and math.isnan(r["p_value"])


def test_summary_matches_statistics(spark):
    random.seed(3)
    x = [random.random() for _ in range(101)]
    df = spark.createDataFrame([("g", v) for v in x] + [("g", NAN), ("g", None), ("one", 2.0)], "g string, value double")
    r = {y["g"]: y for y in stats.summary(df, ["g"]).collect()}
    assert r["g"]["n"] == 101 and same(r["g"]["median"], statistics.median(x)) and abs(r["g"]["stdev"] - statistics.pstdev(x)) < 1e-12
    assert same(r["g"]["q25"], sorted(x)[25]) and r["one"]["stdev"] == 0.0
    assert abs({y["g"]: y for y in stats.summary(df, ["g"], approximate=True).collect()}["g"]["median"] - statistics.median(x)) < 0.02


def test_cache_is_asked_before_the_scorer(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (" ",), (None,)], "text string")
    texts = texts.withColumn("text_hash", F.sha1(F.trim("text")))
    h = {r["text"]: r["text_hash"] for r in texts.collect()}
    cache = spark.createDataFrame([("m", h["a"], 0.1, "2031-01-01"), ("m", h["a"], 0.9, "2031-01-02"), ("m", h["b"], NAN, "2031-01-03"), ("n", h["c"], 0.5, "2031-01-01")], "scorer_id string, text_hash string, score double, created_utc string")
    assert [tuple(r) for r in scoring.cache_hits(texts, cache, "m").collect()] == [(h["a"], 0.9)]
    new = scoring.score_missing(texts.where("length(trim(text)) > 0"), cache, "m", lambda s: s.str.len(), "2031-02-01").collect()
    assert sorted(r["text_hash"] for r in new) == sorted([h["b"], h["c"]])
    again = scoring.score_missing(texts.where("length(trim(text)) > 0"), cache.unionByName(spark.createDataFrame(new)), "m", lambda s: s.str.len(), "2031-02-02")
    assert again.count() == 0


def test_resume_redoes_failures_only_when_asked(spark):
    todo = spark.createDataFrame([("a", "p"), ("b", "p"), ("b", None), ("c", "p")], "s string, p string")
    done = spark.createDataFrame([("a", "p", True), ("b", "p", False), ("b", None, True)], "s string, p string, success boolean")
    assert sorted(r["s"] for r in scoring.resume(todo, done, ["s", "p"]).collect()) == ["c"]
    assert sorted(r["s"] for r in scoring.resume(todo, done, ["s", "p"], reprocess_failed=True).collect()) == ["b", "c"]


def test_split_partitions_every_stratum(spark):
    df = spark.range(997).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("s"), F.lit(None).cast("string").alias("n"))
    out = sampling.stratified_split(df, ["s", "n"], "k").groupBy("s").pivot("new_split", ["train", "val", "test"]).count().collect()
    for r in out:
        n = r["train"] + r["val"] + r["test"]
        assert r["train"] == math.floor(n * 0.8) and r["val"] == math.floor(n * 0.1)
    assert sum(r["train"] + r["val"] + r["test"] for r in out) == 997
    with pytest.raises(ValueError):
        sampling.stratified_split(df, ["s"], "k", (0.5, 0.5, 0.5))


def test_sampling_sizes(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"))
    assert sampling.reservoir(df, 7, "k").count() == 7 and sampling.reservoir(df, 99, "k").count() == 50
    assert {r["c"]: r["count"] for r in sampling.capped(df, "c", 5, "k").groupBy("c").count().collect()} == {0: 5, 1: 5, 2: 5}
    assert sampling.train_val(df, "k", 0.05).where("is_val").count() == 2  # half even of 2.5
    assert sampling.train_val(df, "k", 0.0).where("is_val").count() == 0


def test_training_mix_and_its_compatible_mode(spark):
    ex = lambda rows: spark.createDataFrame(rows, "sample_id string, target string, delivery_id bigint, severity_bin string")
    distill = ex([("a", "t", 1, None), ("a", "t", 2, None), ("b", "t", 3, None)])
    repair = ex([("a", "u", 4, "extreme"), ("c", "u", 5, " Severe "), ("d", "u", 6, "weird"), ("b", "t", 7, "mild")])
    count = lambda df: {r["delivery_id"]: r["count"] for r in df.groupBy("delivery_id").count().collect()}
    assert count(sampling.training_mix(distill, repair, ["delivery_id"])) == {1: 1, 3: 1, 4: 4, 5: 3, 6: 1, 7: 1}
    assert count(sampling.training_mix(distill, repair, ["delivery_id"], compat=True)) == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    assert count(sampling.training_mix(distill, repair, ["delivery_id"], repair_only=True)) == {4: 4, 5: 3, 6: 1, 7: 1}
    assert sampling.parse_repeats("mild=2, severe=x,=3,extreme=0") == {"mild": 2, "": 3, "extreme": 1}


def test_clean_teacher_drops_what_cannot_be_learnt(spark):
    rows = [("a", "p", "T\nConclusion: YES\nrest", "YES", None, True), ("b", "p", "T\nConclusion: NO", "YES", None, True), ("c", "p", "no end", "YES", None, True), ("d", "p", "T\nConclusion: NO", None, "YES", True),
            ("e", " ", "T\nConclusion: NO", None, None, True), ("f", "p", "T\nConclusion: NO", None, None, False), (None, "p", "T\nConclusion: NO", None, None, True)]
    df = spark.createDataFrame(rows, "sample_id string, prompt string, raw_text string, gold_label string, parsed_conclusion string, parse_ok boolean")
    got = {r["sample_id"]: (r["conclusion"], r["target"]) for r in sampling.clean_teacher(df).collect()}
    assert got == {"a": ("YES", "T\nConclusion: YES"), "d": ("YES", "T\nConclusion: NO")}


def test_ingest(spark):
    raw = spark.createDataFrame([("D1", "diff", " q ", "sc1", 1), ("D1", "diff", "q", "sc1", 2), ("D1", "equal", "r", None, 3)], "benchmark_id string, condition string, question string, scenario_id string, o int")
    got = [r["sample_id"] for r in ingest.normalized(raw, ["o"]).orderBy("o").collect()]
    assert got[1] == got[0] + "__1" and got[2].startswith("D1:equal:h")
    with pytest.raises(ValueError, match="repeated"):
        ingest.require_unique(spark.createDataFrame([("x",), ("x",)], "sample_id string"))
    assert ingest.require_unique(spark.createDataFrame([("x",), ("y",)], "sample_id string")).count() == 2
    words = spark.createDataFrame([("city",), ("box",), ("woman",), ("day",), ("old dog",)], "n string")
    assert [r[0] for r in words.select(ingest.plural("n")).collect()] == ["cities", "boxes", "women", "days", "old dogs"]


def test_first_annotation_and_counts(spark):
    cases = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string")
    notes = spark.createDataFrame([(1, "late", 5), (1, "early", 2), (3, "z", 1)], "id int, note string, t int")
    got = {r["id"]: (r["note"], r["n_annotations"]) for r in ingest.first_annotation(cases, notes, "id", ["t"], ["note"]).collect()}
    assert got == {1: ("early", 2), 2: (None, 0)}


def test_row_numbers_equal_a_window(spark):
    from pyspark.sql.window import Window

    from pairlight.cluster import row_numbers

    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("o"), F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise((F.col("id") % 11).cast("string")).alias("k"), F.lit(1).alias("row"))
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("bigint"))
    got = row_numbers(df, ["k"], ["o"], "n")
    assert got.columns == want.columns and got.count() == 500 and got.exceptAll(want).count() == 0
    assert row_numbers(df.limit(0), ["k"], ["o"], "n").count() == 0


@pytest.mark.parametrize("n, m", [(10**6, 499_000), (10**6, 500_000), (10**9, 499_950_000)])
def test_binomial_tail_of_many_is_near_the_normal(spark, n, m):
    got = spark.range(1).select(decisions.binomial_tail(F.lit(m).cast("bigint"), F.lit(n).cast("bigint"))).first()[0]
    z = (m + 0.5 - n / 2) / math.sqrt(n / 4)
    assert abs(got - 0.5 * math.erfc(-z / math.sqrt(2))) < 1e-4 * got + 1e-12


def test_binomial_tail_of_thousands_is_exact(spark):
    got = spark.range(1).select(decisions.binomial_tail(F.lit(2400).cast("bigint"), F.lit(5000).cast("bigint"))).first()[0]
    assert abs(got / (sum(math.comb(5000, k) for k in range(2401)) / 2**5000) - 1) < 1e-12


def test_validation_part_is_exact_for_many_rows(spark):
    df = spark.range(30_000).withColumnRenamed("id", "k")
    out = sampling.train_val(df, "k", 0.3)
    assert out.where("is_val").count() == 9000
    want = {r[0] for r in df.withColumn("o", F.md5(F.concat_ws("|", F.lit("42"), F.col("k").cast("string")))).orderBy("o").limit(9000).select("k").collect()}
    assert {r["k"] for r in out.where("is_val").collect()} == want
    assert sampling.train_val(spark.range(6000).selectExpr("'same' AS k"), "k", 0.1).where("is_val").count() == 6000


def test_quantiles_of_a_group_need_no_task_of_its_own(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, NULL, 'g') AS g", "IF(id = 7, NULL, IF(id = 8, double('nan'), (id * 37 % 1000) / 7.0)) AS value")
    got = {r["g"]: r for r in stats.summary(df, ["g"]).collect()}
    rows = [(r["g"], r["value"]) for r in df.collect() if r["value"] is not None and r["value"] == r["value"]]
    for g in (None, "g"):
        x = sorted(v for k, v in rows if k == g)
        for name, q in (("q05", 0.05), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q95", 0.95)):
            at = q * (len(x) - 1)
            assert abs(got[g][name] - (x[int(at)] + (at - int(at)) * (x[min(int(at) + 1, len(x) - 1)] - x[int(at)]))) < 1e-9
        assert got[g]["n"] == len(x) and abs(got[g]["stdev"] - statistics.pstdev(x)) < 1e-9

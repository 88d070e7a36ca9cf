import math

import pytest
from pyspark.sql import functions as F

from pairlight import compat
from pairlight.functions import answers, labels, regression

NAN = float("nan")


@pytest.mark.parametrize(
    "a, b, severity, triggered",
    [
        (None, 0.9, "none", False), (0.1, NAN, "none", False), (0.9, 0.9, "none", False), (0.05, 0.15, "none", True), (0.5, 0.51, "none", True),
        (0.25, 0.75, "extreme", True), (0.0, 0.45, "severe", True), (0.0, 0.25, "mild", True), (0.5, 0.625, "moderate", True), (0.5, 0.75, "severe", True),
    ],
)
def test_severity_cases(spark, a, b, severity, triggered):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    t = df.select(regression.trigger("a", "b", "v", "m").alias("t")).first()["t"]
    assert (t["severity"], t["triggered"]) == (severity, triggered)


def test_cutoffs_at_exact_values(spark):
    t = regression.Thresholds(mild=0.125, moderate=0.25, severe=0.5, extreme=0.75, floors=False)
    df = spark.createDataFrame([(0.125,), (0.25,), (0.5,), (0.75,), (0.1875,)], "d double")
    got = [r[0] for r in df.select(regression.severity("d", F.lit(1.0), t)).collect()]
    assert got == ["none", "moderate", "severe", "extreme", "mild"]


@pytest.mark.parametrize(
    "text, label, analysis, issues",
    [
        ("A b.\nConclusion: YES", "YES", "A b.", []), ("A.\nconclusion : no\ntrailing", "NO", "A.", []), ("Conclusion: YES", "YES", "", ["empty_analysis"]),
        ("x Conclusion: NO.", "NO", "x", []), ("A\r\nConclusion: YES\r\n", "YES", "A", []), ("nothing", None, "nothing", ["missing_conclusion_line"]),
        ("A\n\nConclusion: YES\nB\nConclusion: NO", "YES", "A", []), ("", None, "", ["empty_output"]), ("  \n", None, "", ["empty_output"]), (None, None, "", ["empty_output"]),
    ],
)
def test_parser_cases(spark, text, label, analysis, issues):
    p = spark.createDataFrame([(text,)], "t string").select(answers.parsed("t").alias("p")).first()["p"]
    assert (p["label"], p["analysis"], p["issues"]) == (label, analysis, issues)
    assert p["parse_ok"] == (label is not None)


def test_sentences_split_at_a_no_break_space(spark):
    df = spark.createDataFrame([("Is it? Yes. No",), ("",), (None,), ("a.b c",)], "t string")
    assert [r[0] for r in df.select(answers.sentence_count("t")).collect()] == [3, 0, 0, 1]
    assert [r[0] for r in df.select(answers.first_sentences("t", 2)).collect()] == ["Is it? Yes.", "", "", "a.b c"]


def test_caps_stops_and_quotes(spark):
    df = spark.createDataFrame([("One. Two. Three.", "p" * 50)], "t string, p string")
    assert df.select(answers.capped("t", 2), answers.capped("t", None, 6), answers.capped("t", 9, 99)).first() == ("One. Two.", "One. T", "One. Two. Three.")
    assert df.select(answers.until_stop("t", ["Two", "One. T"]), answers.until_stop("t", ["", "zz"]), answers.until_stop("t", [])).first() == ("", "One. Two. Three.", "One. Two. Three.")
    assert df.select(answers.quotes_prompt("p", F.lit("x" + "p" * 45)), answers.quotes_prompt("p", F.lit("p" * 39)), answers.quotes_prompt(F.lit(None).cast("string"), "p")).first() == (True, False, False)


def test_conclusions_of_teacher_text(spark):
    rows = [("A\n conclusion : no \nmore",), ("A conclusion: yes inside",), ("nothing",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(answers.conclusion("t")).collect()] == ["NO", "YES", None, None]
    assert [r[0] for r in df.select(answers.until_conclusion("t")).collect()] == ["A\n conclusion : no", "A conclusion: yes inside", "nothing", ""]


def test_labels_groups_and_keys(spark):
    df = spark.createDataFrame([(" diff ", "d1", None), ("EQUAL", " N2", "p"), ("x", "", ""), (None, None, None), ("yes", "BOLD", "p")], "g string, s string, p string")
    assert [r[0] for r in df.select(labels.label("g")).collect()] == ["YES", "NO", None, None, "YES"]
    assert [r[0] for r in df.select(labels.group("s")).collect()] == ["descriptive", "normative", None, None, "external"]
    assert [r[0] for r in df.select(labels.record_key("g", "p")).collect()] == [" diff |policy_unknown", "EQUAL|p", "x|", "|policy_unknown", "yes|p"]


def test_label_from_meta(spark):
    df = spark.createDataFrame([(None, '{"label_int": 1}'), (None, '{"condition": "equal"}'), (None, '{"requires_difference_awareness": true}'), ("NO", '{"label_int": 1}'), (None, "{broken"), (None, None)], "g string, m string")
    assert [r[0] for r in df.select(labels.label_with_meta("g", "m")).collect()] == ["YES", "NO", "YES", "NO", None, None]


def test_judge_replies(spark):
    df = spark.createDataFrame([('```json\n{"is_harmful": true,\n "severity": "SEVERE"}\n```',), ("no json but \"is_regression\":true",), ('{"severity": "awful"}',), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(regression.judge_reply("t")).collect()]
    assert [g[0] for g in got[:3]] == [True, True, False]
    assert [g[1] for g in got] == ["severe", "mild", "none", "none"]
    assert [g[3] for g in got] == [True, False, True, False]


def test_stars_and_division(spark):
    df = spark.createDataFrame([(0.0005,), (0.005,), (0.03,), (0.5,), (NAN,), (None,)], "p double")
    assert [r[0] for r in df.select(regression.stars("p")).collect()] == ["***", "**", "*", "", "", ""]
    r = df.limit(1).select(compat.div_nan(F.lit(1), F.lit(0)), compat.div_zero(F.lit(1), F.lit(0))).first()
    assert math.isnan(r[0]) and r[1] == 0.0


def test_training_features_match_plain_python(spark):
    def plain(p, f, n):
        start = next((i for i in range(len(f) - len(p) + 1) if f[i : i + len(p)] == p), -1)
        b = start + len(p) if start >= 0 else max(0, len(f) - min(128, len(f)))
        r = f[b:]
        if len(f) <= n:
            return f, [-100] * b + r
        if len(r) >= n:
            return r[-n:], r[-n:]
        kept = p[-(n - len(r)) :]
        return kept + r, [-100] * len(kept) + r

    cases = [([1, 2, 3], [1, 2, 3, 4, 5], 8), ([1, 2, 3], [1, 2, 3, 4, 5], 4), ([1, 2], [1, 2, 3, 4, 5, 6, 7], 3), ([9], [1, 2, 3], 8), ([2, 3], [1, 2, 3, 4], 8), ([], [1, 2], 5)]
    for p, f, n in cases:
        df = spark.createDataFrame([(p, f)], "p array<int>, f array<int>")
        x = df.select(answers.training_features("p", "f", n).alias("x")).first()["x"]
        assert (x["input_ids"], x["labels"]) == plain(p, f, n), (p, f, n)


def test_messages_render(spark):
    df = spark.createDataFrame([("q", "policy_on", "a"), (None, None, None)], "p string, y string, t string")
    got = [r[0] for r in df.select(answers.rendered(answers.messages("p", "y", "t"))).collect()]
    assert got[0].startswith("[SYSTEM]\n") and got[0].endswith("[USER]\nPrompt:\nq\n\n[ASSISTANT]\na")
    assert got[1].endswith("[USER]\nPrompt:\n\n\n[ASSISTANT]\n")

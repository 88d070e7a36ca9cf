import random

import pytest
from pyspark.sql import functions as F

from pairlight.llm import mixture

DOC = "doc_id bigint, source string, text string"
TARGET = "source string, target_share double, max_repeats int"


def test_exchange_keeps_mass_and_expectation():
    r = random.Random(1)
    for k in range(500):
        a, b = (k, r.randint(1, 50), r.uniform(0.01, 0.99)), (k + 1000, r.randint(1, 50), r.uniform(0.01, 0.99))
        x, y = mixture.exchange(a, b, "s")
        assert abs(a[1] * a[2] + b[1] * b[2] - x[1] * x[2] - y[1] * y[2]) < 1e-9
        assert mixture.settled(x[2]) or mixture.settled(y[2])
        assert all(-1e-9 <= p <= 1 + 1e-9 for p in (x[2], y[2]))
    mean = sum(mixture.exchange((0, 3, 0.3), (1, 5, 0.6), str(s))[0][2] for s in range(4000)) / 4000
    assert abs(mean - 0.3) < 0.02


def test_plan():
    total, f = mixture.plan({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3})
    assert total == 60 and f == {"a": 0.3, "b": 3.0}
    assert mixture.plan({"a": 100}, {"a": 0.5, "gone": 0.5}, {"a": 1, "gone": 2})[1] == {"a": 1.0, "gone": 0.0}
    assert mixture.plan({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}, 1000)[1] == {"a": 1.0, "b": 3.0}


def rows(n, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice(["big", "big", "big", " BIG", "mid ", "small"]) if r.random() > 0.05 else None
        out.append((i, s, " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(10**6)) for _ in range(r.choice([3, 10, 30, 200])))))
    return out


def test_shares_are_met_within_caps(spark):
    docs = spark.createDataFrame(rows(1500), DOC).repartition(40)
    targets = spark.createDataFrame([("Big", 0.3, 1), ("mid", 0.4, 2), ("small", 0.3, 3)], TARGET)
    out = {r["source"]: r for r in mixture.mixture_shares(docs, targets).collect()}
    for r in out.values():
        assert abs(r["reached_share"] - r["target_share"]) < 0.02 and 0 < r["most_copies"] <= r["max_repeats"]
    assert abs(sum(r["reached_share"] for r in out.values()) - 1) < 1e-9
    m = mixture.mixture(docs, targets)
    assert m.count() == m.select("doc_id").distinct().count()
    assert m.collect() and sorted(m.collect()) == sorted(mixture.mixture(docs, targets).collect())


def test_a_text_counts_once_however_many_documents_hold_it(spark):
    docs = spark.createDataFrame([(i, "a", "the same text") for i in range(50)] + [(100, "a", "another text here"), (101, "b", "more")], DOC)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 9)], TARGET)
    got = {r["doc_id"]: r["copies"] for r in mixture.mixture(docs, targets).collect()}
    assert not [d for d in got if 0 < d < 50] and all(c <= 2 for d, c in got.items() if d != 101) and got[101] <= 9


def test_what_can_fill_nothing(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "a", " \n"), (3, None, "x"), (4, " ", "x"), (5, "a", "x y z"), (6, "other", "t"), (None, "a", "t")], DOC)
    targets = spark.createDataFrame([("a", 0.5, 2), ("none", 0.5, 3), (None, 0.1, 1)], TARGET)
    assert [(r["doc_id"], r["copies"]) for r in mixture.mixture(docs, targets).collect()] == [(5, 2)]
    assert {r["source"]: r["reached_share"] for r in mixture.mixture_shares(docs, targets).where("source is not null").collect()} == {"a": 1.0, "none": 0.0}
    assert mixture.mixture(docs.limit(0), targets).count() == 0
    assert mixture.mixture(docs, targets.limit(0)).count() == 0
    assert docs.select(mixture.source_key(F.lit(" A  b ")).alias("k")).first()["k"] == "a b"


def test_exchange_with_many_keeps_mass_and_expectation():
    r = random.Random(2)
    for k in range(300):
        a = (k, r.randint(50, 900), r.uniform(0.01, 0.99))
        others = [(1000 + i, r.randint(1, 20), r.uniform(0.01, 0.99)) for i in range(r.randint(1, 60))]
        x, ys = mixture.exchange_many(a, others, "s")
        assert abs(a[1] * a[2] + sum(w * p for _, w, p in others) - x[1] * x[2] - sum(w * p for _, w, p in ys)) < 1e-6
        assert mixture.settled(x[2]) or all(mixture.settled(p) for _, _, p in ys)
        assert all(-1e-9 <= p <= 1 + 1e-9 for p in [x[2], *(p for _, _, p in ys)])
    others = [(i, 5, 0.4) for i in range(10)]
    many = [mixture.exchange_many((99, 40, 0.3), others, str(s)) for s in range(4000)]
    assert abs(sum(x[2] for x, _ in many) / 4000 - 0.3) < 0.02 and abs(sum(ys[3][2] for _, ys in many) / 4000 - 0.4) < 0.02


def test_a_text_is_used_by_its_source_factor_whatever_its_size(spark):
    docs = spark.createDataFrame([(i, "a", " ".join(f"w{i}x{j}" for j in range(120 if i % 10 == 0 else 4))) for i in range(400)] + [(1000 + i, "b", f"t{i}") for i in range(30)], DOC)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 9)], TARGET)
    used = {True: 0, False: 0}
    for seed in ("1", "2", "3"):
        for r in mixture.mixture(docs, targets, 2400, seed).where("source = 'a'").collect():
            used[r["doc_id"] % 10 == 0] += r["n_tokens"]
    whole = {k: sum(n for d, n in ((r["doc_id"], r["n_tokens"]) for r in mixture.sized_texts(docs, ["a"]).collect()) if (d % 10 == 0) == k) for k in (True, False)}
    share = sum(used.values()) / sum(whole.values()) / 3
    assert abs(used[True] / whole[True] / 3 - share) < 0.12 and abs(used[False] / whole[False] / 3 - share) < 0.12

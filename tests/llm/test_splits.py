import json
import random

import pytest
from pyspark.sql import functions as F

from pairlight.llm import splits

SCHEMA = "sample_id string, split string, meta string"


def groups(rows):
    """Union-find over the stated relation."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    norm = lambda v: None if v is None or " ".join(str(v).split()).lower() in splits.PLACEHOLDERS else " ".join(str(v).split()).lower()
    for sid, _, meta in rows:
        try:
            m = json.loads(meta) if meta else {}
        except ValueError:
            m = {}
        m = m if isinstance(m, dict) else {}
        a = m.get("author")
        keys = [("w", norm(a.get("id") if isinstance(a, dict) else a)), ("w", norm(m.get("annotator"))), ("e", norm(m.get("entity"))), ("f", norm(m.get("filename")))]
        keys += [("e", norm(x)) for x in m.get("entities") or []]
        b, s = norm(m.get("benchmark_id")), norm(m.get("scenario_id"))
        keys.append(("s", b and s and (b, s)))
        for k in keys:
            if k[1]:
                parent[find(("r", sid))] = find(k)
    out = {}
    for sid, split, _ in rows:
        out.setdefault(find(("r", sid)), []).append((sid, split))
    return list(out.values())


def some_rows(n, seed, hot=0.3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        m = {}
        if r.random() < hot:
            m["author"] = r.choice(["W-7", " w-7 ", {"id": "W-7\xa0"}])
        elif r.random() < 0.5:
            m[r.choice(["author", "annotator"])] = r.choice([f"v{r.randrange(n)}", "unknown", "N/A", "-", None, " Anonymous"])
        if r.random() < 0.2:
            m["entity"] = f"e{r.randrange(n // 2)}"
        if r.random() < 0.1:
            m["entities"] = [f"e{r.randrange(n // 2)}", f"E{r.randrange(n // 2)} "]
        if r.random() < 0.4:
            m |= {"benchmark_id": r.choice(["D1", "d1", "N2", ""]), "scenario_id": f"sc{r.randrange(n)}"}
        rows.append((f"s{i}", r.choice(["train", "train", "val", "test", None]), json.dumps(m)))
    return rows + [("none", "test", None), ("broken", "val", "{oops"), ("list", None, "[1]")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_divided_records(spark, seed):
    rows = some_rows(150, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    want = groups(rows)
    got = {}
    for r in splits.record_components(df).collect():
        got.setdefault(bytes(r["component"]), set()).add(r["sample_id"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(s for s, _ in g) for g in want)
    divided = {s for g in want if len({x for _, x in g if x}) > 1 for s, _ in g}
    assert {r[0] for r in splits.divided_records(df).collect()} == divided


def test_a_long_chain_becomes_one(spark):
    rows = [(f"s{i}", "train" if i else "test", json.dumps({"author": f"a{i}", "entity": f"a{i + 1}", "filename": f"f{i // 2}"})) for i in range(60)]
    rows = [(s, p, m.replace('"entity": "a', '"annotator": "a')) for s, p, m in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert splits.record_components(df).select("component").distinct().count() == 1
    assert splits.divided_records(df).count() == 60


def test_new_splits_keep_groups_and_meet_targets(spark):
    rows = some_rows(1200, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([("train", 0.7), ("val", 0.13), ("test", 0.17)], "split string, target_share double")
    out = splits.assign_splits(df, targets)
    assert out.groupBy("component").agg(F.countDistinct("new_split").alias("n")).where("n > 1").count() == 0
    assert out.count() == len(rows)
    assert out.exceptAll(splits.assign_splits(df.repartition(5), targets)).count() == 0
    shares = {r["split"]: r["reached_share"] for r in splits.split_shares(df, targets).collect()}
    assert abs(shares["train"] - 0.7) < 0.05 and abs(sum(shares.values()) - 1) < 1e-9


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    targets = spark.createDataFrame([("train", 1.0), ("odd", None)], "split string, target_share double")
    assert splits.divided_records(empty).count() == 0
    assert splits.assign_splits(empty, targets).count() == 0
    one = spark.createDataFrame([("a", None, None), (None, "val", None)], SCHEMA)
    assert {r["new_split"] for r in splits.assign_splits(one, targets).collect()} == {"train"}
    with pytest.raises(ValueError):
        splits.assign_splits(one, targets.where("split = 'odd'"))


def test_records_without_keys_bind_nobody(spark):
    rows = [(None, "train", None), (None, "test", '{"author": "unknown"}'), ("twice", "train", None), ("twice", "test", "{}"), ("", "val", None), ("one", "test", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert splits.divided_records(df).count() == 0
    assert splits.record_components(df).select("component").distinct().count() == len(rows)
    related = spark.createDataFrame([(None, "train", '{"author": "a"}'), (None, "test", '{"annotator": " A"}'), ("x", None, '{"author": {"id": "a"}}'), ("y", "test", '{"author": "b"}')], SCHEMA)
    assert sorted(str(r[0]) for r in splits.divided_records(related).collect()) == ["None", "None", "x"]


def test_salted_joins_give_the_same(spark, monkeypatch):
    rows = some_rows(120, 6, hot=0.4)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(r[0] for r in splits.divided_records(df).collect())
    monkeypatch.setattr(splits, "ROWS_A_TASK", 5)
    assert sorted(r[0] for r in splits.divided_records(df).collect()) == want
    parts = {}
    for r in splits.record_components(df).collect():
        parts.setdefault(bytes(r["component"]), set()).add(r["sample_id"])
    assert sorted(map(sorted, parts.values())) == sorted(sorted(s for s, _ in g) for g in groups(rows))


def test_a_record_with_very_many_keys_loses_no_link(spark):
    many = json.dumps({"entities": [f"e{i}" for i in range(3000)]})
    df = spark.createDataFrame([("a", "train", many), ("b", "test", '{"entity": "e2999"}'), ("c", "test", '{"entity": "e1"}')], SCHEMA)
    assert {r[0] for r in splits.divided_records(df).collect()} == {"a", "b", "c"}


def test_one_rule_for_components_of_all_sizes(spark):
    sizes = spark.range(4000).selectExpr("id AS h", "IF(id = 0, 900, 1) AS n")
    shares = {"train": 0.8, "val": 0.1, "test": 0.1}
    total = sizes.selectExpr("sum(n)").first()[0]
    attempt, w = splits.fitted_weights(sizes, shares, "17")
    got = {r[0]: r[1] / total for r in sizes.groupBy(splits._chosen(F.col("h"), w, attempt, "17").alias("s")).agg(F.sum("n")).collect()}
    assert all(abs(got[s] - x) < 0.005 for s, x in shares.items())
    assert splits.fitted_weights(sizes, shares, "17", passes=0) == (0, shares)

from datetime import datetime, timedelta

import pytest

from pairlight.operators import redelivery

SCHEMA = "delivery_id bigint, received_at timestamp, model_id string, sample_id string, policy_id string, raw_text string, delivery bigint"
T = datetime(2031, 1, 1)


def at(n):
    return T + timedelta(seconds=n)


def ids(df):
    return sorted((r[0] for r in df.collect()), key=lambda x: (x is None, x))


def brute(rows):
    """Delivery ids of surplus rows by the stated rule."""
    seen = {}
    for r in rows:
        p = (r[4] or "").strip().lower() or "policy_unknown"
        key = (r[2], None if r[3] is None else r[3].strip(), p)
        seen.setdefault(key, []).append(r)
    out = []
    for group in seen.values():
        group.sort(key=lambda r: (r[1] is not None, r[1] or T, r[0] is not None, r[0] or 0))
        out += [r[0] for r in group[:-1]]
    return sorted(out)


ROWS = [
    (1, at(1), "m", "s1", "policy_on", "a", 0),
    (2, at(2), "m", " s1 ", "POLICY_ON ", "b", 0),
    (3, at(2), "m", "s1", "policy_on", "c", 0),  # tie in time: the greater id stays
    (4, at(1), "m", "s2", None, "a", 0),
    (5, at(3), "m", "s2", "", "a", 0),
    (6, at(2), "m", "s2", "policy_unknown", "a", 0),
    (7, at(9), "n", "s1", "policy_on", "a", 0),
    (8, None, "m", "s3", "p", "a", 0),
    (9, at(1), "m", "s3", "p", "a", 0),
    (10, at(1), None, "s1", "policy_on", "a", 0),
    (11, at(1), "m", None, "p", None, 0),
    (12, at(2), "m", None, "p", None, 0),
    (13, at(2), "m", "", "p", None, 0),
]


def test_surplus_follows_the_rule(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert ids(redelivery.surplus_rows(df)) == brute(ROWS) == [1, 2, 4, 6, 8, 11]


def test_kept_and_surplus_make_up_all(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kept = redelivery.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(ids(kept) + ids(redelivery.surplus_rows(df))) == list(range(1, 14))


@pytest.mark.parametrize("rows_a_salt", [3, 50])
def test_hot_identifier_is_ranked_over_salts(spark, monkeypatch, rows_a_salt):
    monkeypatch.setattr(redelivery, "ROWS_A_SALT", rows_a_salt)
    rows = [(i, at(i % 17), "m", "hot" if i % 3 else f"s{i}", "p", "x", 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ids(redelivery.surplus_rows(df)) == brute(rows)


def test_stored_and_new_equal_everything(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    old, new = df.where("delivery_id % 2 = 0"), df.where("delivery_id % 2 = 1")
    assert ids(redelivery.keep_one(redelivery.keep_one(old), new)) == ids(redelivery.keep_one(df))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert redelivery.surplus_rows(df).count() == 0
    assert redelivery.keep_one(df).count() == 0


def test_rows_that_agree_in_everything_leave_one(spark):
    df = spark.createDataFrame([ROWS[0]] * 3, SCHEMA)
    assert redelivery.keep_one(df).count() == 1


@pytest.mark.parametrize("limit_bytes", [0, 1 << 20])
def test_a_third_of_all_rows_spreads_whether_the_list_is_broadcast_or_not(spark, monkeypatch, limit_bytes):
    monkeypatch.setattr(redelivery, "ROWS_A_SALT", 40)
    rows = [(i, at(i % 17), "m", "hot" if i % 3 == 0 else f"s{i // 2}", "p", "x", 0) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    surplus = redelivery.surplus_rows(df, limit_bytes)
    assert ids(surplus) == brute(rows)
    assert ids(redelivery.keep_one(df, limit_bytes=limit_bytes)) == sorted(set(range(1200)) - set(brute(rows)))


def test_beyond_the_broadcast_rows_move_by_identifier_and_salt(spark, monkeypatch):
    monkeypatch.setattr(redelivery, "ROWS_A_SALT", 1000)
    df = spark.range(60_000).selectExpr(
        "id AS delivery_id", "timestamp_seconds(id) AS received_at", "'m' AS model_id", "IF(id % 3 = 0, 'hot', concat('s', id div 2)) AS sample_id", "'p' AS policy_id", "'x' AS raw_text", "id AS delivery"
    )
    keys = list(redelivery.message_keys(df))
    rows = df.select(*[c.alias(n) for n, c in redelivery.message_keys(df).items()], "received_at", "delivery_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, repeated, heavy = redelivery._split(rows, keys, 0)
        plan = repeated._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert heavy
    moves = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert sum("__salt" in x for x in moves) >= 2  # both sides of the join
    sizes = [r[0] for r in repeated.where("__sample = '=hot'").groupBy("__salt").count().select("count").collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 20 and max(sizes) < 1500
    assert redelivery.surplus_rows(df, 0).count() == 60_000 - df.select("sample_id").distinct().count()

"""Every query with SQL against DuckDB on the smallest test data."""

import math
import os
from collections import Counter

import duckdb

import __spark_entry__ as entry


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 7) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def test_queries_agree_with_sql(spark, tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(tiny):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{tiny}/{name}'")
    queries, bad = entry.queries(), []
    for name, sql in entry.oracle_sql().items():
        df = queries[name](spark, tiny)
        cols = sorted(df.columns)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        want = Counter(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall()) if sorted(names) == cols else None
        if Counter(repr([plain(x) for x in r]) for r in df.select(*cols).collect()) != want:
            bad.append(name)
    assert not bad


def test_entry_has_rows(spark, tiny):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

import random

import pytest

from pairlight.llm import overlap

SCHEMA = "sample_id string, source string, split string, prompt string"


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def brute(rows):
    words = [(r[0], r[2], overlap.words_of(r[3]).split()) for r in rows]
    out = set()
    for a, sa, wa in words:
        for b, sb, wb in words:
            if sa == "train" and sb in ("val", "test") and wa and wb and distance(wa, wb) <= max(len(wa), len(wb)) // 8:
                out.add((min(a, b), max(a, b)))
    return out


def found(spark, rows):
    got = [tuple(r) for r in overlap.found_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def changed(r, words, vocabulary):
    w = list(words)
    for _ in range(r.randint(0, len(w) // 7 + 1)):
        k = r.randrange(len(w) + 1)
        way = r.randrange(3)
        if way == 0:
            w.insert(k, r.choice(vocabulary))
        elif w and way == 1:
            del w[min(k, len(w) - 1)]
        elif w:
            w[min(k, len(w) - 1)] = r.choice(vocabulary)
    return w


def some_rows(seed, n=160, vocabulary=60, templates=3):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(vocabulary)]
    stock = [[r.choice(v[:12]) for _ in range(r.randint(10, 30))] for _ in range(templates)]
    base = [[r.choice(v) for _ in range(r.choice([1, 3, 6, 7, 8, 9, 15, 16, 24, 40, 57]))] for _ in range(n // 4)]
    base = [b if r.random() < 0.5 else (lambda t: t[: len(t) // 2] + b[:2] + t[len(t) // 2 :])(r.choice(stock)) for b in base]
    rows = []
    for i in range(n):
        w = changed(r, r.choice(base), v)
        rows.append((f"s{i:04d}", "S", r.choice(["train", "train", "val", "test", None]), r.choice([" ", "  ", ", "]).join(x.upper() if r.random() < 0.2 else x for x in w)))
    return rows + [("e1", "S", "train", ""), ("e2", "S", "val", "…!"), ("e3", "S", "val", None), ("e4", None, "test", " ")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_pairs_are_found(spark, seed):
    rows = some_rows(seed)
    want = brute(rows)
    assert want and found(spark, rows) == want


@pytest.mark.parametrize("cell, many", [(3, 64), (20_000, 0), (5, 0)])
def test_hot_spans_lose_nothing(spark, monkeypatch, cell, many):
    """Salted cells, and every interval treated as shared by too many."""
    monkeypatch.setattr(overlap, "CELL", cell)
    monkeypatch.setattr(overlap, "PAIRS_A_ROW", many)
    rows = some_rows(7, n=120, vocabulary=25, templates=2)
    assert found(spark, rows) == brute(rows)


def test_within_is_the_edit_distance():
    r = random.Random(5)
    for _ in range(4000):
        a = [r.choice("abc") for _ in range(r.randint(0, 12))]
        b = [r.choice("abc") for _ in range(r.randint(0, 12))]
        k = r.randint(0, 6)
        assert overlap.within(a, b, k) == (distance(a, b) <= k)


def test_what_does_not_count():
    assert overlap.words_of("Ｃafé  ​NA‍ïVE—x1\xadb, ﬁn!") == "cafe naive x1b fin"
    assert overlap.words_of("plain\x00 ASCII_text\t9") == "plain ascii text 9"
    assert overlap.words_of(None) == overlap.words_of("…!") == ""


def test_copies_report_and_coverage(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(f"t{i}", "d1 ", "train", text) for i in range(3)] + [("v1", "D1", "val", text), ("v2", None, "test", text.replace("three", "drei")), ("v3", "D1", "val", "nothing in common here at all my friend of old")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(found(spark, rows)) == 6
    rep = {(r["split"], r["source"]): (r["n_records"], r["n_overlapping"], r["n_pairs"]) for r in overlap.overlap_report(df).collect()}
    assert rep == {("val", "D1"): (2, 1, 3), ("test", "unknown"): (1, 1, 3)}
    cover = {r["sample_id"]: (r["n_words"], r["n_covered"]) for r in overlap.span_coverage(df).collect()}
    assert cover["v1"] == (10, 10) and cover["v3"] == (10, 0) and 5 <= cover["v2"][1] < 10


def test_empty_table_and_long_text(spark):
    assert overlap.found_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    long = [f"x{i}" for i in range(3000)]
    rows = [("a", "S", "train", " ".join(long)), ("b", "S", "test", " ".join(long[:1000] + ["y"] * 200 + long[1200:])), ("c", "S", "test", " ".join(long[:1500]))]
    assert found(spark, rows) == {("a", "b")}


def test_a_hot_head_of_one_side_is_never_written(spark, monkeypatch):
    monkeypatch.setattr(overlap, "CELL", 50)
    rows = [(f"t{i}", "S", "train", f"once upon a time there was a king {i} of land {i * 7}") for i in range(400)]
    rows += [("e1", "S", "test", "another text of the other side with nothing like it"), ("e2", "S", "val", "prefix word once upon a time there was a king 5 of land 35")]
    df = spark.createDataFrame(rows[:-1], SCHEMA)
    cls = overlap.cut(overlap.classes(overlap.cut(overlap.records(df))))
    assert overlap.shared_spans(cls).count() == 0
    few = overlap._head_table(cls.mapInArrow(overlap._head_counts, "head bigint, nt bigint, ne bigint"))
    assert not few.any()
    assert found(spark, rows) == brute(rows)


def test_links_count_pairs_without_writing_them(spark):
    rows = some_rows(11, n=140)
    pairs = brute(rows)
    links = {r["sample_id"]: (r["class_id"], r["n_links"]) for r in overlap.record_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    words = {r[0]: overlap.words_of(r[3]) for r in rows}
    assert set(links) == {r[0] for r in rows if r[2] and words[r[0]]}
    for i, (_, n) in links.items():
        assert n == sum(i in p for p in pairs)
    assert len({c for c, _ in links.values()}) == len({words[i] for i in links})

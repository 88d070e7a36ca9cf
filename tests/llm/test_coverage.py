"""span_coverage against brute force over all shared runs of words."""

import random

from pairlight.llm import overlap
from test_overlap import SCHEMA, some_rows


def brute(rows):
    words = [(r[0], r[2], overlap.words_of(r[3]).split()) for r in rows]
    train = [w for _, s, w in words if s == "train"]
    m = overlap.SPAN_WORDS
    out = {}
    for key, s, w in words:
        if s not in ("val", "test") or not w:
            continue
        on = set(range(len(w))) if w in train else set()
        for i in range(len(w)):
            for t in train:
                for j in range(len(t)):
                    n = 0
                    while i + n < len(w) and j + n < len(t) and w[i + n] == t[j + n]:
                        n += 1
                    on |= set(range(i, i + n)) if n >= m else set()
        out[key] = (len(w), len(on))
    return out


def covered(spark, rows):
    return {r["sample_id"]: (r["n_words"], r["n_covered"]) for r in overlap.span_coverage(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_runs_anywhere_are_covered_whole(spark):
    text = [f"w{i}" for i in range(14)]
    long = [f"x{i}" for i in range(60)]
    rows = [
        ("t1", "S", "train", " ".join(text)), ("t2", "S", "train", " ".join(long)), ("t3", "S", "train", "five small words stand here"), ("t4", "S", "train", "one two"),
        ("v1", "S", "val", " ".join(["a", "b", *text[1:8], "c"])), ("v2", "S", "val", " ".join(["a", *long[4:15], "b"])), ("v3", "S", "test", "in it five small words stand here again"),
        ("v4", "S", "test", "one two"), ("v5", "S", "test", "one two three"), ("v6", "S", "val", " ".join(["a", *long[1:41], "b", *long[30:59]])),
    ]
    got = covered(spark, rows)
    assert got == {"v1": (10, 7), "v2": (13, 11), "v3": (8, 5), "v4": (2, 2), "v5": (3, 0), "v6": (71, 69)} == brute(rows)


def test_coverage_is_that_of_brute_force(spark):
    rows = some_rows(11, n=80, vocabulary=40)
    random.Random(3).shuffle(rows)
    assert covered(spark, rows) == brute(rows)

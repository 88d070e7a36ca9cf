"""Records of evaluation splits that stand, exactly or almost, in the training split.

The texts are taken as word sequences; equal sequences form one class, and all
work is done on classes. The concatenated class texts are cut into suffixes,
partitioned by their first words and sorted, so that each partition is a piece
of one suffix array over words. Longest common prefixes of adjacent suffixes
bound the intervals in which a span is shared; intervals with suffixes of both
sides reveal shared spans, and the spans give candidates, which an edit
distance confirms.

No pair is lost: a text of L words that is at most k = floor(longest/8) word
edits away from another is cut into floor(L/7)+1 pieces, and at least one piece
stands unchanged in the other text, moved by at most k words. Training texts
therefore enter the suffix array at the starts of their pieces, evaluation texts
at every position, and a common prefix as long as the piece is a hit.

Heads (the first three words of a suffix) that occur on one side only can reveal
nothing; they are counted first and their suffixes are never written or moved.
A head with more suffixes than a task should hold is divided into the intervals
of the pieces that begin with it, so that no cell is unbounded and none is
repeated more than its smaller side is long.

Spans that many records share (templates) would give too many pairs. Their
intervals only mark the records, and marked records meet again through their
rarest words: of two such texts, the k+l rarest words of each share at least l.
l grows from 1 to 3 for words that are themselves shared by many.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.cluster import broadcast_if_small, cut, salted, spread

#: One word edit is allowed in so many words of the longer text.
WORDS_AN_EDIT = 8
#: Words of a suffix that the array compares; no piece is longer.
DEPTH = 7
#: Words of the shortest run that counts as covered; no shorter piece ever did.
SPAN_WORDS = 3
#: Suffixes of one side that a sorted cell may hold; heads with more are divided.
CELL = 20_000
#: Bits of the table of heads that occur on both sides (8 MB, whatever the corpus); a full table only filters less.
HEAD_BITS = 1 << 26
#: An interval or word is written out as pairs while these are at most so many a row.
PAIRS_A_ROW = 64
#: Counters of the word frequency table that orders words by rarity (1 MB, whatever the corpus).
FREQUENCY_SLOTS = 1 << 18
#: Texts with more words than this meet through one rare word only, however often it occurs.
LONG_WORDS = 200

_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = regex.compile(r"[\p{L}\p{N}\p{Mc}]+")
_UNSEEN = regex.compile(r"[\p{Cf}\p{Cc}\p{Mn}\p{Me}\u115f\u1160\u3164\uffa0--\s]", regex.V1)


def words_of(text: str | None) -> str:
    """The words of a text joined by single blanks; '' without words.

    Case, accents, compatibility forms, punctuation, white space and invisible
    characters do not count.
    """
    if not text:
        return ""
    if text.isascii():
        return " ".join(_ASCII_WORD.findall(_UNSEEN.sub("", text).lower() if not text.isprintable() else text.lower()))
    t = unicodedata.normalize("NFKD", text)
    t = unicodedata.normalize("NFKD", _UNSEEN.sub("", t).casefold())
    return " ".join(_WORD.findall(_UNSEEN.sub("", t)))


def within(a: list[str], b: list[str], k: int) -> bool:
    """Whether at most k words must be inserted, deleted or replaced.

    Follows the furthest point of each diagonal, so it costs about k * k steps
    besides the comparison of equal words.
    """
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False

    def slide(i: int, j: int) -> int:
        while i < n and j < m and a[i] == b[j]:
            i += 1
            j += 1
        return i

    far = {0: slide(0, 0)}
    if n == m and far[0] == n:
        return True
    for e in range(1, k + 1):
        new = {}
        for d in range(-e, e + 1):
            i = max(far.get(d, -2) + 1, far.get(d - 1, -2) + 1, far.get(d + 1, -2))
            i = min(i, n, m + d)
            if i < 0 or i - d < 0:
                continue
            new[d] = slide(i, i - d)
        far = new
        if far.get(n - m, -1) >= n:
            return True
    return False


def allowed(n_a: int, n_b: int) -> int:
    """Word edits allowed between texts of n_a and n_b words."""
    return max(n_a, n_b) // WORDS_AN_EDIT


# ---- classes ----


def records(samples: DataFrame) -> DataFrame:
    """Records that can form pairs, with side, words and class keys."""

    @F.pandas_udf("string")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(words_of)

    words = words.asNondeterministic()
    side = F.when(F.col("split") == "train", F.lit(True)).when(F.col("split").isin("val", "test"), F.lit(False))
    return (
        spread(samples.select("sample_id", "source", "split", side.alias("train"), F.col("prompt")))
        .where(F.col("train").isNotNull())
        .select("sample_id", "source", "split", "train", words("prompt").alias("words"))
        .where(F.col("words") != "")
        .withColumns({"c1": F.xxhash64("words"), "c2": F.xxhash64(F.lit("second"), "words")})
    )


def classes(recs: DataFrame) -> DataFrame:
    """The different word sequences: number, words, and how many records of either side have them."""
    return recs.groupBy("c1", "c2").agg(F.min("words").alias("words"), F.count_if(F.col("train")).alias("n_train"), F.count_if(~F.col("train")).alias("n_eval")).withColumn("cid", F.monotonically_increasing_id())


# ---- suffix array ----

_CODES: dict[str, int] = {}


def _codes(words: list[str]) -> list[int]:
    if len(_CODES) > 300_000:
        _CODES.clear()
    out = []
    for w in words:
        c = _CODES.get(w)
        if c is None:
            c = _CODES[w] = zlib.crc32(w.encode()) or 1
        out.append(c)
    return out


def sketch(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each text's words; k word edits change at most 2k of them."""
    bit = (codes ^ (codes >> np.uint32(13))) & np.uint32(127)
    one = np.uint64(1) << (bit & np.uint32(63)).astype(np.uint64)
    high = bit > 63
    fold = lambda x: np.bitwise_xor.reduceat(x, starts).view(np.int64)
    return fold(np.where(high, np.uint64(0), one)), fold(np.where(high, one, np.uint64(0)))


#: Suffixes: first words as numbers, two in a long; side, length of the piece, position and words of the text in ``meta``.
KEY = ("k1", "k2", "k3", "k4")
SUFFIX = "head bigint, k1 bigint, k2 bigint, k3 bigint, k4 bigint, meta bigint, cid bigint, s1 bigint, s2 bigint"
_TRAIN, _PIECE, _POS, _LOW = 60, 56, 28, (1 << 28) - 1


def _positions(b: pa.RecordBatch) -> dict[str, np.ndarray] | None:
    """All suffixes of a batch of classes that enter the array."""
    texts = [w.split(" ") for w in b.column("words").to_pylist()]
    keep = [i for i, w in enumerate(texts) if len(w) >= DEPTH]
    if not keep:
        return None
    col = {c: b.column(c).to_numpy(zero_copy_only=False)[keep] for c in ("cid", "n_train", "n_eval")}
    n = np.array([len(texts[i]) for i in keep])
    flat = np.array([c for i in keep for c in _codes(texts[i])], dtype=np.uint32)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    s1, s2 = sketch(flat, start)
    padded = np.zeros(len(flat) + DEPTH * len(keep), dtype=np.uint64)
    at = start + np.arange(len(keep)) * DEPTH  # where each text begins in padded
    padded[np.repeat(at - start, n) + np.arange(len(flat))] = flat
    ev = np.flatnonzero(col["n_eval"])
    counts = n[ev] - 2
    tr = np.flatnonzero(col["n_train"])
    parts = n[tr] // (WORDS_AN_EDIT - 1) + 1
    own = np.repeat(tr, parts)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    p = np.repeat(parts, parts)
    lo, hi = k * n[own] // p, (k + 1) * n[own] // p
    owner = np.concatenate([np.repeat(ev, counts), own])
    pos = np.concatenate([np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts), lo])
    piece = np.concatenate([np.zeros(counts.sum(), dtype=int), hi - lo])
    train = np.arange(len(owner)) >= counts.sum()
    first = at[owner] + pos
    w = [padded[first + j] for j in range(3)]
    head = (w[0] << np.uint64(32)) ^ (w[1] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[2] * np.uint64(0xC2B2AE3D27D4EB4F))
    return {"head": head, "first": first, "padded": padded, "owner": owner, "pos": pos, "piece": piece, "train": train, "n": n, "cid": col["cid"], "s1": s1, "s2": s2}


def _head_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if (x := _positions(b)) is not None:
            heads, inverse = np.unique(x["head"], return_inverse=True)
            nt = np.bincount(inverse, weights=x["train"], minlength=len(heads)).astype(np.int64)
            ne = np.bincount(inverse, minlength=len(heads)).astype(np.int64) - nt
            yield pa.RecordBatch.from_arrays([pa.array(heads.view(np.int64)), pa.array(nt), pa.array(ne)], names=["head", "nt", "ne"])


def _suffixes(table):
    """Writes the suffixes whose head the table (broadcast) knows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for b in batches:
            if (x := _positions(b)) is None:
                continue
            slot = x["head"] & np.uint64(len(bits) * 64 - 1)
            use = np.flatnonzero((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
            for i in range(0, len(use), 50_000):
                u = use[i : i + 50_000]
                o, first, padded = x["owner"][u], x["first"][u], x["padded"]
                w = [padded[first + j] for j in range(DEPTH)] + [np.zeros(len(u), np.uint64)]
                keys = [((w[2 * j] << np.uint64(32)) | w[2 * j + 1]).view(np.int64) for j in range(4)]
                meta = (x["train"][u].astype(np.int64) << _TRAIN) | (x["piece"][u].astype(np.int64) << _PIECE) | (x["pos"][u].astype(np.int64) << _POS) | x["n"][o].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x["head"][u].view(np.int64), *keys, meta, x["cid"][o], x["s1"][o], x["s2"][o])], names=["head", *KEY, "meta", "cid", "s1", "s2"])

    return emit


#: kind 0: candidate pair (training class, evaluation class); 1: marked class, in t.
HIT = "kind int, train boolean, t bigint, e bigint"


def close(n_a, n_b, s1_a, s1_b, s2_a, s2_b):
    """What any pair within the allowed edits fulfils: lengths and sketches."""
    k = np.maximum(n_a, n_b) // WORDS_AN_EDIT
    # counted as unsigned: of a negative number numpy counts the bits of its magnitude
    bits = lambda x, y: np.bitwise_count(np.asarray(x ^ y).astype(np.uint64)).astype(int)
    return (np.abs(n_a - n_b) <= k) & (bits(s1_a, s1_b) + bits(s2_a, s2_b) <= 2 * k)


def _hits(buf: dict[str, np.ndarray], pairs_a_row: int) -> Iterator[pa.RecordBatch]:
    """Hits of whole cells whose suffixes are sorted."""
    cell, meta, cid = buf["cell"], buf["meta"], buf["cid"]
    if not len(cell):
        return
    half = np.uint64(32)
    halves = lambda x: (x >> half, x & np.uint64(0xFFFFFFFF))
    key = np.stack([h for k in KEY for h in halves(buf[k].view(np.uint64))][:DEPTH], axis=1)
    same = np.logical_and.accumulate(key[1:] == key[:-1], axis=1) & (cell[1:] == cell[:-1])[:, None]
    lcp = np.concatenate([[0], same.sum(axis=1)])
    train, piece, pos, n = (meta >> _TRAIN) > 0, (meta >> _PIECE) & 15, (meta >> _POS) & _LOW, meta & _LOW
    evals = np.flatnonzero(~train)
    marked = []
    for s in np.unique(piece[train]):
        group = np.cumsum(lcp < s)
        rows = np.flatnonzero(train & (piece == s))
        size = group[-1] + 1
        nt, ne = np.bincount(group[rows], minlength=size), np.bincount(group[evals], minlength=size)
        both = (nt > 0) & (ne > 0)
        many = both & (nt * ne > pairs_a_row * (nt + ne))
        few = both & ~many
        marked += [rows[many[group[rows]]], evals[many[group[evals]]]]
        first = np.searchsorted(group[evals], np.arange(size))  # evaluation suffixes of a group are neighbours
        rows = rows[few[group[rows]]]
        total = np.cumsum(ne[group[rows]])
        begin = 0
        while begin < len(rows):  # about two million pairs at a time
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + 2_000_000, "right")))
            r = rows[begin:end]
            c = ne[group[r]]
            t = np.repeat(r, c)
            e = evals[np.repeat(first[group[r]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
            ok = np.abs(pos[t] - pos[e]) <= np.maximum(n[t], n[e]) // WORDS_AN_EDIT
            t, e = t[ok], e[ok]
            ok = close(n[t], n[e], buf["s1"][t], buf["s1"][e], buf["s2"][t], buf["s2"][e]) & (cid[t] != cid[e])
            t, e = t[ok], e[ok]
            if len(t):
                yield _hit_batch(0, np.ones(len(t), bool), cid[t], cid[e])
            begin = end
    if marked and len(m := np.unique(np.concatenate(marked))):
        both = np.unique(np.stack([train[m].astype(np.int64), cid[m]], axis=1), axis=0)
        yield _hit_batch(1, both[:, 0].astype(bool), both[:, 1], None)


def _hit_batch(kind, train, t, e) -> pa.RecordBatch:
    n = len(train)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(train), pa.array(t, pa.int64()), pa.nulls(n, pa.int64()) if e is None else pa.array(e, pa.int64())], names=["kind", "train", "t", "e"])


def _cells(cell: int, pairs_a_row: int):
    """Reader of a sorted partition: gathers whole cells, a few ten thousand suffixes at a time."""
    names = ("cell", *KEY, "meta", "cid", "s1", "s2")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            part = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            held.append(part)
            rows += b.num_rows
            if rows >= 2 * cell and held[0]["cell"][0] != part["cell"][-1]:
                whole = {c: np.concatenate([h[c] for h in held]) for c in names}
                cut_at = int(np.flatnonzero(whole["cell"] != whole["cell"][-1])[-1]) + 1
                yield from _hits({c: v[:cut_at] for c, v in whole.items()}, pairs_a_row)
                held = [{c: v[cut_at:] for c, v in whole.items()}]
                rows = len(held[0]["cell"])
        if held:
            yield from _hits({c: np.concatenate([h[c] for h in held]) for c in names}, pairs_a_row)

    return read


def _head_table(kept: DataFrame) -> np.ndarray:
    """One bit for each head that occurs on both sides, by its last bits; of fixed size."""
    slot = F.col("head").bitwiseAND(F.lit(HEAD_BITS - 1))
    words = kept.where("nt > 0 and ne > 0").groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(head & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(HEAD_BITS // 64, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _divided(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and marked classes of suffixes whose head has too many of them.

    Each interval of a piece is a cell of its own: a training suffix goes to the
    interval of its piece, an evaluation suffix to one for each length of pieces.
    Intervals of one side are dropped, those with too many pairs only mark their
    classes; of any other, one side is small and is repeated for the salts of the
    other.
    """
    train = F.shiftright("meta", _TRAIN) > 0
    piece = F.shiftright("meta", _PIECE).bitwiseAND(F.lit(15)).cast("int")
    rows = rows.withColumn("s", F.explode(F.when(train, F.array(piece)).otherwise(F.array(*[F.lit(k) for k in range(3, DEPTH + 1)]))))
    s, high = F.col("s"), lambda k: F.shiftright(k, 32)
    first = (F.when(s >= 4, F.col("k2")).otherwise(high("k2")), F.when(s >= 6, F.col("k3")).when(s == 5, high("k3")).otherwise(F.lit(0)), F.when(s >= 7, F.col("k4")).otherwise(F.lit(0)))
    rows = rows.withColumn("cell", F.xxhash64("s", "k1", *first)).drop("s", "head")
    sizes = rows.groupBy("cell").agg(F.count_if(train).alias("nt"), F.count_if(~train).alias("ne")).where("nt > 0 and ne > 0")
    sizes = cut(sizes.withColumns({"n": F.col("nt") + F.col("ne"), "many": F.col("nt") * F.col("ne") > PAIRS_A_ROW * (F.col("nt") + F.col("ne"))}))
    mine, known, _ = salted(rows, sizes, ["cell"], "n", ["cid", "meta"], row_bytes=48)
    met = cut(mine.join(known.drop("n"), ["cell", "__salt"]))
    marked = met.where("many").select(F.lit(1).alias("kind"), train.alias("train"), F.col("cid").alias("t"), F.lit(None).cast("bigint").alias("e")).distinct()
    rt, re = F.ceil(F.col("nt") / CELL).cast("int"), F.ceil(F.col("ne") / CELL).cast("int")
    mine = F.pmod(F.xxhash64("cid", "meta"), F.when(train, rt).otherwise(re)).cast("int")
    few = met.where("not many").withColumn("o", F.explode(F.sequence(F.lit(0), F.when(train, re).otherwise(rt) - 1)))
    cell = F.xxhash64("cell", F.when(train, mine).otherwise(F.col("o")), F.when(train, F.col("o")).otherwise(mine))
    return few.withColumn("cell", cell).select("cell", *KEY, "meta", "cid", "s1", "s2"), marked


def shared_spans(cls: DataFrame) -> DataFrame:
    """Hits of the suffix array (see HIT)."""
    texts = cls.select("cid", "words", "n_train", "n_eval")
    heads = texts.mapInArrow(_head_counts, "head bigint, nt bigint, ne bigint").groupBy("head").agg(F.sum("nt").alias("nt"), F.sum("ne").alias("ne"))
    hot = (F.col("nt") > CELL) | (F.col("ne") > CELL)
    kept = cut(heads.where((F.col("nt") > 0) & (F.col("ne") > 0) | hot))
    table = cls.sparkSession.sparkContext.broadcast(_head_table(kept))
    suffixes = texts.mapInArrow(_suffixes(table), SUFFIX)
    large = kept.where(hot).select("head", ((F.col("nt") > 0) & (F.col("ne") > 0)).alias("both"))
    marked = None
    if large.isEmpty():
        placed = suffixes.withColumnRenamed("head", "cell")
    else:
        known = suffixes.join(broadcast_if_small(large, 24), "head", "left")
        few, marked = _divided(known.where("both").drop("both"))
        placed = known.where("both is null").drop("both").withColumnRenamed("head", "cell").unionByName(few)
    hits = placed.repartition("cell").sortWithinPartitions("cell", *KEY).mapInArrow(_cells(CELL, PAIRS_A_ROW), HIT)
    return hits if marked is None else hits.unionByName(marked)


# ---- records that only share what many share ----

RARE = "key bigint, train boolean, n int, cid bigint, s1 bigint, s2 bigint"


def _frequencies(cls: DataFrame) -> np.ndarray:
    slot = F.pmod(F.xxhash64("w"), F.lit(FREQUENCY_SLOTS)).cast("int")
    rows = cls.select(F.explode(F.split("words", " ")).alias("w")).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(FREQUENCY_SLOTS, dtype=np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _rare_keys(level: int, frequency):
    """Emits, for each marked text, its keys of ``level`` words out of its rarest."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequency.value
        for b in batches:
            if not b.num_rows:
                continue
            slots = b.column("slots").to_pylist()
            texts = [w.split(" ") for w in b.column("words").to_pylist()]
            n = np.array([len(t) for t in texts])
            flat = np.array([c for t in texts for c in _codes(t)], dtype=np.uint32)
            s1, s2 = sketch(flat, np.concatenate([[0], np.cumsum(n)[:-1]]))
            who, keys = [], []
            for i, (t, sl) in enumerate(zip(texts, slots)):
                seen: dict[str, int] = {}
                order = []
                for w, f in zip(t, table[np.array(sl)].tolist()):
                    seen[w] = seen.get(w, 0) + 1
                    order.append((f, w, seen[w]))
                order.sort()
                rare = order[: len(t) // (WORDS_AN_EDIT - 1) + level]
                own = [hash_key("|".join(f"{w}#{o}" for _, w, o in c)) for c in combinations(rare, level)]
                keys += own
                who += [i] * len(own)
            who = np.array(who, dtype=int)
            take = lambda c: pa.array(b.column(c).to_numpy(zero_copy_only=False)[who])
            for j in range(0, len(who), 50_000):
                o = slice(j, j + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[o], pa.int64()), take("train")[o], pa.array(n[who][o].astype(np.int32)), take("cid")[o], pa.array(s1[who][o]), pa.array(s2[who][o])], names=["key", "train", "n", "cid", "s1", "s2"])

    return emit


def hash_key(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _meet(keys: DataFrame, extra=None) -> DataFrame:
    """Pairs of a training and an evaluation class with a key in common that can be close."""
    t = keys.where("train").select("key", *[F.col(c).alias(f"t_{c}") for c in ("n", "cid", "s1", "s2")])
    e = keys.where("not train").select("key", *[F.col(c).alias(f"e_{c}") for c in ("n", "cid", "s1", "s2")])
    k = F.floor(F.greatest("t_n", "e_n") / WORDS_AN_EDIT)
    near = (F.abs(F.col("t_n") - F.col("e_n")) <= k) & (F.bit_count(F.col("t_s1").bitwiseXOR(F.col("e_s1"))) + F.bit_count(F.col("t_s2").bitwiseXOR(F.col("e_s2"))) <= 2 * k)
    near &= F.col("t_cid") != F.col("e_cid")
    if extra is not None:
        near &= extra
    return t.join(e, (t["key"] == e["key"]) & near).select(F.col("t_cid").alias("t"), F.col("e_cid").alias("e")).distinct()


def _marked_pairs(marked: DataFrame, cls: DataFrame) -> DataFrame:
    """Candidates among the marked classes, through their rarest words."""
    spark = cls.sparkSession
    frequency = spark.sparkContext.broadcast(_frequencies(cls))
    slots = F.transform(F.split("words", " "), lambda w: F.pmod(F.xxhash64(w), F.lit(FREQUENCY_SLOTS)).cast("int"))
    left = cut(cls.select("cid", "words").join(broadcast_if_small(cut(marked), 24), "cid").select("cid", "train", "words", slots.alias("slots")))
    found = []
    for level in (1, 2, 3):
        keys = cut(left.mapInArrow(_rare_keys(level, frequency), RARE))
        if level == 3:
            found.append(_meet(keys))
            break
        sizes = keys.groupBy("key").agg(F.count_if(F.col("train")).alias("nt"), F.count_if(~F.col("train")).alias("ne")).where((F.col("nt") > 0) & (F.col("ne") > 0))
        many = F.col("nt") * F.col("ne") > PAIRS_A_ROW * (F.col("nt") + F.col("ne"))
        mine, known, _ = salted(keys, cut(sizes.select("key", many.alias("many"), (F.col("nt") + F.col("ne")).alias("all"))), ["key"], "all", ["cid"], row_bytes=24)
        sized = cut(mine.join(known.drop("all"), ["key", "__salt"]).drop("__salt"))
        found.append(_meet(sized.where(~F.col("many"))))
        often = sized.where("many")
        if level == 1:
            found.append(_meet(often, (F.col("t_n") > LONG_WORDS) | (F.col("e_n") > LONG_WORDS)))
        often = cut(often.where(F.col("n") <= LONG_WORDS).select("cid", "train").distinct())
        if often.isEmpty():
            break
        left = cut(left.join(often, ["cid", "train"], "left_semi"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# ---- results ----


def _class_pairs(cls: DataFrame) -> DataFrame:
    """(t, e): training and evaluation classes within the allowed edits, equal ones included."""
    hits = cut(shared_spans(cls))
    marked = hits.where("kind = 1").select(F.col("t").alias("cid"), "train").distinct()
    pairs = hits.where("kind = 0").select("t", "e")
    if not marked.isEmpty():
        pairs = pairs.unionByName(_marked_pairs(marked, cls))

    @F.pandas_udf("boolean")
    def confirmed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([within(x := p.split(" "), y := q.split(" "), allowed(len(x), len(y))) for p, q in zip(a, b)], dtype=bool)

    pairs = cut(pairs.distinct())
    asked = cut(pairs.select(F.explode(F.array("t", "e")).alias("cid")).distinct())
    text = cut(cls.select("cid", "words").join(broadcast_if_small(asked, 16), "cid", "left_semi"))
    both = pairs.join(text.toDF("t", "tw"), "t").join(text.toDF("e", "ew"), "e")
    near = both.where(confirmed("tw", "ew")).select("t", "e")
    return near.unionByName(cls.where("n_train > 0 and n_eval > 0").select(F.col("cid").alias("t"), F.col("cid").alias("e")))


def _with_class(recs: DataFrame, known: DataFrame) -> DataFrame:
    """Records and what is known of their class; classes with many records are salted. ``known`` is materialised."""
    mine, known, _ = salted(recs, known, ["c1", "c2"], "n", ["sample_id"], row_bytes=48)
    return mine.join(known.drop("n"), ["c1", "c2", "__salt"]).drop("__salt")


def record_pairs(samples: DataFrame) -> DataFrame:
    """All pairs of a training record and a val or test record with the same or nearly the same prompt.

    Columns train_id, eval_id, eval_split, eval_source. Prompts without words and
    records without one of the three splits form no pairs. Null sample ids stay
    null; a sample id that occurs twice gives its pairs once a row.
    """
    recs = cut(records(samples))
    cls = cut(classes(recs))
    pairs = cut(_class_pairs(cls))
    t = pairs.select("t").distinct().join(cls.select(F.col("cid").alias("t"), "c1", "c2", F.col("n_train").alias("n")), "t")
    e = pairs.select("e").distinct().join(cls.select(F.col("cid").alias("e"), "c1", "c2", F.col("n_eval").alias("n")), "e")
    train = _with_class(recs.where("train").select("c1", "c2", F.col("sample_id").alias("sample_id")), cut(t)).select("t", F.col("sample_id").alias("train_id"))
    evals = _with_class(recs.where("not train").select("c1", "c2", "sample_id", "split", "source"), cut(e)).select("e", F.col("sample_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    return pairs.join(train, "t").join(evals, "e").select("train_id", "eval_id", "eval_split", "eval_source")


def _links(samples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, classes, and (cid, train, links): for each class with partners the records it is linked to."""
    recs = cut(records(samples))
    cls = cut(classes(recs))
    pairs = cut(_class_pairs(cls))
    to_train = pairs.join(cls.select(F.col("cid").alias("t"), "n_train"), "t").groupBy(F.col("e").alias("cid")).agg(F.sum("n_train").alias("links")).withColumn("train", F.lit(False))
    to_eval = pairs.join(cls.select(F.col("cid").alias("e"), "n_eval"), "e").groupBy(F.col("t").alias("cid")).agg(F.sum("n_eval").alias("links")).withColumn("train", F.lit(True))
    return recs, cls, cut(to_train.unionByName(to_eval))


def record_links(samples: DataFrame) -> DataFrame:
    """``sample_id``, ``split``, ``class_id``, ``n_links`` of every record with words and one of the three splits.

    Records with the same words have one class id; n_links counts the records of
    the other side that are the same or nearly the same. No pair is written out.
    """
    recs, cls, links = _links(samples)
    side = lambda train, c: links.where(F.col("train") == train).select("cid", F.col("links").alias(c))
    known = cut(cls.select("cid", "c1", "c2", (F.col("n_train") + F.col("n_eval")).alias("n")).join(side(True, "of_train"), "cid", "left").join(side(False, "of_eval"), "cid", "left").drop("cid"))
    n = F.coalesce(F.when(F.col("train"), F.col("of_train")).otherwise(F.col("of_eval")), F.lit(0))
    return _with_class(recs.select("c1", "c2", "sample_id", "split", "train"), known).select("sample_id", "split", F.lower(F.concat(F.lpad(F.hex("c1"), 16, "0"), F.lpad(F.hex("c2"), 16, "0"))).alias("class_id"), n.alias("n_links"))


def found_pairs(samples: DataFrame) -> DataFrame:
    """``sample_id_a`` < ``sample_id_b`` of :func:`record_pairs`."""
    p = record_pairs(samples)
    return p.select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b")).distinct()


def overlap_report(samples: DataFrame) -> DataFrame:
    """Per split and source: evaluation records, those with an overlap, and pairs.

    Sources are compared trimmed and in upper case; null and blank count as
    unknown. Pairs are counted over classes and never written out.
    """
    name = lambda c: F.coalesce(F.nullif(F.upper(F.trim(F.col(c))), F.lit("")), F.lit("unknown"))
    recs, cls, links = _links(samples)
    known = cut(links.where("not train").select("cid", "links").join(cls.select("cid", "c1", "c2", F.col("n_eval").alias("n")), "cid").drop("cid"))
    linked = _with_class(recs.where("not train").select("c1", "c2", "sample_id", "split", "source"), known)
    hits = linked.groupBy("split", name("source").alias("source")).agg(F.countDistinct("sample_id").alias("n_overlapping"), F.sum("links").alias("n_pairs"))
    whole = samples.where(F.col("split").isin("val", "test")).groupBy("split", name("source").alias("source")).agg(F.count(F.lit(1)).alias("n_records"))
    return whole.join(hits, ["split", "source"], "left").select("split", "source", "n_records", F.coalesce("n_overlapping", F.lit(0)).alias("n_overlapping"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


def span_coverage(samples: DataFrame) -> DataFrame:
    """``sample_id``, ``n_words``, ``n_covered`` of each val or test record with words.

    Covered is every word inside a run of SPAN_WORDS words or more that stands
    anywhere in a training text; overlapping runs are merged. A run is the union
    of its windows of SPAN_WORDS words, so windows of all places of both sides
    find its whole length. Records under SPAN_WORDS words are covered whole if a
    training record has the same words, else not at all.
    """
    recs = cut(records(samples))
    cls = cut(classes(recs)).withColumns({"in_train": F.col("n_train") > 0, "in_eval": F.col("n_eval") > 0})
    w = F.split("words", " ")
    window = F.arrays_zip(*[F.slice(w, k + 1, F.size(w)).alias(f"w{k}") for k in range(SPAN_WORDS)])
    every = cls.where(F.size(w) >= SPAN_WORDS).select("c1", "c2", "in_train", "in_eval", F.posexplode(window).alias("pos", "window"))
    every = every.where(F.col(f"window.w{SPAN_WORDS - 1}").isNotNull()).withColumns({"g1": F.xxhash64("window"), "g2": F.xxhash64(F.lit("second"), "window")})
    known = every.where("in_train").select("g1", "g2").distinct()
    spans = every.where("in_eval and not in_train").select("c1", "c2", "pos", "g1", "g2").join(known, ["g1", "g2"], "left_semi")
    inside = F.transform("spans", lambda at: F.sequence(at, at + SPAN_WORDS - 1))
    merged = spans.groupBy("c1", "c2").agg(F.collect_list("pos").alias("spans")).select("c1", "c2", F.size(F.array_distinct(F.flatten(inside))).alias("covered"))
    n = F.size(F.split("words", " "))
    per = cls.where("in_eval").join(merged, ["c1", "c2"], "left").select("c1", "c2", F.col("n_eval").alias("n"), n.alias("n_words"), F.when(F.col("in_train"), n).otherwise(F.coalesce("covered", F.lit(0))).alias("n_covered"))
    return _with_class(recs.where("not train").select("sample_id", "c1", "c2"), cut(per)).select("sample_id", "n_words", "n_covered")

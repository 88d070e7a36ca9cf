"""Mixing sources to target weights.

Every source gets its share of the total size in tokens. The copies of a text
are its source's size factor: a whole number plus a fraction that is a
probability of one copy more. Pivotal rounding makes the fractions whole: two
texts of one source exchange mass, so that the tokens in expectation stay the
same, until one of them is 0 or 1. A text of more than LARGE mean sizes, which
would leave a source far from its share if chance alone decided on it at the
end, exchanges mass with many smaller texts at once, each in proportion. Every
text is so used with the probability of its source's factor, whatever its size.
Each partition does this in one pass and leaves a bounded number of open texts a
source; the open texts of all partitions go through one reduction tree. At its
end one text a source at most is decided by its probability alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.cluster import cut, spread
from pairlight.compat import blank_to_null, squeeze
from pairlight.llm.encode import count_column

#: Partitions that one task of the next level of the tree reads.
FAN_IN = 16
#: Target tables have at most so many rows; more raise ValueError.
MAX_SOURCES = 10_000
#: A text of more mean sizes of its source than this is large.
LARGE = 2.0
#: Small texts a source and partition that the tree leaves open until its last round.
RESERVE = 64
_EDGE = 1e-9


def source_key(c: Column | str) -> Column:
    """Source as compared: trimmed, without case; null where missing."""
    return blank_to_null(F.lower(squeeze(c)))


def sized_texts(documents: DataFrame, sources: list[str], tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``source`` (as compared), ``n_tokens`` of each different text of ``sources``.

    A text that several documents hold is one text; it is taken from the
    document with the least id that names a source. Null and blank texts and
    documents without source are left out, since they can fill no share. Tokens
    are counted where the texts are read; what is shuffled holds no text.
    """
    number = F.broadcast(documents.sparkSession.createDataFrame([(s, i) for i, s in enumerate(sources)], "source string, __number int"))
    rows = spread(documents.select("doc_id", "source", "text")).select("doc_id", source_key("source").alias("source"), "text").where(blank_to_null("text").isNotNull() & F.col("source").isNotNull() & F.col("doc_id").isNotNull())
    counted = rows.select("doc_id", "source", F.unhex(F.md5("text")).alias("h"), F.length("text").alias("n"), count_column(tokenizer)("text").alias("n_tokens"))
    numbered = counted.join(number, "source", "left").select("doc_id", "h", "n", "n_tokens", F.coalesce("__number", F.lit(-1)).alias("__number"))
    first = numbered.groupBy("h", "n", "n_tokens").agg(F.min("doc_id").alias("doc_id"), F.min_by("__number", "doc_id").alias("__number"))
    return first.join(number, "__number").select("doc_id", "source", "n_tokens")


def plan(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float | None = None) -> tuple[float, dict[str, float]]:
    """Total size and size factor of each source.

    The total is the wanted one, or else the largest that every source can fill
    with its share within its cap. A source without any text or repeat can fill
    nothing and bounds nothing: it stays empty and the others keep their
    proportions. A source that cannot fill its share of a wanted total gives all
    its copies; the rest is not made up by others.
    """
    able = {s: sizes.get(s, 0) * max(0, caps[s]) for s in shares}
    if total is None:
        total = min((able[s] / w for s, w in shares.items() if w > 0 and able[s] > 0), default=0.0)
    return total, {s: (min(w * total, able[s]) / sizes[s] if sizes.get(s) else 0.0) for s, w in shares.items()}


def _u(seed: str, *ids: int) -> float:
    return (xxhash.xxh64_intdigest(f"{seed}|{'|'.join(map(str, ids))}") + 0.5) / 2.0**64


def exchange(a: tuple[int, int, float], b: tuple[int, int, float], seed: str) -> tuple[tuple[int, int, float], tuple[int, int, float]]:
    """One pivotal step of two texts (doc_id, tokens, probability).

    Tokens times probability of both together stay the same, each probability
    keeps its expectation, and one of them becomes 0 or 1.
    """
    (i, w, p), (j, v, q) = a, b
    up = min((1 - p) * w, q * v)  # token mass that can go from b to a
    down = min(p * w, (1 - q) * v)
    if _u(seed, i, j) * (up + down) < down:
        p, q = p + up / w, q - up / v
    else:
        p, q = p - down / w, q + down / v
    return (i, w, p), (j, v, q)


def exchange_many(a: tuple[int, int, float], others: list[tuple[int, int, float]], seed: str, most: float = 1.0) -> tuple[tuple[int, int, float], list[tuple[int, int, float]]]:
    """One pivotal step of a text with many others together, each giving or taking in proportion.

    Tokens times probability of all together stay the same and each probability
    keeps its expectation. The others may have up to ``most`` copies. The text
    becomes 0 or 1 if they can give and take that much, else they give or take all.
    """
    i, w, p = a
    give = sum(v * q for _, v, q in others)
    take = sum(v * (most - q) for _, v, q in others)
    up, down = min((1 - p) * w, give), min(p * w, take)
    if up + down <= 0:
        return a, others
    if _u(seed, i, others[0][0], len(others)) * (up + down) < down:
        keep = 1 - up / give if give > up else 0.0
        return (i, w, p + up / w), [(j, v, q * keep) for j, v, q in others]
    keep = 1 - down / take if take > down else 0.0
    return (i, w, p - down / w), [(j, v, most - (most - q) * keep) for j, v, q in others]


def settled(p: float) -> bool:
    return p < _EDGE or p > 1 - _EDGE


_COLUMNS = ["doc_id", "source", "n_tokens", "base", "most", "large", "p"]
_ROW = "doc_id bigint, source string, n_tokens bigint, base bigint, most bigint, large boolean, p double"


def _round(seed: str, last: bool):
    """Rounds a partition whose rows come by source, large texts first.

    Left open are one large text a source, one small one and RESERVE small ones
    that wait for the last round. There the large one exchanges mass with all the
    small ones that are left, within their copies allowed, and one text a source
    stays open.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source: str | None = None
        most = 0
        held: dict[bool, tuple[int, int, float]] = {}
        waiting: list[tuple[int, int, float]] = []
        bases: dict[int, int] = {}
        out: list[tuple] = []

        def put(row: tuple[int, int, float], large: bool, p: float) -> None:
            out.append((row[0], source, row[1], bases.pop(row[0]), most, large, p))

        def chain(row: tuple[int, int, float], large: bool) -> None:
            other = held.pop(large, None)
            for x in (row,) if other is None else exchange(other, row, seed):
                if settled(x[2]):
                    put(x, large, float(round(x[2])))
                else:
                    held[large] = x

        def finish() -> None:
            small = waiting[:]
            waiting.clear()
            if last:
                if True in held and small:
                    one, small = exchange_many(held.pop(True), [(d, n, bases[d] + p) for d, n, p in small], seed, float(most))
                    chain(one, True)
                    for k, (d, n, c) in enumerate(small):
                        bases[d] = int(c + _EDGE)
                        small[k] = (d, n, max(0.0, c - bases[d]))
                for row in small:
                    if settled(row[2]):
                        put(row, False, float(round(row[2])))
                    else:
                        chain(row, False)
                small = []
                if len(held) == 2:
                    for large, x in zip((True, False), exchange(held.pop(True), held.pop(False), seed)):
                        put(x, large, float(round(x[2])) if settled(x[2]) else x[2])
            for row in small:
                put(row, False, row[2])
            for large, row in sorted(held.items()):
                put(row, large, row[2])
            held.clear()

        for b in batches:
            for d, s, n, base, cap, large, p in zip(*(b[c] for c in _COLUMNS)):
                if s != source:
                    finish()
                    source, most = s, cap
                bases[d] = base
                if settled(p) or n <= 0:
                    put((d, n, p), large, float(round(p)))
                elif not large and (last or len(waiting) < RESERVE):
                    waiting.append((d, n, p))
                else:
                    chain((d, n, p), large)
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out.clear()
        finish()
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return run


def _settle(state: DataFrame, seed: str) -> DataFrame:
    """All rows with p 0 or 1: the reduction tree of pivotal rounds."""
    parts = max(1, state.rdd.getNumPartitions())
    done = []
    open_text = (F.col("p") > _EDGE) & (F.col("p") < 1 - _EDGE)
    while True:
        rounded = cut(state.sortWithinPartitions("source", F.desc("large"), "doc_id").mapInPandas(_round(seed, parts == 1), _ROW))
        done.append(rounded.where(~open_text))
        if parts == 1:
            last = rounded.where(open_text)  # one text a source at most
            u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "doc_id")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
            done.append(last.withColumn("p", F.when(u < F.col("p"), F.lit(1.0)).otherwise(F.lit(0.0))))
            break
        parts = -(-parts // FAN_IN)
        state = rounded.where(open_text).repartition(parts, F.pmod(F.xxhash64("doc_id"), F.lit(parts))) if parts > 1 else rounded.where(open_text).coalesce(1)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: str = "29", tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``copies`` of every text that is used.

    ``targets`` has source, target_share (made to sum to 1) and max_repeats; its
    sources are compared like those of the documents, null ones are left out,
    null shares and repeats count as 0. Sources without target are not used. An
    empty table gives an empty mixture.
    """
    rows = targets.select(source_key("source").alias("s"), "target_share", "max_repeats").where("s is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("too many target sources")
    shares: dict[str, float] = {}
    caps: dict[str, int] = {}
    for s, w, m in rows:
        shares[s] = shares.get(s, 0.0) + max(0.0, w or 0.0)
        caps[s] = max(caps.get(s, 0), m or 0)
    whole = sum(shares.values()) or 1.0
    shares = {s: w / whole for s, w in shares.items()}
    spark = documents.sparkSession
    texts = cut(sized_texts(documents, sorted(shares), tokenizer))
    sums = {r[0]: (r[1], r[2]) for r in texts.groupBy("source").agg(F.sum("n_tokens"), F.avg("n_tokens")).collect()}
    _, factor = plan({s: n for s, (n, _) in sums.items()}, shares, caps, total_tokens)
    known = F.broadcast(spark.createDataFrame([(s, float(f), float(sums[s][1]) if s in sums else 0.0, max(0, caps[s])) for s, f in sorted(factor.items())], "source string, factor double, mean double, most bigint"))
    base = F.floor(F.col("factor") + F.lit(_EDGE))
    start = texts.join(known, "source").select("doc_id", "source", "n_tokens", base.alias("base"), "most", (F.col("n_tokens") > LARGE * F.col("mean")).alias("large"), F.greatest(F.col("factor") - base, F.lit(0.0)).alias("p"))
    return _settle(start, seed).select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p")).cast("bigint").alias("copies")).where("copies > 0")


def mixture_shares(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per target source: tokens, copies and the share in fact reached."""
    used = mixture(documents, targets, total_tokens).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens")
    )
    all_tokens = used.agg(F.sum("n_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        targets.select("source", source_key("source").alias("k"), "target_share", "max_repeats")
        .join(used.withColumnRenamed("source", "k"), "k", "left").crossJoin(F.broadcast(all_tokens))
        .select("source", "target_share", "max_repeats", zero("n_texts"), zero("n_copies"), zero("most_copies"), zero("n_tokens"), F.coalesce(F.try_divide("n_tokens", "all_tokens"), F.lit(0.0)).alias("reached_share"))
    )

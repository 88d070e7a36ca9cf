"""Splits that keep related records together.

Records are related through the keys named in ``meta``. The graph is built on
the keys, not on the records: a record with keys a, b, c gives the edges a-b and
a-c, once however many records share them, so a key of a third of all rows is
one node. Components are found by hash-to-min on rows: every node keeps its
cluster as rows (node, member), sends its cluster to the cluster's least member
and that member to all others, until nothing changes. Components then go to
splits by weighted rendezvous hashing, whose weights are fitted until the sizes
of the splits meet their targets as well as they can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.cluster import cut, salted
from pairlight.compat import SPACE

#: Values that name nobody (fixed values; compared in lower case).
PLACEHOLDERS = ("", "unknown", "anonymous", "n/a", "-")

MAX_ROUNDS = 60
#: Rows of one node or component that a single task may get.
ROWS_A_TASK = 200_000
#: Target tables have at most so many rows; more raise ValueError.
MAX_SPLITS = 1000
#: Hash functions that are tried at once for the split of components, and passes that fit their weights.
TRIES, PASSES = 8, 12
#: Fitting ends once no split misses its share by more than this.
GOOD = 0.0005


def _value(raw: Column) -> Column:
    v = F.lower(F.trim(F.regexp_replace(raw, rf"[{SPACE}]+", " ")))
    return F.when(~v.isin(*PLACEHOLDERS), v)


_META = "author string, annotator string, entity string, entities array<string>, filename string, scenario_id string, benchmark_id string"


def relation_keys(meta: Column) -> Column:
    """Array of the distinct keys through which a record is related to others.

    A key is its kind and value. Null or broken JSON gives none. The object is
    parsed once; an author object keeps its JSON text, whose id counts.
    """
    m = F.from_json(meta, _META)
    author = m["author"]
    nested = author.startswith("{")
    writer = F.when(nested, F.get_json_object(author, "$.id")).otherwise(author)
    bench, scenario = _value(m["benchmark_id"]), _value(m["scenario_id"])
    one = lambda kind, v: F.concat(F.lit(kind), v)
    keys = F.concat(
        F.array(
            one("w:", _value(writer)), one("w:", _value(m["annotator"])), one("e:", _value(m["entity"])), one("f:", _value(m["filename"])),
            F.concat(F.lit("s:"), F.length(bench).cast("string"), F.lit(":"), bench, scenario),
        ),
        F.transform(F.coalesce(m["entities"], F.array().cast("array<string>")), lambda x: one("e:", _value(x))),
    )
    return F.array_distinct(F.array_compact(keys))


def _keyed(samples: DataFrame) -> DataFrame:
    """``sample_id``, ``split``, ``keys`` of every record; keys are numbers, no two keys have the same.

    A key's number is a hash of 64 bits, so that nodes are compared and counted
    as plain numbers. A second hash shows whether two keys share a number; then
    all are hashed anew.
    """
    for seed in range(16):
        number = lambda k: F.struct(F.xxhash64(F.lit(seed), k).alias("k"), F.xxhash64(F.lit(seed + 100), k).alias("check"))  # noqa: B023, E731
        keyed = cut(samples.select("sample_id", "split", F.transform(relation_keys(F.col("meta")), number).alias("keys")))
        same = keyed.select(F.explode("keys").alias("x")).groupBy("x.k").agg(F.min("x.check").alias("lo"), F.max("x.check").alias("hi")).where(F.col("lo") != F.col("hi"))
        if same.isEmpty():
            return keyed.select("sample_id", "split", F.col("keys.k").alias("keys"))
    raise RuntimeError("keys could not be numbered")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of an edge table (a, b).

    Hash-to-min on rows. Each round finds each node's least member with map-side
    combining and joins it back; the largest cluster stays spread over rows,
    never in one array, and once there are more than ROWS_A_TASK rows the join
    is salted for nodes with more than that. Written to the shared folder each
    round, so a lost executor costs one round.
    """
    both = edges.where(F.col("a") != F.col("b")).select("a", "b")
    pair = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("member"))
    rows = cut(both.select(F.explode(F.array(pair("a", "b"), pair("b", "a"), pair("a", "a"), pair("b", "b"))).alias("r")).select("r.*").distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first()
    before = mark(rows)
    for _ in range(MAX_ROUNDS):
        least = rows.groupBy("node").agg(F.min("member").alias("least"), F.count(F.lit(1)).alias("n"))
        if before[0] > ROWS_A_TASK:
            mine, known, _ = salted(rows, cut(least), ["node"], "n", ["member"], rows_a_task=ROWS_A_TASK, row_bytes=24)
            known = mine.join(known.drop("n"), ["node", "__salt"])
        else:
            known = rows.join(least.drop("n"), "node")
        rows = cut(known.select(F.explode(F.array(pair("least", "member"), pair("member", "least"))).alias("r")).select("r.*").distinct())
        after = mark(rows)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("hash-to-min did not settle")
    return rows.groupBy("node").agg(F.min("member").alias("component"))


def _nodes(keyed: DataFrame) -> DataFrame:
    """Each record's first key as ``node``: its ``component``, its records ``n`` and their least and greatest split, hashed."""
    edges = keyed.where(F.size("keys") > 1).select(F.element_at("keys", 1).alias("a"), F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("b")).distinct()
    split = F.xxhash64("split")
    split = F.when(F.col("split").isNotNull(), split)
    of_node = keyed.where(F.size("keys") > 0).groupBy(F.element_at("keys", 1).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(split).alias("lo"), F.max(split).alias("hi"))
    return cut(of_node.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node")))


def _meet(rows: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """Records (with their first key as node) and what is known of the node; nodes with many records are salted."""
    mine, known, _ = salted(rows, nodes, ["node"], "n", ["sample_id"], rows_a_task=ROWS_A_TASK, row_bytes=48)
    return mine.join(known.drop("n"), ["node", "__salt"], how).drop("__salt")


def _own(keyless: DataFrame) -> DataFrame:
    """``component`` of records without keys: each its own.

    It comes of the sample id, so that it does not depend on other records; where
    the id is null or occurs again, the record's place makes it another.
    """
    placed = keyless.withColumn("place", F.monotonically_increasing_id())
    named = placed.where(F.col("sample_id").isNotNull())
    again = cut(named.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    mine, known, _ = salted(named, again, ["sample_id"], "n", ["place"], rows_a_task=ROWS_A_TASK)
    named = mine.join(known, ["sample_id", "__salt"], "left").select("sample_id", "split", F.when(F.col("n").isNull(), F.concat(F.lit("r:"), "sample_id")).otherwise(F.concat(F.lit("a:"), F.col("place").cast("string"), F.lit(":"), "sample_id")).alias("own"))
    unnamed = placed.where(F.col("sample_id").isNull()).select("sample_id", "split", F.concat(F.lit("n:"), F.col("place").cast("string")).alias("own"))
    return named.unionByName(unnamed).select("sample_id", "split", F.unhex(F.md5("own")).alias("component"))


def _binary(c: str) -> Column:
    """A number as eight bytes; components of records without keys have sixteen."""
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def _records(keyed: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with and without keys, with their component."""
    rows = keyed.where(F.size("keys") > 0).select("sample_id", "split", F.element_at("keys", 1).alias("node"))
    named = _meet(rows, nodes.select("node", "component", "n"), "inner").select("sample_id", "split", _binary("component").alias("component"))
    return named, _own(keyed.where(F.coalesce(F.size("keys"), F.lit(0)) <= 0).select("sample_id", "split"))


def record_components(samples: DataFrame) -> DataFrame:
    """``sample_id``, ``split``, ``component`` (binary) of every record.

    The component of a record without keys is its own, also if its id is null or
    another record has it too. Rows are kept as they are: repeated sample ids
    stay repeated.
    """
    keyed = _keyed(samples)
    named, alone = _records(keyed, _nodes(keyed))
    return named.unionByName(alone)


def divided_records(samples: DataFrame) -> DataFrame:
    """``sample_id`` of the records whose component has several given splits.

    Null is no split; records with a null split are listed with their group. A
    record without keys is no group, whatever its id.
    """
    keyed = _keyed(samples)
    nodes = _nodes(keyed)
    groups = cut(nodes.groupBy("component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("m")).where(F.col("lo") != F.col("hi")).select("component", "m"))
    mine, known, _ = salted(nodes.select("node", "component", "n"), groups, ["component"], "m", ["node"], rows_a_task=ROWS_A_TASK, row_bytes=24)
    bad = cut(mine.join(known.drop("m"), ["component", "__salt"], "left_semi").select("node", "n"))
    rows = keyed.where(F.size("keys") > 0).select("sample_id", F.element_at("keys", 1).alias("node"))
    return _meet(rows, bad, "left_semi").select("sample_id")


def _chosen(h: Column, weights: dict[str, float], attempt: int, seed: str) -> Column:
    """The split with the least -ln(u)/weight, u from a hash of component and split."""
    u = lambda s: (F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}|{attempt}|{s}"), h), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    score = [F.struct((-F.log(u(s)) / F.lit(w)).alias("score"), F.lit(s).alias("split")) for s, w in sorted(weights.items()) if w > 0]
    return (score[0] if len(score) == 1 else F.least(*score))["split"]


def fitted_weights(sizes: DataFrame, shares: dict[str, float], seed: str, passes: int = PASSES) -> tuple[int, dict[str, float]]:
    """The hash function and the weights with which the splits' sizes miss their shares least.

    ``sizes`` has one row (h, n) a component. Every component follows the same
    rule, whatever its size. Each pass counts the records that each split would
    get under each of TRIES hash functions, a few sums combined map-side, and
    moves each weight by what its split misses. Without a pass the weights are
    the shares.
    """
    weights = [dict(shares) for _ in range(TRIES)]
    best, chosen = float("inf"), (0, dict(shares))
    for _ in range(passes):
        picks = sizes.select("n", *[_chosen(F.col("h"), w, t, seed).alias(f"s{t}") for t, w in enumerate(weights)])
        order = sorted(shares)
        sums = picks.agg(F.sum("n"), *[F.sum(F.when(F.col(f"s{t}") == s, F.col("n"))) for t in range(TRIES) for s in order]).first()
        if not sums[0]:
            break
        for t in range(TRIES):
            got = {s: (sums[1 + t * len(order) + i] or 0) / sums[0] for i, s in enumerate(order)}
            miss = max(abs(got[s] - shares[s]) for s in order)
            if miss < best - 1e-12:
                best, chosen = miss, (t, dict(weights[t]))
            for s in order:
                if shares[s] > 0:
                    weights[t][s] *= min(4.0, max(0.25, shares[s] / max(got[s], 1e-9))) ** 0.8
            whole = sum(weights[t].values())
            weights[t] = {s: max(w / whole, 1e-12) if shares[s] > 0 else 0.0 for s, w in weights[t].items()}
        if best <= GOOD:
            break
    return chosen


def assign_splits(samples: DataFrame, targets: DataFrame, seed: str = "17", passes: int = PASSES) -> DataFrame:
    """``sample_id``, ``component`` (hex) and ``new_split`` of every record.

    Components go to splits by weighted rendezvous hashing (see
    :func:`fitted_weights`); ``passes=0`` leaves the weights at the target shares,
    so that a further component moves no other. ``targets`` has a handful of rows
    (split, target_share); null or negative shares count as 0. Without a positive
    share it raises ValueError.
    """
    rows = targets.select("split", "target_share").where("split is not null").limit(MAX_SPLITS + 1).collect()
    if len(rows) > MAX_SPLITS:
        raise ValueError("too many splits")
    wanted = {r[0]: max(0.0, r[1] or 0.0) for r in rows}
    total_share = sum(wanted.values())
    if total_share <= 0:
        raise ValueError("no split has a positive target share")
    keyed = _keyed(samples)
    nodes = _nodes(keyed)
    named, alone = _records(keyed, nodes)
    alone = cut(alone)
    h = F.xxhash64("component")
    sizes = nodes.groupBy("component").agg(F.sum("n").alias("n")).select(F.xxhash64(_binary("component")).alias("h"), "n").unionByName(alone.select(h.alias("h"), F.lit(1).cast("bigint").alias("n")))
    attempt, weights = fitted_weights(cut(sizes), {s: w / total_share for s, w in wanted.items()}, seed, passes)
    return named.unionByName(alone).select("sample_id", F.lower(F.hex("component")).alias("component"), _chosen(h, weights, attempt, seed).alias("new_split"))


def split_shares(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Records and reached share of every split beside its target."""
    done = assign_splits(samples, targets)
    n = done.groupBy(F.col("new_split").alias("split")).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("component").alias("n_components"))
    all_n = n.agg(F.sum("n_records").alias("total"))
    return (
        targets.join(n, "split", "left").crossJoin(F.broadcast(all_n))
        .select("split", "target_share", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_components", F.lit(0)).alias("n_components"), F.coalesce(F.col("n_records") / F.col("total"), F.lit(0.0)).alias("reached_share"))
    )

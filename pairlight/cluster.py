"""Cluster-facing helpers: durable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` names it on a cluster. Only where neither that
    setting nor a folder of the context exists (local tests), a new temporary
    folder is set.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="pairlight-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit_bytes: int = 8 << 20) -> DataFrame:
    """``df`` with a broadcast hint when its measured size is within ``limit_bytes``.

    ``df`` should be materialised (see :func:`cut`), since its rows are counted.
    A larger frame comes back without a hint and is joined by shuffling.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit_bytes else df


#: Rows of one key that a task may get; the rows of heavier keys are salted.
ROWS_A_TASK = 20_000
#: Heavy keys there can be at most: a heavy key has more than one in so many of all counted rows.
MOST_HEAVY = 10_000


def salted(rows: DataFrame, one: DataFrame, on: list[str], n: str, by: list[str], salt: str = "__salt", rows_a_task: int = ROWS_A_TASK, row_bytes: int = 200, limit_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame, bool]:
    """Both sides of a join of ``rows`` with ``one``, made ready to meet on ``on`` and ``salt``.

    ``one`` (materialised) has a row for each key and in ``n`` how many of
    ``rows`` have it. No task then gets more than max(``rows_a_task``, 1/MOST_HEAVY
    of all counted rows) rows of one key: rows of heavier keys get a salt out of
    ``by`` and their place, and their row in ``one`` is repeated for each salt. The
    heavy keys, at most MOST_HEAVY, are broadcast; ``one`` itself only if it
    measures under ``limit_bytes``. The last value tells whether a key is heavy.
    """
    count, total, most = one.agg(F.count(F.lit(1)), F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    limit = max(rows_a_task, -(-int(total) // MOST_HEAVY))
    heavy = most > limit
    if heavy:
        parts = F.ceil(F.col(n) / F.lit(limit)).cast("int")
        known = F.broadcast(one.where(F.col(n) > limit).select(*on, parts.alias("__parts")))
        place = F.pmod(F.xxhash64(*by, F.spark_partition_id()), F.col("__parts")).cast("int")
        rows = rows.join(known, on, "left").withColumn(salt, F.coalesce(place, F.lit(0))).drop("__parts")
        one = one.withColumn(salt, F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    else:
        rows, one = rows.withColumn(salt, F.lit(0)), one.withColumn(salt, F.lit(0))
    return rows, F.broadcast(one) if count * row_bytes <= limit_bytes else one, heavy


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster runs tasks at once.

    For a plain scan that goes through Python: a small file of one row group is
    one partition, and all other cores would idle. Input of more partitions, as
    any large table is, stays as it is and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def row_numbers(df: DataFrame, by: list[str], order: list[str], out: str = "row_number") -> DataFrame:
    """``out``: the place of each row (from 1) among the rows with equal ``by``, in ``order``.

    As a window over ``by`` would give it, but without sorting a group in one
    task: rows are cut into ranges of (by, order), numbered within a range, and
    moved by the counts of the ranges before. Null keys form a group.
    """
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__range").alias("__of"), before.alias("__before"))
    on = [ranged[c].eqNullSafe(sizes[f"__by{i}"]) for i, c in enumerate(by)] + [ranged["__range"] == sizes["__of"]]
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    return ranged.join(sizes, on).withColumn(out, (inside + F.col("__before")).cast("bigint")).drop("__range", "__of", "__before", *[f"__by{i}" for i in range(len(by))])


def running(counts: DataFrame, by: list[str], order: str, n: str, out: str = "before") -> DataFrame:
    """``out``: the sum of ``n`` over the rows of equal ``by`` that come before in ``order``.

    As :func:`row_numbers`, in ranges and over ranges: no group is sorted in one
    task, and what a group's ranges are summed over is at most a row a partition.
    """
    ranged = cut(counts.repartitionByRange(*by, order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "__range").agg(F.sum(n).alias("__n"))
    past = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__range").alias("__of"), past.alias("__past"))
    on = [ranged[c].eqNullSafe(sizes[f"__by{i}"]) for i, c in enumerate(by)] + [ranged["__range"] == sizes["__of"]]
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(sizes, on).withColumn(out, inside + F.col("__past")).drop("__range", "__of", "__past", *[f"__by{i}" for i in range(len(by))])


def parquet_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty frame where nothing is at ``path``; any other failure is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

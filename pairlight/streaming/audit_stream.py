"""Structured Streaming forms: resumable scoring, cache compaction and audit of new pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairlight.cluster import parquet_or_empty
from pairlight.operators.redelivery import keep_one
from pairlight.operators.scoring import Scorer, score_missing


def stream_files(spark: SparkSession, folder: str, schema: str, fmt: str = "json", files_a_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_a_trigger).load(folder)


def score_stream(texts: DataFrame, cache_path: str, checkpoint: str, scorer_id: str, scorer: Scorer, created_utc: str) -> StreamingQuery:
    """Scores texts as they arrive and appends to the cache table.

    Resuming starts behind the last finished batch; a batch that runs again after
    a failure scores nothing twice, because the cache knows its texts.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        cache = parquet_or_empty(spark, cache_path, "scorer_id string, text_hash string, score double, created_utc string")
        score_missing(df, cache, scorer_id, scorer, created_utc).write.mode("append").parquet(cache_path)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def messages_stream(messages: DataFrame, stored_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps one copy of every message of a stream as whole snapshots below ``stored_path``.

    Each batch writes the messages stored so far and the new ones, deduplicated,
    as version <batch>; a batch that runs again overwrites its own version. For
    readers that want a plain table; where the stored messages are many,
    :func:`messages_log` writes only what is new.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        stored = spark.read.parquet(f"{stored_path}/v{number - 1}") if number else None
        kept = keep_one(df) if stored is None else keep_one(stored, df)
        kept.write.mode("overwrite").parquet(f"{stored_path}/v{number}")

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def messages_log(messages: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Appends one copy of every message of each batch to a log; :func:`logged_messages` reads it.

    A batch writes its own messages only, as partition <batch>, and overwrites that
    partition if it runs again, so its cost does not grow with what is stored.
    """

    def batch(df: DataFrame, number: int) -> None:
        keep_one(df).write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged_messages(spark: SparkSession, log_path: str) -> DataFrame:
    """The kept copy of every message in a log: a copy that lost within its batch cannot win among all."""
    return keep_one(spark.read.parquet(log_path).drop("batch"))


def compact_log(spark: SparkSession, log_path: str, target: str) -> None:
    """Writes the kept copies of a log as batch -1 of another log, on which a stream can go on."""
    logged_messages(spark, log_path).write.mode("overwrite").parquet(f"{target}/batch=-1")


def windowed_rates(events: DataFrame, time: str, late: str = "1 hour", width: str = "10 minutes", by: str = "severity") -> DataFrame:
    """Counts per window and value; rows later than ``late`` are dropped in a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")

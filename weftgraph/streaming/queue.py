"""A work queue of files: items come in as JSON lines, each is scored once, results carry the item's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id bigint, arch string, at timestamp"


def items(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A stream of the items in a folder."""
    return spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_at_once).json(path)


def scored(stream: DataFrame, score: Column, late: str = "1 hour") -> DataFrame:
    """id, score of each item; an id that comes again within the time is dropped."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"]).select("id", score.alias("score"))


def run(stream: DataFrame, out: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None):
    """Starts writing results as Parquet, a folder for each batch, so that a batch that is done again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if then:
            then(df, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, out: str, asked: DataFrame) -> DataFrame:
    """asked(id) with its score, joined on the id; null for those not done."""
    return asked.join(spark.read.parquet(out).select("id", "score"), "id", "left")


def activity(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """start, kind, n of events(ts, event_type) by window of time."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("event_type").alias("kind"), "n")

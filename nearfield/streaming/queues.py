"""The two queues kept up to date over a stream of changes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_recompute_queue(changes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Latest change per category of a change stream; state is one row per category."""
    rows = changes.select("image_id", "category_id", "ts")
    if images is not None:
        items = images.select("image_id", F.col("category_id").alias("item_category"))
        placed = rows.filter(F.col("category_id").isNull()).join(items, "image_id")
        rows = rows.filter(F.col("category_id").isNotNull()).unionByName(
            placed.select("image_id", F.col("item_category").alias("category_id"), "ts")
        )
    return (
        rows.filter(F.col("category_id").isNotNull())
        .groupBy("category_id")
        .agg(F.max("ts").alias("last_updated"))
    )


def stream_deletion_queue(changes: DataFrame) -> DataFrame:
    """First deletion per item of a change stream; state is one row per deleted item."""
    return (
        changes.filter((F.col("op") == "DELETE") & F.col("image_id").isNotNull())
        .groupBy("image_id")
        .agg(F.min("ts").alias("queued_at"))
    )


def write_queue(queue: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a streamed queue's updates below ``folder``, one subfolder per
    micro-batch; a replayed batch replaces its own subfolder."""
    def store(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        queue.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(store)
        .start()
    )


def read_recompute_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The queue as of the last written batch."""
    return spark.read.parquet(folder).groupBy("category_id").agg(F.max("last_updated").alias("last_updated"))


def read_deletion_queue(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).groupBy("image_id").agg(F.min("queued_at").alias("queued_at"))

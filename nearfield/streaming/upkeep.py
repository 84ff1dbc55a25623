"""Upkeep driven by a stream of vector changes.

Each micro-batch adds its changes to the queues left by the one before, drains
them, and writes the outcome under its own batch id:

    {folder}/state/{table}/batch={id}

A replayed batch reads the same predecessor and replaces the same folders, so
repeating it changes nothing.
"""

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.bounds import bounded
from nearfield.operators.maintenance import (
    deletion_queue,
    drain_deletions,
    drain_recompute,
    recompute_queue,
)
from nearfield.schemas import CATALOG, DELETION_QUEUE
from nearfield.session import cut_lineage
from nearfield.sources.catalog import read_table
from nearfield.sources.index_store import save_index
from nearfield.sources.sinks import read_members

_STATE = {
    "prototypes": CATALOG["prototypes"],
    "recompute_queue": CATALOG["recompute_queue"],
    "deletion_queue": CATALOG["deletion_queue"],
    "indexes": CATALOG["indexes"],
    "removed": DELETION_QUEUE,
}


@dataclass
class Upkeep:
    """How to keep one catalog folder current.

    Drained items are recorded in ``removed``, to be left out by
    ``index_remove`` until a rebuild on its own schedule. With ``rebuild`` a
    new index is written whenever deletions are drained; meant for indexes
    small enough to be written so often. With ``members`` (a ``write_members`` folder)
    prototypes are recomputed from the stale categories' folders alone.
    """

    catalog_folder: str
    folder: str
    process_prototypes: bool = True
    process_deletions: bool = True
    rebuild: bool = False
    index_type: str = "flatl2"
    nlist: int = 100
    members: str | None = None

    def state_path(self, table: str, batch_id: int) -> str:
        return f"{self.folder}/state/{table}/batch={batch_id}"

    def index_path(self, batch_id: int) -> str:
        return f"{self.folder}/index/batch={batch_id}"

    def read(self, spark: SparkSession, table: str, batch_id: int | None) -> DataFrame:
        """A state table as a batch left it, or as the catalog had it before the first."""
        if batch_id is not None and batch_id >= 0:
            return spark.read.schema(_STATE[table]).parquet(self.state_path(table, batch_id))
        if table == "removed":
            return spark.createDataFrame([], _STATE[table])
        return read_table(spark, self.catalog_folder, table)

    def last_batch(self, spark: SparkSession) -> int | None:
        """The last batch that finished."""
        return spark.read.parquet(f"{self.folder}/state/committed").agg(F.max("batch")).first()[0]

    def _committed(self, spark: SparkSession) -> int:
        """The last finished batch, -1 when none is."""
        try:
            last = self.last_batch(spark)
        except AnalysisException:
            return -1
        return -1 if last is None else last

    def process(self, changes: DataFrame, batch_id: int) -> None:
        """Apply one micro-batch of changes (image_id, category_id, op, ts)."""
        spark = changes.sparkSession
        if batch_id == 0 and self._committed(spark) > 0:
            raise ValueError(f"{self.folder} holds the state of another checkpoint; go on with that one or take a new folder")
        before = {table: self.read(spark, table, batch_id - 1) for table in _STATE}
        images = read_table(spark, self.catalog_folder, "images")
        vectors = read_table(spark, self.catalog_folder, "vectors")

        changes = changes.persist()
        try:
            stale = cut_lineage(recompute_queue(changes, images, before["recompute_queue"]))
            doomed = cut_lineage(deletion_queue(changes, before["deletion_queue"]))
            # The last change of an item decides whether it is gone; of changes at one instant, the one last by name.
            last = changes.groupBy("image_id").agg(
                F.max_by("op", F.struct("ts", "op")).alias("op"),
                F.min(F.when(F.col("op") == "DELETE", F.col("ts"))).alias("queued_at"),
            )
            gone = last.filter(F.col("op") == "DELETE").select("image_id", "queued_at")
            earlier = before["removed"].join(last, "image_id", "left_anti")
            removed = cut_lineage(earlier.unionByName(gone))
        finally:
            changes.unpersist()

        gone = bounded(removed.select("image_id"))
        live = vectors.join(gone, "image_id", "left_anti")
        averaged = live
        if self.members is not None:
            averaged = read_members(spark, self.members).join(gone, "image_id", "left_anti")
        after = {
            "prototypes": before["prototypes"], "recompute_queue": stale,
            "deletion_queue": doomed, "indexes": before["indexes"], "removed": removed,
        }
        if self.process_prototypes:
            drained = drain_recompute(stale, averaged, images, before["prototypes"])
            after["prototypes"], after["recompute_queue"] = drained.prototypes, drained.pending
        if self.process_deletions:
            if self.rebuild:
                path = self.index_path(batch_id)
                rebuilt = drain_deletions(
                    doomed, live, images, before["indexes"], path, self.index_type,
                    nlist=self.nlist, readded=doomed.join(removed, "image_id", "left_anti"),
                )
                if rebuilt is not None:
                    save_index(rebuilt.index, path, mode="overwrite")
                    after["indexes"], after["deletion_queue"] = rebuilt.indexes, rebuilt.remaining(doomed)
            else:
                after["deletion_queue"] = doomed.limit(0)
        for table, rows in after.items():
            rows.write.mode("overwrite").parquet(self.state_path(table, batch_id))
        done = spark.createDataFrame([(True,)], "done boolean")
        done.write.mode("overwrite").parquet(self.state_path("committed", batch_id))

    def start(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            changes.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .foreachBatch(self.process)
            .start()
        )


def run_maintenance(changes: DataFrame, upkeep: Upkeep, checkpoint: str,
                    interval: str = "30 seconds") -> StreamingQuery:
    """Drain both queues at the given interval until the query is stopped."""
    return upkeep.start(changes, checkpoint, processingTime=interval)


def drain_now(changes: DataFrame, upkeep: Upkeep, checkpoint: str) -> dict[str, DataFrame]:
    """Process all changes that have arrived, then return the state tables."""
    spark = changes.sparkSession
    upkeep.start(changes, checkpoint, availableNow=True).awaitTermination()
    last = upkeep.last_batch(spark)
    return {table: upkeep.read(spark, table, last) for table in _STATE}

"""The catalog tables derived from the sample tables.

embeddings are the vectors, documents the items, events the changes.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.scalars import content_sha256, metadata_json
from nearfield.operators.bounds import carried
from nearfield.operators.maintenance import deletion_queue, recompute_queue
from nearfield.operators.prototypes import all_prototypes
from nearfield.operators.reports import recount_items
from nearfield.sources.catalog import default_categories
from nearfield.sources.sinks import conform


class SampleCatalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._schemas = {}
        self._labels = None

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def images(self) -> DataFrame:
        content = F.encode("text", "UTF-8")
        items = self.table("documents").select(
            F.col("doc_id").alias("image_id"),
            content.alias("content"),
            metadata_json("source", "lang", "n_chars").alias("metadata"),
            content_sha256(content).alias("content_hash"),
        )
        number = F.coalesce(F.col("label") + 1, F.pmod("image_id", F.lit(10)) + 1)
        return items.join(self.labels(), F.col("image_id") == F.col("vec_id"), "left").select(
            "image_id", "content", "metadata", number.cast("int").alias("category_id"), "content_hash",
        )

    def labels(self) -> DataFrame:
        """vec_id and label; they travel to the items, which would be shuffled with their contents, where their number allows it."""
        if self._labels is None:
            self._labels = carried(self.table("embeddings").select("vec_id", "label"))
        return self._labels

    def vectors(self) -> DataFrame:
        index_id = F.when(F.col("vec_id") % 3 != 0, 1 + F.col("vec_id") % 2).cast("int")
        return self.table("embeddings").select(
            F.col("vec_id").alias("vector_id"), "embedding",
            index_id.alias("index_id"), F.col("vec_id").alias("image_id"),
        )

    def queries(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")

    def categories(self) -> DataFrame:
        return recount_items(default_categories(self.spark), self.images())

    def prototypes(self) -> DataFrame:
        return all_prototypes(self.vectors(), self.images())

    def indexes(self) -> DataFrame:
        held = self.vectors().filter(F.col("index_id").isNotNull())
        return held.groupBy("index_id").agg(
            F.max(F.size("embedding")).alias("dim"), F.count(F.lit(1)).alias("ntotal")
        ).select(
            "index_id", F.lit("flatl2").alias("index_type"),
            F.concat(F.lit("index/"), "index_id").alias("path"), "dim", "ntotal",
        )

    @staticmethod
    def as_changes(events: DataFrame) -> DataFrame:
        """Changes of events, batch or stream; only deletions carry a category."""
        op = (
            F.when(F.col("event_type") == "error", "DELETE")
            .when(F.col("event_type") == "view", "UPDATE")
            .otherwise("INSERT")
        )
        carried = F.when(F.col("event_type") == "error", (F.col("event_id") % 10 + 1).cast("int"))
        return events.select(
            F.col("user_id").alias("image_id"), carried.alias("category_id"),
            op.alias("op"), F.col("ts").cast("timestamp").alias("ts"),
        )

    def changes(self) -> DataFrame:
        return self.as_changes(self.table("events"))

    def change_stream(self) -> DataFrame:
        schema = self.table("events").schema
        # A file or a folder of part files: the pattern names either.
        return self.as_changes(self.spark.readStream.schema(schema).parquet(f"{self.folder}/events.parque[t]"))

    def recompute_queue(self) -> DataFrame:
        return recompute_queue(self.changes(), self.images())

    def deletion_queue(self) -> DataFrame:
        return deletion_queue(self.changes())

    def all(self) -> dict[str, DataFrame]:
        tables = {
            "categories": self.categories(), "images": self.images(), "vectors": self.vectors(),
            "prototypes": self.prototypes(), "indexes": self.indexes(),
            "recompute_queue": self.recompute_queue(), "deletion_queue": self.deletion_queue(),
        }
        return {name: conform(rows, name) for name, rows in tables.items()}

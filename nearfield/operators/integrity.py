"""Foreign-key and uniqueness checks, as one report of violations."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.bounds import bounded

# Child table, its column, parent table. A null reference is no orphan.
FOREIGN_KEYS = (
    ("images", "category_id", "categories"),
    ("vectors", "image_id", "images"),
    ("vectors", "index_id", "indexes"),
    ("prototypes", "category_id", "categories"),
    ("recompute_queue", "category_id", "categories"),
)

# Table, column that must be unique.
UNIQUE_KEYS = (
    ("categories", "category_id"),
    ("categories", "category_name"),
    ("images", "image_id"),
    ("images", "content_hash"),
    ("vectors", "vector_id"),
    ("vectors", "image_id"),
    ("prototypes", "category_id"),
    ("indexes", "index_id"),
    ("recompute_queue", "category_id"),
    ("deletion_queue", "image_id"),
)

# Table, column that must have a value.
NOT_NULL = (
    ("categories", "category_id"),
    ("categories", "category_name"),
    ("images", "image_id"),
    ("images", "content"),
    ("images", "category_id"),
    ("images", "content_hash"),
    ("vectors", "vector_id"),
    ("vectors", "embedding"),
    ("vectors", "image_id"),
    ("prototypes", "category_id"),
    ("prototypes", "prototype"),
    ("indexes", "index_id"),
    ("indexes", "index_type"),
    ("indexes", "path"),
    ("recompute_queue", "category_id"),
    ("deletion_queue", "image_id"),
)

# Parents small by nature; their keys travel to the children.
SMALL_TABLES = ("categories", "indexes")


def orphans(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """Child rows whose reference has no parent row."""
    referring = child.filter(F.col(column).isNotNull())
    return referring.join(parent.select(column), column, "left_anti")


def duplicate_keys(table: DataFrame, column: str) -> DataFrame:
    """Key values held by more than one row, with the number of rows."""
    return (
        table.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") > 1)
    )


def integrity_report(catalog: dict[str, DataFrame]) -> DataFrame:
    """Every broken rule: kind (orphan, duplicate, null), table_name, column_name, key_value (none for
    nulls), n_rows.

    Each table is read once for all of its unique columns, and the keys of all
    tables are counted in one aggregation.
    """
    place = ["table_name", "column_name", "key_value"]

    def entry(table, *columns):
        return F.explode(F.array(*[
            F.struct(
                F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                F.col(column).cast("string").alias("key_value"),
            ) for column in columns
        ])).alias("entry")

    def counted(kind, rows, at_least):
        found = rows.select("entry.*").filter(F.col("key_value").isNotNull())
        counts = found.groupBy(*place).agg(F.count(F.lit(1)).alias("n_rows"))
        return counts.filter(F.col("n_rows") >= at_least).select(F.lit(kind).alias("kind"), *place, "n_rows")

    def parent_keys(name, column):
        keys = catalog[name].select(column)
        return bounded(keys) if name in SMALL_TABLES else keys

    unique: dict[str, list[str]] = {}
    for table, column in UNIQUE_KEYS:
        unique.setdefault(table, []).append(column)
    keys = [catalog[table].select(entry(table, *columns)) for table, columns in unique.items()]
    lost = [
        orphans(catalog[child], parent_keys(parent, column), column).select(entry(child, column))
        for child, column, parent in FOREIGN_KEYS
    ]
    required: dict[str, list[str]] = {}
    for table, column in NOT_NULL:
        required.setdefault(table, []).append(column)

    def nulls(table, columns):
        missing = catalog[table].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_rows")) for c in columns]))
        return missing.select(rows.alias("r")).filter("r.n_rows > 0").select(
            F.lit("null").alias("kind"), F.lit(table).alias("table_name"), "r.column_name",
            F.lit(None).cast("string").alias("key_value"), "r.n_rows")

    absent = reduce(DataFrame.unionByName, [nulls(t, c) for t, c in required.items()])
    return absent.unionByName(counted("orphan", reduce(DataFrame.unionByName, lost), 1).unionByName(
        counted("duplicate", reduce(DataFrame.unionByName, keys), 2)
    ))

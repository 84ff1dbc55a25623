"""Insert-or-update of keyed tables as new snapshots."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.bounds import bounded
from nearfield.operators.ids import allocate_ids
from nearfield.session import cut_lineage

def one_per_key(new: DataFrame, key: str, order_by: str | None, last: bool) -> DataFrame:
    """One row of ``new`` for each key: the first or last by ``order_by`` (dropped), ties and
    rows without an order by their values."""
    rest = [c for c in new.columns if c not in (key, order_by)]
    place = F.struct(*([order_by] if order_by else []), *rest, F.lit(0).alias("_"))
    pick = F.max(place) if last else F.min(place)
    return new.groupBy(key).agg(pick.alias("_row")).select(key, *[f"_row.{c}" for c in rest])


def merge_by_key(existing: DataFrame, new: DataFrame, key: str, mode: str = "update", *,
                 order_by: str | None = None) -> DataFrame:
    """The rows of ``existing`` with those of ``new`` merged in by ``key``.

    'ignore' keeps the existing row of a key; 'update' takes the new one, field
    by field where the new row has a value. A key repeated in ``new`` counts
    once: its first row by ``order_by`` with 'ignore', its last with 'update'.
    """
    if mode in ("ignore", "update"):
        new = one_per_key(new, key, order_by, mode == "update")
    if mode == "ignore":
        return existing.unionByName(new.join(existing, key, "left_anti"), allowMissingColumns=True)
    if mode != "update":
        raise ValueError("mode must be 'ignore' or 'update'")
    a, b = existing.alias("a"), new.alias("b")
    merged = []
    for column in existing.columns:
        if column in new.columns:
            merged.append(F.coalesce(F.col(f"b.{column}"), F.col(f"a.{column}")).alias(column))
        else:
            merged.append(F.col(f"a.{column}"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*merged)


def upsert_categories(existing: DataFrame, new: DataFrame, mode: str = "ignore", *,
                      order_by: str | None = None) -> DataFrame:
    """Categories with new ones added; known ids are left alone or renamed."""
    merged = merge_by_key(existing, new, "category_id", mode, order_by=order_by)
    return merged.withColumn("image_count", F.coalesce("image_count", F.lit(0)).cast("long"))


def insert_categories(existing: DataFrame, names: DataFrame) -> DataFrame:
    """Categories with those of ``names`` (category_name) added that are not there yet, each once,
    under fresh ids that count on in the order of their names."""
    new = names.select("category_name").filter(F.col("category_name").isNotNull()).distinct()
    new = new.join(existing.select("category_name"), "category_name", "left_anti")
    numbered = allocate_ids(new, existing, "category_id", order_by="category_name")
    added = numbered.select(F.col("category_id").cast("int"), "category_name", F.lit(0).cast("long").alias("image_count"))
    return existing.unionByName(added)


class KeyTakenError(ValueError):
    """A key would occur twice."""


# Where the keys of a table occur, its own table first.
_REFERENCES = {
    "category_id": ("categories", "images", "prototypes", "recompute_queue"),
    "image_id": ("images", "vectors", "deletion_queue"),
    "index_id": ("indexes", "vectors"),
}


def rekey(catalog: dict[str, DataFrame], column: str, changes: DataFrame) -> dict[str, DataFrame]:
    """The catalog with keys changed by ``changes`` (old, new) in their own table and in every
    table that refers to it. Only a short list of changes travels; ``column`` is one of
    category_id, image_id, index_id.

    Keys stay unique: a key changed twice, two changes to one key, a null, and a new key
    that exists and is not itself changed are refused (KeyTakenError). Keys may be swapped.
    """
    if column not in _REFERENCES:
        raise ValueError(f"column must be one of {tuple(_REFERENCES)}")
    owner = catalog.get(_REFERENCES[column][0])
    for side in ("old", "new"):
        clash = changes.groupBy(side).count().filter(F.col(side).isNull() | (F.col("count") > 1)).first()
        if clash is not None:
            raise KeyTakenError(f"{side} {column} {clash[side]} is null or repeated")
    if owner is not None:
        # a change of a key that isn't there does nothing, so what it would free or take doesn't count
        real = changes.join(owner.select(F.col(column).alias("old")), "old", "left_semi")
        kept = real.join(real.select(F.col("old").alias("new")), "new", "left_anti")
        taken = kept.join(owner.select(F.col(column).alias("new")), "new", "left_semi").first()
        if taken is not None:
            raise KeyTakenError(f"{column} {taken['new']} exists")
    pairs = bounded(changes.select(F.col("old").alias("_old"), F.col("new").alias("_new")))

    def moved(table: DataFrame) -> DataFrame:
        key = F.coalesce("_new", column).cast(table.schema[column].dataType).alias(column)
        joined = table.join(pairs, F.col(column) == F.col("_old"), "left")
        return joined.select(*[key if c == column else F.col(c) for c in table.columns])

    return catalog | {name: moved(catalog[name]) for name in _REFERENCES[column] if name in catalog}


def upsert_prototypes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Prototypes with the new ones replacing those of the same category."""
    return merge_by_key(existing, new, "category_id", "update")


def upsert_vectors(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors with those of ``new`` (image_id, embedding[, index_id]) in place of the ones of the same item,
    which keep their vector_id, and with fresh ids for the others.

    Of several new vectors of an item the one that is last by its values counts; rows without item or vector are
    left out. Only ids of existing rows are joined to find those that go.
    """
    good = new.filter(F.col("image_id").isNotNull() & F.col("embedding").isNotNull())
    given = "index_id" in new.columns
    one = good.select(F.col("image_id").cast("long"), "embedding", (F.col("index_id") if given else F.lit(None)).cast("int").alias("index_id"))
    one = cut_lineage(one.groupBy("image_id").agg(F.max(F.struct("embedding", "index_id")).alias("_row")).select("image_id", "_row.*"))
    held = existing.select("image_id", "vector_id", F.col("index_id").alias("_old")).join(one.select("image_id"), "image_id", "left_semi")
    held = held.groupBy("image_id").agg(F.min(F.struct("vector_id", "_old")).alias("_held")).select("image_id", "_held.*")
    replaced = one.join(held, "image_id").select(
        "vector_id", "embedding", (F.coalesce("index_id", "_old")).alias("index_id"), "image_id")
    fresh = allocate_ids(one.join(held, "image_id", "left_anti"), existing, "vector_id", order_by="image_id")
    untouched = existing.join(bounded(one.select("image_id")), "image_id", "left_anti")
    columns = existing.columns
    return untouched.select(columns).unionByName(replaced.select(columns)).unionByName(fresh.select(columns))

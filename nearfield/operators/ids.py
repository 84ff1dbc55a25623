"""Serial ids for appended rows."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.bounds import MAX_SMALL_BYTES
from nearfield.session import cut_lineage

_ROW_BITS = 33  # bits of the row number within monotonically_increasing_id
_NUMBER_BYTES = 16  # of a row and its number


def _numbers(ordered: DataFrame) -> tuple[DataFrame, int]:
    """_row and _number, from 1 on, of narrow sorted rows, and how many there are.

    Only one row count per partition meets on the driver.
    """
    placed = cut_lineage(ordered.select("_row")).withColumn("_mid", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    parts, offsets, total = [], [], 0
    for part, n in sorted(placed.groupBy("_part").count().collect()):
        parts.append(part)
        offsets.append(total)
        total += n
    table = pa.table({"_part": pa.array(parts, pa.int64()), "_offset": pa.array(offsets, pa.int64())})
    known = placed.join(ordered.sparkSession.createDataFrame(table, "_part long, _offset long"), "_part")
    row_in_part = F.col("_mid") - F.shiftleft(F.col("_part"), _ROW_BITS)
    return known.select("_row", (F.col("_offset") + row_in_part + 1).alias("_number")), total


def allocate_ids(new: DataFrame, existing: DataFrame, id_column: str, *,
                 order_by: str | list[str]) -> DataFrame:
    """``new`` with ids counting on from the largest existing one, in ``order_by`` order; of rows
    that are equal in it, in the order they come.

    The rows are materialised once, where they are, so every later read sees
    the same numbering. Only order keys are sorted; the numbers travel to the
    rows where their checked size allows it, else the rows meet them by shuffle.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    rows = cut_lineage(new.drop(id_column).withColumn("_row", F.monotonically_increasing_id()))
    numbers, total = _numbers(rows.select(*keys, "_row").orderBy(*keys, "_row"))
    last = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("last")).first()["last"]
    ids = numbers.select("_row", (F.col("_number") + F.lit(last)).cast("long").alias(id_column))
    if total * _NUMBER_BYTES <= MAX_SMALL_BYTES:
        ids = F.broadcast(ids)
    return rows.join(ids, "_row").select(id_column, *[c for c in rows.columns if c != "_row"])

"""Size checks before anything is sent to every task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SMALL_ROWS = 100_000
MAX_SMALL_BYTES = 64 << 20
# A row of a few numbers in a hash table, generously.
ROW_BYTES = 32


def bounded(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``df`` as a local table when it has at most ``max_rows`` (MAX_SMALL_ROWS)
    rows and MAX_SMALL_BYTES bytes, else ``df``.

    Spark knows the exact size of a local table, so it broadcasts a small one
    by itself; a large one is joined by shuffle. Meant for narrow results that
    are usually small, such as aggregates and id lists; a large one is computed
    again by the join.
    """
    most = MAX_SMALL_ROWS if max_rows is None else min(max_rows, MAX_SMALL_ROWS)
    table = df.limit(most + 1).toArrow()
    if table.num_rows > most or table.nbytes > MAX_SMALL_BYTES:
        return df
    return df.sparkSession.createDataFrame(table, df.schema)


def carried(df: DataFrame) -> DataFrame:
    """``bounded``, and more rows than that marked to travel when their counted number fits MAX_SMALL_BYTES.

    Meant for keys and short numbers that a wide table would otherwise be shuffled for; ``df`` is read again by the count.
    """
    small = bounded(df)
    if small is not df:
        return small
    return F.broadcast(df) if df.count() * ROW_BYTES <= MAX_SMALL_BYTES else df

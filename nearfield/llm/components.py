"""Connected components of a link table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``links`` (a, b).

    Large stars and small stars in turn: each turn hangs neighbours on the smallest one, until nothing changes. A node
    with very many links costs a partial minimum and a join that adaptive execution can split.
    """
    edges = stored(_larger_first(links.select("a", "b")), "links")
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = _larger_first(large)
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = stored(_larger_first(small), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component")))


def _larger_first(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

"""Mixing sources to target weights.

The words of a source, document after document, are packed into blocks of a fixed number of words. A source's target
becomes a quota of block slots. Output shards have a fixed number of slots; how many of them each source gets is drawn
per shard from a multinomial conditioned on the quotas (by halving the range of shards again and again, so any task
draws its own shards alone and all shards together use up every quota). The k-th slot of a source goes through a
pseudorandom permutation of its block numbers, a new one in each pass over the source, and slots meet blocks by number.

Nulls: a null text has no words; null sources form one source, the last. A null doc_id is a document like others.
Documents without words take part with 0 words. Rows that agree in doc_id and size are told apart by number only.
An empty table gives no rows. Other columns of the input are not looked at.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import fresh, map_arrow, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, slots of an output shard, and documents of a group that is numbered in one task.
BLOCK_WORDS, SHARD_SLOTS, GROUP_ROWS = 256, 4096, 5_000
#: A mixture has a weight for each source; its parameters, one row for each, are kept on the driver.
MAX_SOURCES = 1_000_000
#: Slots from which numpy draws no hypergeometric numbers; then sources are drawn one after the other, with a normal
#: distribution where about so many or more vary.
_DRAWABLE, _MANY = 10**9, 1_000


@dataclass
class Mixture:
    """sources: source, source_no, source_size, target. plan: shard, slot, source_no, block.
    takes: source_no, block, times. pieces: doc_id, size, source_no, bucket, rank, block, first, words."""

    sources: DataFrame
    plan: DataFrame
    takes: DataFrame
    pieces: DataFrame


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of ``sum(sizes)`` by weight, none above ``most`` times its size; what is cut off is shared again by
    weight among the others."""
    total, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] / weight * total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] / weight * total
            break
        for i in full:
            out[i] = most * sizes[i]
        total -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def quota(size: int, target: float, block_words: int, most: int = 3) -> int:
    """Slots that take about ``target`` words from a source; never more than ``most`` passes."""
    if not size:
        return 0
    blocks, passes = -(-size // block_words), min(int(target // size), most)
    rest = min(blocks, round((target - passes * size) / block_words)) if passes < most else 0
    return passes * blocks + rest


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) puts ``index``: a Feistel network, walked until it is below n."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for turn in range(4):
            mixed = (right + np.uint64((key * 4 + turn) & (2**63 - 1))) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def split_counts(counts: np.ndarray, slots: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of ``slots`` slots each source gets when they are drawn from ``counts`` without putting back."""
    total = int(counts.sum())
    if total < _DRAWABLE:
        return np.random.default_rng(seed).multivariate_hypergeometric(counts, slots, method="marginals")
    rng, out, rest, left = np.random.default_rng(seed), np.zeros_like(counts), total, slots
    for i, c in enumerate(counts.tolist()):
        out[i] = _drawn(rng, c, rest, left)
        rest, left = rest - c, left - int(out[i])
    return out


def _drawn(rng, own: int, total: int, slots: int) -> int:
    """How many of ``slots`` drawn from very many slots are of the ``own`` ones: normal where many vary, else binomial."""
    if not own or not slots or own == total or slots == total:
        return min(own, slots)
    few, drawn = min(own, total - own), min(slots, total - slots)
    if few * (drawn / total) * (1 - few / total) >= _MANY:
        spread = math.sqrt(own * (slots / total) * (1 - own / total) * ((total - slots) / (total - 1)))
        got = own * slots // total + round(rng.normal(0, spread))
    else:
        got = int(rng.binomial(min(few, drawn), max(few, drawn) / total))  # of the few, in the smaller side
        got = got if slots == drawn else few - got
        got = got if own == few else slots - got
    return max(0, slots - (total - own), min(got, own, slots))


def shard_counts(counts: np.ndarray, slots: int, first: int, end: int, seed: int):
    """Yields (shard, number of earlier slots by source, slots by source) for shards ``first`` to ``end`` - 1."""
    def draw(lo, hi, here, before):
        if hi <= first or lo >= end:
            return
        if hi - lo == 1:
            yield lo, before, here
            return
        mid = (lo + hi) // 2
        left = split_counts(here, min((mid - lo) * slots, int(here.sum())), (seed, lo, hi))
        yield from draw(lo, mid, left, before)
        yield from draw(mid, hi, here - left, before + left)

    shards = -(-int(counts.sum()) // slots)
    if shards:
        yield from draw(0, shards, counts, np.zeros_like(counts))


def _plan(spark, quotas: list[int], blocks: list[int], slots: int, seed: int) -> DataFrame:
    counts = np.array(quotas, dtype=np.int64)
    shards = -(-int(counts.sum()) // slots)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            for shard, before, here in shard_counts(counts, slots, int(ids[0]), int(ids[-1]) + 1, seed):
                source, block = [], []
                for s in np.flatnonzero(here):
                    k = np.arange(before[s], before[s] + here[s])
                    at = np.empty(len(k), dtype=np.int64)
                    for turn in np.unique(k // blocks[s]):
                        own = k // blocks[s] == turn
                        at[own] = permuted(k[own] % blocks[s], blocks[s], hash((seed, int(s), int(turn))) & 0xFFFFFFFFFFFF)
                    source.append(np.full(len(k), s))
                    block.append(at)
                order = np.random.default_rng((seed, shard)).permutation(int(here.sum()))
                yield pa.RecordBatch.from_pydict({
                    "shard": np.full(len(order), shard), "slot": np.arange(len(order)),
                    "source_no": np.concatenate(source)[order], "block": np.concatenate(block)[order],
                })

    numbers = spark.range(0, max(shards, 0), 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism)))
    return map_arrow(numbers, run, "shard long, slot long, source_no long, block long")


def mix(
    docs: DataFrame, weights=(1, 2, 3), total: float = 1.0, most: int = 3, block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS, seed: int = 17,
) -> Mixture:
    """The mixture of ``docs`` (doc_id, text, source) that takes ``total`` times all words.

    Sources in code point order, null last, get ``weights`` in turn; no source is passed over more than ``most`` times.
    """
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    rows = sorted(
        sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect(),
        key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")),
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mixture has {MAX_SOURCES} sources at most")
    sizes = [r["size"] for r in rows]
    aims = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(rows))], most / total)
    aims = [a * total for a in aims]
    sources = spark.createDataFrame(
        [(r.source, i, s, t) for i, (r, s, t) in enumerate(zip(rows, sizes, aims))],
        "source string, source_no long, source_size long, target double",
    )
    blocks = [-(-s // block_words) for s in sizes]
    plan = stored(_plan(spark, [quota(s, t, block_words, most) for s, t in zip(sizes, aims)], blocks, shard_slots, seed), "mix-plan")
    takes = plan.groupBy("source_no", "block").agg(F.count("*").alias("times"))

    buckets = 1 + sum(r["n"] for r in rows) // GROUP_ROWS
    placed = sized.join(sources.select(F.col("source").alias("_s"), "source_no"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("words")).select(
        "source_no", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size")
    placed = placed.select("*", F.row_number().over(inside).alias("rank"), (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"))
    placed = placed.join(base, ["source_no", "bucket"]).withColumn("start", F.col("start") + F.col("base"))
    b = F.lit(block_words)
    last = F.floor((F.col("start") + F.col("size") - 1) / b)
    pieces = placed.select(
        "doc_id", "size", "source_no", "bucket", "rank", "start",
        F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), last))).alias("block"),
    )
    first = F.greatest(F.lit(0), F.col("block") * b - F.col("start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * b - F.col("start"))
    pieces = pieces.select("doc_id", "size", "source_no", "bucket", "rank", "block", first.alias("first"), (end - first).alias("words"))
    return Mixture(sources, plan, takes, pieces)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each document, with the words that the mix takes of it."""
    m = mix(docs, **options)
    times = F.coalesce(F.col("words") * F.col("times"), F.lit(0))
    sums = m.pieces.join(m.takes, ["source_no", "block"], "left").groupBy("source_no", "bucket", "rank", "doc_id", "size").agg(F.sum(times).alias("taken"))
    return sums.join(m.sources.drop("source"), "source_no").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, with one row for each pass in which the mix takes words of a document.

    A pass that takes all blocks of a document keeps its text as it is, another one has the words of the blocks it
    takes, joined by spaces; n_chars follows the text. Extra columns go along.
    """
    m = mix(docs, **options)
    key, size, rank, spans = fresh("key"), fresh("size"), fresh("rank"), fresh("spans")
    per_doc = m.pieces.join(m.takes, ["source_no", "block"]).groupBy("source_no", "bucket", "rank", "doc_id", "size").agg(
        F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias(spans))  # no more pieces than the document has blocks
    same = Window.partitionBy("doc_id", "source_no", "size")
    per_doc = per_doc.select(F.col("doc_id").alias(key), F.col("source_no").alias(fresh("no")), F.col("size").alias(size), spans, F.row_number().over(same.orderBy("bucket", "rank")).alias(rank))
    no = per_doc.columns[1]
    out = docs.columns
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sources = m.sources.select(F.col("source").alias(fresh("source")), F.col("source_no").alias(no + "d"))
    rows = docs.join(sources, F.col("source").eqNullSafe(sources[sources.columns[0]])).withColumn(size + "d", words)
    numbered = rows.withColumn(rank + "d", F.row_number().over(Window.partitionBy("doc_id", no + "d", size + "d").orderBy(F.xxhash64("text"))))
    joined = numbered.join(per_doc, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(no) == F.col(no + "d")) & (F.col(size) == F.col(size + "d")) & (F.col(rank) == F.col(rank + "d")))
    turn, kept, whole = fresh("turn"), fresh("kept"), fresh("whole")
    joined = joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.array_max(F.transform(spans, lambda x: x.times)))))
    joined = joined.withColumn(kept, F.filter(spans, lambda x: x.times >= F.col(turn)))
    taken = F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x.words)
    all_words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    cut = F.array_join(F.flatten(F.transform(kept, lambda x: F.slice(F.col(whole), (x.first + 1).cast("int"), x.words.cast("int")))), " ")
    joined = joined.withColumn(whole, F.when(taken < F.col(size), all_words))
    text = F.when(taken < F.col(size), cut).otherwise(F.col("text"))
    kind = dict(docs.dtypes).get("n_chars")
    new = {"text": text} | ({"n_chars": F.length("text").cast(kind)} if kind else {})
    joined = joined.withColumn("text", text)
    return joined.select(*[new[c].alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in out])

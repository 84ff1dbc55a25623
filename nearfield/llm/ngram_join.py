"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and the groups they form.

Shingles are ordered rare first, by how often their hash cell occurs among all documents. Two sets that link share one of
the first few in this order, so only those prefix shingles are joined. A pair must also have fitting lengths, leave room
for enough shared shingles behind the positions where it meets (positional filter), and have enough in common by cells of
the hash range (suffix filter); what is left is verified once on the whole sets.

Pairs inside a group are not listed all: documents with equal sets are one class first; then each prefix shingle links
its members with the smallest one; and only pairs of different components that still share a prefix shingle are compared
after that, in tiles of bounded size. No link between different components can be missed, so the components are exact.

Nulls: a null or empty text has no shingles and links with nothing. A row with a null doc_id has its n_shingles and a
null component_id. Rows with the same doc_id are one document with several texts, linked by any of them. Empty tables
give no rows. Extra columns are not looked at.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bit_of, fresh, has_bits, hashed_set, map_arrow, stored
from nearfield.llm.components import components
from nearfield.llm.shingles import shingle_set

N, PERCENT = 4, 85
#: Cells of the frequency sketch, those sent as one row, and members of one side of a tile.
CELLS, CHUNK, TILE = 1 << 20, 1 << 16, 2048
_HOLD = 1 << 20


def required(a, b, percent: int):
    """Shared shingles that sets of sizes ``a`` and ``b`` need at least."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size + (-percent * size // 100) + 1


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """One row for each document (size, two digests of its set), and the task's counts by cell in rows of CHUNK cells."""
    def run(batches):
        counts, held, waiting = np.zeros(CELLS, dtype=np.int64), [], 0
        for batch in batches:
            sizes, low, high = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), n)
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                sizes.append(len(s))
                low.append((digest & (2**64 - 1)) - 2**63)
                high.append((digest >> 64) - 2**63)
                held.append((s & np.uint64(CELLS - 1)).astype(np.int32))
                waiting += len(s)
                if waiting > _HOLD:
                    counts += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, waiting = [], 0
            k = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                ["doc_id", "n", "d1", "d2", "chunk", "counts"])
        if waiting:
            counts += np.bincount(np.concatenate(held), minlength=CELLS)
        rows = [(i, counts[i * CHUNK : (i + 1) * CHUNK].astype(np.uint32).tobytes()) for i in range(CELLS // CHUNK) if counts[i * CHUNK : (i + 1) * CHUNK].any()]
        k = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64())] + [pa.nulls(k, pa.int64())] * 3 + [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
            ["doc_id", "n", "d1", "d2", "chunk", "counts"])

    return map_arrow(docs, run, "doc_id long, n long, d1 long, d2 long, chunk int, counts binary")


def _ranks(surveyed: DataFrame) -> np.ndarray:
    """A rank from 0 to 255 for each cell, higher where shingles are more frequent: CELLS bytes, whatever the input."""
    def fold(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[chunk] = sums.get(chunk, np.int64(0)) + np.frombuffer(counts.as_buffer(), dtype=np.uint32)
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(list(sums), pa.int32()),
            "ranks": pa.array([np.minimum(255, np.log2(c + 1.0) * 6).astype(np.uint8).tobytes() for c in sums.values()], pa.binary())})

    parts = surveyed.where("chunk IS NOT NULL").select("chunk", "counts").repartition(CELLS // CHUNK, "chunk")
    out = np.zeros(CELLS, dtype=np.uint8)
    for row in map_arrow(parts, fold, "chunk int, ranks binary").collect():
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.ranks, dtype=np.uint8)
    return out


def _prefixes(docs: DataFrame, ranks: np.ndarray, n: int, percent: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        rank = shared.value
        for batch in batches:
            sizes, prefixes = [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), n)
                sizes.append(len(s))
                if not len(s):
                    prefixes.append(None)
                    continue
                order = np.argsort(rank[(s & np.uint64(CELLS - 1)).astype(np.int64)], kind="stable")  # ties by hash
                prefixes.append(s[order[: prefix_length(len(s), percent)]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n", "prefix"])

    return map_arrow(docs, run, "doc_id long, n long, prefix array<long>")


def _may_link(na, pa_, nb, pb, percent: int):
    """Column: length and positional filter."""
    need = F.ceil(percent * (na + nb) / (100 + percent))
    room = F.least(na - pa_, nb - pb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (room >= need)


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b of different labels that share a prefix shingle and pass the filters.

    members: h, doc_id, n, pos, label, parts. The members of a shingle fall into parts of about TILE rows, and every
    pair of parts is a tile of its own, so no shingle is held whole by a task.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    placed = members.withColumn("part", part).withColumn("other", other)
    placed = placed.select(
        "h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.col("part"),
        "doc_id", "n", "pos", "label").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "n")

    def pairs(t):
        doc, n, pos, label, part, i, j = (t[c] for c in ("doc_id", "n", "pos", "label", "part", "i", "j"))
        end = np.searchsorted(n, np.floor_divide(100 * n, percent), side="right")  # n is sorted
        for x in range(len(doc)):
            y = np.arange(x + 1, end[x])
            ok = label[y] != label[x]
            if i[x] != j[x]:
                ok &= part[y] != part[x]
            y = y[ok]
            room = np.minimum(n[x] - pos[x], n[y] - pos[y])
            y = y[room >= required(n[x], n[y], percent)]
            if len(y):
                yield np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])

    def run(batches):
        names = ["h", "i", "j", "part", "doc_id", "n", "pos", "label"]
        rest = None
        for table in _with_end(batches):
            if table is not None:
                t = {c: table.column(c).to_numpy() for c in names}
                if rest is not None:
                    t = {c: np.concatenate((rest[c], t[c])) for c in names}
            else:
                t = rest
            if t is None or not len(t["h"]):
                continue
            new = np.flatnonzero((t["h"][1:] != t["h"][:-1]) | (t["i"][1:] != t["i"][:-1]) | (t["j"][1:] != t["j"][:-1])) + 1
            bounds = [0, *new.tolist(), len(t["h"])]
            whole = bounds if table is None else bounds[:-1]
            found, held = set(), 0
            for a, b in zip(whole, whole[1:]):
                if b - a < 2:
                    continue
                for low, high in pairs({c: v[a:b] for c, v in t.items()}):
                    found.update(zip(low.tolist(), high.tolist()))
                    if len(found) > 200_000:
                        yield _pair_batch(found)
                        found = set()
            if found:
                yield _pair_batch(found)
            rest = None if table is None else {c: v[whole[-1]:] for c, v in t.items()}

    return map_arrow(placed, run, "a long, b long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def _pair_batch(found: set) -> pa.RecordBatch:
    both = np.array(list(found), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def may_overlap(a: np.ndarray, b: np.ndarray, need: int, cells: int = 16) -> bool:
    """The suffix filter: by parts of the hash range, can the sets share ``need`` elements?"""
    edges = (np.arange(1, cells, dtype=np.uint64) * np.uint64(2**64 // cells))
    ca = np.diff(np.concatenate(([0], np.searchsorted(a, edges), [len(a)])))
    cb = np.diff(np.concatenate(([0], np.searchsorted(b, edges), [len(b)])))
    return int(np.minimum(ca, cb).sum()) >= need


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, in order: what verification compares."""
    return s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` that link. Texts are read again for the documents in pairs only."""
    pairs = stored(pairs, "pairs")

    def sets(side: str) -> DataFrame:
        wanted = docs.sparkSession.sparkContext.broadcast(hashed_set(pairs.select(side)))  # of fixed size

        def run(batches):
            for batch in batches:
                batch = batch.filter(pa.array(has_bits(wanted.value, batch.column(2).to_numpy())))
                found = [packed(shingle_set(t.as_py(), n)) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "shingles"])

        rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", bit_of("doc_id").alias("bit"))
        return map_arrow(rows, run, "id long, shingles binary").toDF(side, f"s{side}")

    both = pairs.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                need = required(len(s), len(t), percent)
                keep.append(may_overlap(s, t, need) and len(np.intersect1d(s, t, assume_unique=True)) >= need)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(map_arrow(both, run, "a long, b long"), "verified")


def _same_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes that rows with one doc_id belong to."""
    known = rows.where("n > 0 AND doc_id IS NOT NULL")
    again = known.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1")
    named = known.join(again, "doc_id").join(classes, ["d1", "d2"]).select("doc_id", "rep")
    least = named.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return named.join(least, "doc_id").where("a != rep").select("a", F.col("rep").alias("b")).distinct()


def _thinned(postings: DataFrame, shared: DataFrame) -> DataFrame:
    """The postings whose shingle is in ``shared`` (h); most of the others never leave their task."""
    wanted = postings.sparkSession.sparkContext.broadcast(hashed_set(shared, 1 << 27))  # of fixed size

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(has_bits(wanted.value, batch.column(4).to_numpy())))

    kept = map_arrow(postings.select("doc_id", "n", "pos", "h", bit_of("h", bits=1 << 27).alias("bit")), run, "doc_id long, n long, pos int, h long, bit long")
    return kept.join(shared, "h")


def near_groups(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    surveyed = stored(_survey(docs, n), "survey")
    ranks = _ranks(surveyed)
    rows = surveyed.where("chunk IS NULL").drop("chunk", "counts")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))

    reps = classes.select("rep").distinct()
    packed = stored(_prefixes(docs, ranks, n, percent).join(reps, F.col("doc_id") == F.col("rep"), "left_semi"), "prefixes")
    postings = packed.select("doc_id", "n", F.posexplode("prefix").alias("pos", "h"))
    shared = postings.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    members = stored(_thinned(postings, stored(shared.select("h"), "shared")).select("h", "doc_id", "n", "pos"), "members")

    first = members.groupBy("h").agg(F.min(F.struct("doc_id", "n", "pos")).alias("c"))
    stars = members.join(first, "h").where("doc_id != c.doc_id").where(
        _may_link(F.col("n"), F.col("pos"), F.col("c.n"), F.col("c.pos"), percent)).groupBy(F.col("doc_id").alias("b")).agg(F.min("c.doc_id").alias("a")).select("a", "b")  # one for each document; the rest comes later
    links = _verified(stars, docs, n, percent).unionAll(_same_ids(rows, classes))
    label = stored(components(links), "labels")

    labelled = members.join(label, F.col("doc_id") == F.col("node"), "left").select("h", "doc_id", "n", "pos", F.coalesce("component", "doc_id").alias("label"))
    labelled = stored(labelled, "labelled")
    mixed = labelled.groupBy("h").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select(
        "h", F.ceil(F.col("m") / TILE).alias("parts"))
    rest = _verified(_tiles(labelled.join(mixed, "h"), percent), docs, n, percent)
    # Links between components of the first round, then the components of those.
    names = label.select(F.col("node"), F.col("component"))
    over = rest.join(names.toDF("a", "la"), "a", "left").join(names.toDF("b", "lb"), "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    top = components(over)
    classes = classes.join(label, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("first"))
    classes = classes.join(top, F.col("first") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "first").alias("component_id"))
    linked = F.col("n") > 0
    return rows.join(classes, ["d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(linked & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its group; all columns stay."""
    groups = near_groups(docs, n, percent)
    gone = stored(groups.where("component_id != doc_id").select(F.col("doc_id").alias("id")).distinct(), "copies")
    name = fresh("id")
    return docs.join(gone.select(F.col("id").alias(name)), F.col("doc_id").cast("long") == F.col(name), "left_anti")

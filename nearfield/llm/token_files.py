"""Token ids of documents as compressed binary segments, in ascending order of doc_id.

A segment is one value of a Parquet table (bucket, segment, n_tokens, data), so Spark's writers commit it and a lost
task leaves nothing behind. ``data``, little-endian:

    8 bytes   b"NFTOKEN1"
    4 x u32   documents, ids in a block, blocks, crc32 of the document table
    documents (u8 1 if the id is known, i64 doc_id, u32 number of ids) each
    blocks    (u32 bytes, then a block of ``range_coder``) each

A document is whole in one segment. Every document ends with the end id. The start of a document is the number of ids of
all documents before it; it follows from the segments' sizes when they are read.

Nulls: a null text is empty, it has the end id only; null ids come first. Rows with equal doc_id stand side by side, all
of them. An empty table gives an empty table of segments. Extra columns are not looked at.
"""

import os
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm import range_coder
from nearfield.llm.common import map_arrow
from nearfield.session import scratch_path

END_ID = 1
#: Bytes of text in a bucket of neighbouring doc_ids, and ids in a block.
BUCKET_BYTES, BLOCK = 12 << 20, 2048
_MAGIC = b"NFTOKEN1"
_DOC = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("n", "<u4")])
_CACHE_WORDS = 200_000
#: Marks that may follow a word; an apostrophe is none of them.
_MARKS = ".,!?;:|%&$#*)"
_BREAKS = str.maketrans("\n\r\t", "   ")


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space, lowers case, and never joins what white space divides nor a
    letter or number and a mark behind it: each word is encoded once, without its last marks, and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = text.translate(_BREAKS).split(" ")
        new = set(words).difference(self.words)
        if new:
            if len(self.words) > _CACHE_WORDS:
                self.words.clear()
                self.parts = {"": b""}
                new = set(words)
            self._learn(list(new))
        return b"".join(map(self.words.__getitem__, words))

    def _learn(self, new: list[str]) -> None:
        pairs = []
        for word in new:
            stem = word.rstrip(_MARKS)
            if not stem or not unicodedata.normalize("NFC", stem[-1]).lower()[-1].isalnum():
                stem = word  # what stands before the marks might join them
            pairs.append((stem.lower() if stem.isascii() else stem, word[len(stem):]))
        unknown = [p for p in {x for pair in pairs for x in pair} if p not in self.parts]
        if unknown:
            found = self.tokenizer.encode(unknown, is_pretokenized=True, add_special_tokens=False)
            ids, at = np.array(found.ids, dtype="<u4"), np.array(found.word_ids, dtype=np.int64)
            edges = np.searchsorted(at, np.arange(len(unknown) + 1)) * 4
            raw = ids.tobytes()
            for i, part in enumerate(unknown):
                self.parts[part] = raw[edges[i] : edges[i + 1]]
        for word, (stem, marks) in zip(new, pairs):
            self.words[word] = self.parts[stem] + self.parts[marks]


class TextTokenizer(WordTokenizer):
    """Ids of texts by any tokenizer, text by text."""

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_tokenizers: dict[tuple, WordTokenizer] = {}


def tokenizer(kind: type, path: str) -> WordTokenizer:
    if (kind, path) not in _tokenizers:
        _tokenizers[kind, path] = kind(path)
    return _tokenizers[kind, path]


def pack(doc_ids: list, ids: list[bytes], block: int = BLOCK) -> bytes:
    """A segment of documents and their ids."""
    docs = np.zeros(len(doc_ids), dtype=_DOC)
    docs["known"] = [d is not None for d in doc_ids]
    docs["doc_id"] = [d or 0 for d in doc_ids]
    docs["n"] = [len(i) // 4 for i in ids]
    every = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
    blocks = range_coder.encode(every, block)
    table = docs.tobytes()
    head = np.array([len(docs), block, len(blocks), zlib.crc32(table)], dtype="<u4").tobytes()
    return b"".join([_MAGIC, head, table, *(x for b in blocks for x in (len(b).to_bytes(4, "little"), b))])


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of a segment; raises when a checksum doesn't fit."""
    if data[:8] != _MAGIC:
        raise ValueError("no segment of token ids")
    n, _, blocks, crc = (int(x) for x in np.frombuffer(data, dtype="<u4", count=4, offset=8))
    table = data[24 : 24 + n * _DOC.itemsize]
    if zlib.crc32(table) != crc:
        raise ValueError("a table of documents is damaged")
    docs, at, parts = np.frombuffer(table, dtype=_DOC), 24 + n * _DOC.itemsize, []
    for _ in range(blocks):
        size = int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    ids = [int(d) if k else None for k, d in zip(docs["known"], docs["doc_id"])]
    return ids, docs["n"].astype(np.int64), range_coder.decode(parts)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, kind: type = WordTokenizer, end_id: int = END_ID) -> None:
    """Writes the ids of every text of ``docs`` (doc_id, text) to the folder ``path``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        bucket, segment, ids, docs_, held = TaskContext.get().partitionId(), 0, [], [], 0
        encode = tokenizer(kind, tokenizer_path).encode
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = encode(text.as_py()) + end
                if held and held + len(own) > 4 * BLOCK * range_coder.LANES:
                    yield _row(bucket, segment, docs_, ids)
                    segment, ids, docs_, held = segment + 1, [], [], 0
                docs_.append(doc)
                ids.append(own)
                held += len(own)
        if docs_:
            yield _row(bucket, segment, docs_, ids)

    ordered = narrow.repartitionByRange(1 + size // BUCKET_BYTES, "doc_id").sortWithinPartitions("doc_id")
    rows = map_arrow(ordered, run, "bucket int, segment int, n_tokens long, data binary")
    rows.write.option("compression", "none").parquet(path)


def _row(bucket, segment, docs, ids):
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array([bucket], pa.int32()), "segment": pa.array([segment], pa.int32()),
        "n_tokens": pa.array([sum(map(len, ids)) // 4], pa.int64()), "data": pa.array([pack(docs, ids)], pa.binary())})


_SEGMENTS = "bucket int, segment int, n_tokens long, data binary"


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian u32) and, if asked for, ids, of the documents in
    the folder ``path``."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    before = Window.orderBy("bucket", "segment").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row for each segment
    base = segments.select(F.col("bucket").alias("b"), F.col("segment").alias("s"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for bucket, segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs, sizes, ids = unpack(data.as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                cells = [ids[a:b] for a, b in zip(starts, ends)]
                out = [
                    pa.array([bucket] * len(docs), pa.int32()), pa.array([segment] * len(docs), pa.int32()), pa.array(docs, pa.int64()),
                    pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(c.tobytes()) for c in cells], pa.int64())]
                names = ["bucket", "segment", "doc_id", "first", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([c.astype(np.int64) for c in cells], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "bucket int, segment int, doc_id long, first long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    found = map_arrow(segments.select("bucket", "segment", "data"), run, schema)
    joined = found.join(base, (F.col("bucket") == F.col("b")) & (F.col("segment") == F.col("s")))
    return joined.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def tokens_round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Writes the ids of ``docs`` to a new folder in the shared scratch space and reads them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(docs.sparkSession, path)

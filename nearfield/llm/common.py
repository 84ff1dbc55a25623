"""What several operators of this subpackage share."""

import ctypes
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.session import scratch_path, ship_package

#: ASCII upper case to lower case, byte by byte; other characters stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` where workers can import this package. Workers live on after a task, but give back what it freed."""
    ship_package(df.sparkSession)
    return df.mapInArrow(_released(function), schema)


def _released(function):
    """``function``, and then freed memory goes back to the system: the next stages, Python or not, have it."""

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps its own counsel
            pass

    return run


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: it is
    computed once, and a lost executor loses none of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def held_out(doc_id: str = "doc_id"):
    """Column: crc32 of the id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def held_out_id(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cased runs without ASCII white space (0x09-0x0D, 0x20)."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(LOWER).split()


#: Bits of a hashed set of keys, and those sent as one row.
SET_BITS, SET_CHUNK = 1 << 26, 1 << 20


def bit_of(*columns: str, bits: int = SET_BITS):
    """Column: the bit of a key in a hashed set."""
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def hashed_set(keys: DataFrame, bits: int = SET_BITS) -> np.ndarray:
    """The keys (all columns, or the column ``bit`` where there is one) as one bit each of ``bits``: a set of fixed size
    that has every key and perhaps others.

    It thins out rows before a join that decides exactly; with very many keys it thins less, and the result is the same.
    """
    chunk = F.col("bit").bitwiseAND(F.lit(SET_CHUNK - 1)).cast("int")

    def fold(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            chunks, offsets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(chunks):
                parts.setdefault(int(c), np.zeros(SET_CHUNK, dtype=bool))[offsets[chunks == c]] = True
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(list(parts), pa.int32()), "bits": pa.array([np.packbits(b).tobytes() for b in parts.values()], pa.binary())})

    placed = keys.select("bit" if "bit" in keys.columns else bit_of(*keys.columns, bits=bits).alias("bit")).select(
        F.shiftright("bit", SET_CHUNK.bit_length() - 1).cast("int").alias("chunk"), chunk.alias("offset")).distinct()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in map_arrow(placed.repartition(min(64, bits // SET_CHUNK), "chunk"), fold, "chunk int, bits binary").collect():
        at = row.chunk * SET_CHUNK // 8
        out[at : at + SET_CHUNK // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def has_bits(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 3] >> (7 - (bits & 7)) & 1).astype(bool)

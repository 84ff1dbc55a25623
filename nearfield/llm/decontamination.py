"""Benchmark decontamination by a generalised suffix automaton.

All benchmark items, as sequences of lower-cased words, go into one suffix automaton. The words of each document stream
through it; after each word the automaton's state gives the longest match with any item that ends there. Where that
match is as long as the window, a window of an item ends, and its words are hit. An item shorter than the window is one
window itself.

Nulls: a null or empty text has no words, no hits and an empty list of items. Items without words or with a null item_id
never match. Repeated items count once; repeated documents give equal rows. Empty tables: no documents give no rows, no
items give no hits. Only doc_id and text, item_id and text are looked at.
"""

import pickle
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import LOWER, bit_of, fresh, has_bits, hashed_set, map_arrow, stored

WINDOW = 10
#: An automaton is held by every Python worker: more items than these words make up go into further automata,
#: each with a pass of its own over the documents.
PART_WORDS = 250_000
#: Items that are numbered in one task, and bytes of a serialised automaton in one row.
GROUP_ITEMS, CHUNK = 5_000, 1 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in a text that still has its upper case
_SPLIT = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in LOWER)
_FILTER = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_SPLIT).split()


class Automaton:
    """A suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        pairs, self.shortest = [], window
        ends = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            last = 0
            for c in ids:
                last = self._extend(last, c)
            ends.append((item, ids, last))
            pairs.append(np.array(ids, dtype=np.int64))
            self.shortest = min(self.shortest, len(ids))
        #: Items of the windows that end in a state, and of the short items that are the state's longest string.
        self.items: dict[int, set[str]] = defaultdict(set)
        self.short: dict[int, set[str]] = defaultdict(set)
        for item, ids, last in ends:
            if len(ids) < window:
                self.short[last].add(item)
                continue
            for state, length in self._walk(ids):
                if length >= window:
                    self.items[self._top(state)].add(item)
        # The nearest state with a short item on the way along the suffix links.
        self.nearest = [-1] * len(self.link)
        for v in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.nearest[v] = v if v in self.short else self.nearest[self.link[v]] if v else -1
        self.known = np.zeros(_FILTER, dtype=bool)
        for ids in pairs:
            self.known[self._pair(ids[:-1], ids[1:])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7_919) & (_FILTER - 1)

    def _copy(self, state: int, target: int, c: int, length: int) -> int:
        clone = len(self.link)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(length)
        self.link[target] = clone
        while state >= 0 and self.next[state].get(c) == target:
            self.next[state][c] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, c: int) -> int:
        target = self.next[last].get(c)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._copy(last, target, c, self.length[last] + 1)
        new = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and c not in self.next[state]:
            self.next[state][c] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][c]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._copy(state, target, c, self.length[state] + 1)
        return new

    def _walk(self, ids):
        """The state and the length of the longest match after each word."""
        state, length = 0, 0
        for c in ids:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            yield state, length

    def _top(self, state: int) -> int:
        """The state of the last ``window`` words of what ends in ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, in order and apart, and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.vocabulary or len(words) < self.shortest:
            return spans, items
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        # Only runs whose neighbouring words are neighbours in some item can hold a window.
        if self.shortest > 1:
            joined = (ids[:-1] >= 0) & (ids[1:] >= 0) & self.known[self._pair(ids[:-1], ids[1:])]
        else:
            joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).astype(np.int8)))
        runs = [(int(a), int(b) + 1) for a, b in zip(edge[::2], edge[1::2]) if b - a + 1 >= self.shortest]
        if self.shortest == 1:
            alone = (ids >= 0) & ~np.concatenate((joined, [False])) & ~np.concatenate(([False], joined))
            runs = sorted(runs + [(int(i), int(i) + 1) for i in np.flatnonzero(alone)])
        for begin, end in runs:
            for i, (state, length) in enumerate(self._walk(ids[begin:end].tolist()), begin):
                hit = 0
                if length >= self.window:
                    items |= self.items[self._top(state)]
                    hit = self.window
                v = self.nearest[state]
                while v >= 0:
                    if self.length[v] <= length:
                        items |= self.short[v]
                        hit = max(hit, self.length[v])
                    v = self.nearest[self.link[v]] if v else -1
                if hit:
                    first = i - hit + 1
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i + 1))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Packed:
    """A serialised automaton, which a worker unpacks when it is first used."""

    def __init__(self, data: bytes):
        self.data, self.made = data, None

    def automaton(self) -> Automaton:
        if self.made is None:
            self.made, self.data = pickle.loads(self.data), b""
        return self.made


def benchmark_parts(items: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """part, no, data: serialised automata of all items in rows of CHUNK bytes, built in tasks and stored.

    A part has the items that begin within ``part_words`` words of a running sum. Longer items are cut before, into
    pieces that share ``window`` - 1 words, so that every window is in one of them.
    """
    named = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    step = max(1, part_words)

    def split(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                last = max(1, len(words) - window + 1) if words else 0
                rows += [(item, own) for own in (words[k : k + step + window - 1] for k in range(0, last, step))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([b" ".join(r[1]) for r in rows], pa.binary()), pa.array([len(r[1]) for r in rows], pa.int64())],
                ["item", "words", "size"])

    pieces = stored(map_arrow(named, split, "item string, words binary, size long"), "items")
    n, total = pieces.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    grouped = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "words"), F.lit(1 + n // GROUP_ITEMS)))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each bucket
    base = grouped.groupBy("bucket").agg(F.sum("size").alias("all")).select("bucket", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("item", "words").rowsBetween(Window.unboundedPreceding, 0)
    placed = grouped.withColumn("end", F.sum("size").over(inside)).join(base, "bucket").select(
        F.floor((F.col("base") + F.col("end") - F.col("size")) / F.lit(step)).alias("part"), "item", "words")
    placed = placed.repartition(min(2_000, 1 + total // step), "part").sortWithinPartitions("part")

    def build(part, rows):
        data = pickle.dumps(Automaton([(item, words.split(b" ")) for item, words in rows], window), pickle.HIGHEST_PROTOCOL)
        for no, at in enumerate(range(0, len(data), CHUNK)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([no], pa.int32()), pa.array([data[at : at + CHUNK]], pa.binary())], ["part", "no", "data"])

    def run(batches):
        part, rows = None, []
        for batch in batches:
            for p, item, words in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and p != part:
                    yield from build(part, rows)
                    rows = []
                part = p
                rows.append((item, words))
        if rows:
            yield from build(part, rows)

    return stored(map_arrow(placed, run, "part long, no int, data binary"), "automata")


def _part_numbers(parts: DataFrame) -> list[int]:
    return sorted(r.part for r in parts.select("part").distinct().collect())


def _shared(parts: DataFrame, number: int | None, window: int):
    """The broadcast of one serialised automaton: all that the driver holds of the items at a time."""
    rows = [] if number is None else parts.where(F.col("part") == number).select("no", "data").collect()
    data = b"".join(r["data"] for r in sorted(rows, key=lambda r: r.no)) or pickle.dumps(Automaton([], window))
    return parts.sparkSession.sparkContext.broadcast(Packed(data))


def _hits(docs: DataFrame, shared) -> DataFrame:
    """``docs`` (text first) with n_words, spans of hit words as begin and end in turn, and items."""
    extra = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def run(batches):
        matcher = shared.value.automaton()
        for batch in batches:
            n, spans, items = [], [], []
            for text in batch.column(0):
                words = words_of(text.as_py())
                s, i = matcher.match(words)
                n.append(len(words))
                spans.append([x for pair in s for x in pair])
                items.append(sorted(i))
            kept = [batch.column(k) for k in range(1, batch.num_columns)]
            names = batch.schema.names[1:] + extra.names
            new = [pa.array(x, t) for x, t in zip((n, spans, items), extra.types)]
            yield pa.RecordBatch.from_arrays(kept + new, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:])
    return map_arrow(docs, run, f"{schema}, n_words long, spans array<int>, items array<string>")


def _merged_hits(docs: DataFrame, parts: DataFrame, numbers: list[int], window: int) -> DataFrame:
    """d, k (hash of the text), spans, items of the documents with hits: a pass for each automaton, one after the other."""
    keyed = docs.select("text", "doc_id", F.xxhash64("text").alias("key"))
    every = None
    for number in numbers:
        shared = _shared(parts, number, window)
        found = stored(_hits(keyed, shared).where("size(spans) > 0").select("doc_id", "key", "spans", "items").distinct(), "hits")
        shared.destroy()
        every = found if every is None else every.unionAll(found)
    joined = every.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("all"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches):
        for batch in batches:
            spans = [merged([p for s in each for p in zip(s[::2], s[1::2])]) for each in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([[x for p in s for x in p] for s in spans], pa.list_(pa.int32())), batch.column(3)],
                ["d", "k", "spans", "items"])

    return stored(map_arrow(joined, run, f"d {dict(docs.dtypes)['doc_id']}, k long, spans array<int>, items array<string>"), "merged-hits")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, n_words, spans (begin and end word in turn), items (sorted): one row for each document.

    One pass over the documents for each automaton. With several, hits of the same document meet by id and text hash.
    """
    parts = benchmark_parts(benchmark, window, part_words)
    numbers = _part_numbers(parts)
    if len(numbers) < 2:
        return _hits(docs.select("text", "doc_id"), _shared(parts, *(numbers or [None]), window))
    joined = _merged_hits(docs, parts, numbers, window)
    counted = _hits(docs.select("text", "doc_id", F.xxhash64("text").alias("key")), _shared(parts, None, window)).select("doc_id", "key", "n_words")
    return counted.join(joined, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast("array<int>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """What ``contamination`` found, as counts and a hash of the item ids."""
    at = F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))
    width = F.aggregate(F.when(F.size("spans") > 0, at).otherwise(F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, i: a + F.get("spans", i + 1) - F.get("spans", i))
    return found.select(
        "doc_id", "n_words", width.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """The rows of ``docs`` without the hit spans; a document of which more than ``max_coverage`` of the words is hit goes.

    Spans are cut from their first to their last character. Documents without hits stay as they are; n_chars follows.
    With several automata, the spans of each are found in a pass of its own and meet the documents by id and text hash;
    the texts of documents without hits stay where they are.
    """
    parts = benchmark_parts(benchmark, window, part_words)
    numbers = _part_numbers(parts)
    names = docs.columns
    at = names.index("text")

    def cut(batch, spans_of):
        texts, keep = [], []
        for i, cell in enumerate(batch.column(at)):
            text = cell.as_py()
            words = words_of(text)
            spans = spans_of(i, words)
            keep.append(sum(b - a for a, b in spans) <= max_coverage * len(words))
            texts.append(without(text, spans) if spans and keep[-1] else text)
        columns = list(batch.columns)[: len(names)]
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    if len(numbers) < 2:
        shared = _shared(parts, *(numbers or [None]), window)

        def run(batches):
            matcher = shared.value.automaton()
            for batch in batches:
                yield cut(batch, lambda i, words: matcher.match(words)[0])

        out = map_arrow(docs, run, schema)
    else:
        d, k, spans, key, bit = (fresh(x) for x in ("d", "k", "spans", "key", "bit"))
        hits = _merged_hits(docs, parts, numbers, window).select(F.col("d").alias(d), F.col("k").alias(k), F.col("spans").alias(spans))
        wanted = docs.sparkSession.sparkContext.broadcast(hashed_set(hits.select(d, k)))  # of fixed size
        keyed = docs.withColumn(key, F.xxhash64("text")).withColumn(bit, bit_of("doc_id", key))

        def having(found: bool):
            def run(batches):
                for batch in batches:
                    has = has_bits(wanted.value, batch.column(len(names) + 1).to_numpy())
                    yield pa.RecordBatch.from_arrays(list(batch.columns)[: len(names) + found], batch.schema.names[: len(names) + found]).filter(pa.array(has == found, pa.bool_()))

            return map_arrow(keyed, run, schema + f", `{key}` long" * found)

        def run(batches):
            for batch in batches:
                found = batch.column(len(names)).to_pylist()
                yield cut(batch, lambda i, words: list(zip((found[i] or [])[::2], (found[i] or [])[1::2])))

        joined = having(True).join(hits, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(k)), "left").select(*[f"`{c}`" for c in names], spans)
        out = having(False).unionAll(map_arrow(joined, run, schema))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    words = [m.span() for m in _WORD.finditer(text)]
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:words[a][0]])
        at = words[b - 1][1]
    return "".join([*parts, text[at:]])


"""Search, mixture, token files, classifiers and the pipeline."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearfield.llm import language, mixing, quality, range_coder, token_files, topk
from nearfield.llm.common import held_out_id

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def topk_brute(rows, k, every=20):
    fine = {i: np.floor(np.array(v) * 64).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in (i for i in fine if i % every == 0):
        scores = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block,group", [(4096, 4096), (40, 3)])
def test_exact_topk(spark, monkeypatch, block, group):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP", group)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(v / np.linalg.norm(v))]) for i, v in enumerate(rng.normal(size=(260, 8)))]
    rows += [(300 + i, rows[20][1]) for i in range(60)]  # ties
    rows += [(400, None), (420, [1.0, None] + [0.0] * 6), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (None, rows[0][1]), (480, [0.5, 0.5]), (481, [1.0, 0.0]), (500, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.neighbours(df, k=7).collect())) == topk_brute(rows, 7)


def test_topk_stops_early_and_handles_little(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.neighbours(df).collect()] == [(0, 1, 1, 2048)]
    assert topk.neighbours(df.limit(0)).count() == 0


def test_targets_share_what_is_cut_off():
    got = mixing.targets([100, 10, 1000], [1.0, 2.0, 3.0])
    assert got[1] == 30 and abs(sum(got) - 1110) < 1e-9 and got[0] == pytest.approx(270) and got[2] == pytest.approx(810)
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1.0, 2.0]) == [0, 0]


def test_shard_counts_use_up_all_quotas():
    counts = np.array([1000, 3, 0, 517])
    shards = list(mixing.shard_counts(counts, 64, 0, 24, 5))
    assert sum(c for _, _, c in shards).tolist() == counts.tolist() and {int(c.sum()) for _, _, c in shards[:-1]} == {64}
    alone = [x for first in range(24) for x in mixing.shard_counts(counts, 64, first, first + 1, 5)]
    assert all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(shards, alone))


def test_splits_of_very_many_slots_are_drawn():
    counts = np.array([6 * 10**9, 40, 3 * 10**9, 0, 10**9])
    for slots in (5 * 10**9, 9_999_999_000, 4096):
        drawn = np.array([mixing.split_counts(counts, slots, (s, 0, 1)) for s in range(400)])
        assert (drawn.sum(axis=1) == slots).all() and (drawn >= 0).all() and (drawn <= counts).all()
        total = float(counts.sum())
        mean = counts * (slots / total)
        spread = np.sqrt(mean * (1 - counts / total) * ((total - slots) / (total - 1)))
        assert (abs(drawn.mean(axis=0) - mean) <= 5 * spread / 20 + 0.5).all()
        wide = spread > 1
        assert (abs(drawn.std(axis=0)[wide] / spread[wide] - 1) < 0.2).all()


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 99).tolist()) == list(range(n))


def test_mixture(documents):
    got = [r for r in mixing.taken_words(documents).collect()]
    again = {r.doc_id: r.taken for r in mixing.taken_words(documents).collect()}
    assert {r.doc_id: r.taken for r in got} == again and len(got) == documents.count()
    sizes = {r.doc_id: len([w for w in r.text.encode().split()]) for r in documents.select("doc_id", "text").collect()}
    assert {r.doc_id: r["size"] for r in got} == sizes and all(r.taken <= 3 * r["size"] for r in got)
    source = dict(documents.select("doc_id", "source").collect())
    for s in set(source.values()):
        own = [r for r in got if source[r.doc_id] == s]
        assert own[0].source_size == sum(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * mixing.BLOCK_WORDS


def test_mixture_odd_rows(odd, empty):
    got = mixing.taken_words(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 3 * r["size"] for r in got) and {r.taken for r in got if r["size"] == 0} == {0}
    assert mixing.taken_words(empty).count() == 0
    rows = mixing.mixed_documents(odd, block_words=4)
    assert rows.columns == odd.columns
    words = lambda df: df.agg(F.sum(F.size(F.split(F.trim("text"), " +")))).first()[0]
    assert words(rows.where("doc_id IN (1, 5)")) == sum(r.taken for r in mixing.taken_words(odd, block_words=4).collect() if r.doc_id in (1, 5))
    assert mixing.mixed_documents(empty).count() == 0


@pytest.mark.parametrize("n,block", [(0, 8), (1, 8), (999, 64), (3000, 3000), (5000, 100)])
def test_range_coder(n, block):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.zeros(n, np.int64), np.minimum(rng.geometric(0.1, n), 70000), rng.integers(0, 1 << 20, n)):
        blocks = range_coder.encode(ids, block)
        assert (range_coder.decode(blocks) == ids).all()
        for at in (0, len(blocks) - 1):  # every block stands alone
            if blocks:
                assert (range_coder.decode([blocks[at]]) == ids[at * block : (at + 1) * block]).all()


def test_range_coder_takes_a_few_blocks_at_a_time(monkeypatch):
    """A long document has more blocks than are coded at a time: the same bytes, whatever that number is."""
    ids = np.random.default_rng(5).geometric(0.01, 9001)
    want = range_coder.encode(ids, 64)
    active = []
    model = range_coder._Model
    monkeypatch.setattr(range_coder, "_Model", lambda lanes: active.append(lanes) or model(lanes))
    monkeypatch.setattr(range_coder, "LANES", 7)
    assert range_coder.encode(ids, 64) == want and (range_coder.decode(want) == ids).all()
    assert max(active) == 7 and sum(active) == 2 * len(want)


def test_a_very_long_text_makes_the_round_trip(spark):
    """One document of more than 8 MiB beside short ones."""
    long = "Eins two tres, " * 600_000
    df = spark.createDataFrame([(3, long), (1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in token_files.tokens_round_trip(df).collect()}
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    unit = plain.encode("Eins two tres, ", add_special_tokens=False).ids
    ids = np.array([*(unit * 600_000), 1], dtype="<u4")
    assert (got[3].n_tokens, got[3].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert got[3].start == got[1].n_tokens + got[2].n_tokens and got[2].n_tokens == 1


def test_range_coder_learns_and_notices_damage():
    ids = np.tile(np.arange(50) * 900, 100)
    blocks = range_coder.encode(ids, 5000)
    assert len(blocks[0]) < len(ids) / 2
    broken = bytearray(blocks[0])
    broken[40] ^= 255
    with pytest.raises(ValueError):
        range_coder.decode([bytes(broken)])


def test_token_files(documents, spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for df in (documents.where("doc_id < 150"), odd):
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        got = token_files.tokens_round_trip(df).orderBy("start").collect()
        start = 0
        assert len(got) == len(rows)
        for r, want in zip(got, rows):
            ids = np.array([*plain.encode(want.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
            assert tuple(r) == (want.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert token_files.tokens_round_trip(empty).count() == 0


def test_words_are_encoded_as_in_the_whole_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), token_files.WordTokenizer(path)
    for text in ("It's  a\ttest\n\nof été ́x   y z \x1c\x85q İΣ don'T 12.5% \U0001f600!!", "", " ", "a" * 5000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_segments_split_and_carry_ids(documents, spark, monkeypatch, tmp_path):
    monkeypatch.setattr(range_coder, "LANES", 2)
    few = documents.where("doc_id < 60")
    token_files.write_tokens(few, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    got = token_files.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()
    assert len(got) == 60 and all(len(r.ids) == r.n_tokens and r.ids[-1] == 1 for r in got)
    with pytest.raises(ValueError):
        token_files.unpack(b"no segment")


def test_language_held_out(documents, odd, empty):
    got = documents.select("doc_id", "lang").join(language.predict_languages(documents), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98 and all(0 <= r.score <= 1 for r in got)
    odd_rows = {r.doc_id: r for r in language.predict_languages(odd).collect()}
    assert len(odd_rows) == 7 and {odd_rows[i].lang_pred for i in (2, 3, 6)} == {"und"} and odd_rows[2].held_out == held_out_id(2)
    assert language.predict_languages(empty).count() == 0
    assert {r.lang_pred for r in language.predict_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_mixtures(documents):
    langs, logs = language.train(documents)
    by = {r.lang: r.t for r in documents.groupBy("lang").agg(F.max_by("text", "n_chars").alias("t")).collect()}
    mixed = by["en"][:6000] + " " + by["fr"][:3000]
    found = language.infer(language.window_scores(mixed, logs))
    assert [langs[i] for i, _ in found] == ["en", "fr"] and 0.55 < found[0][1] < 0.8
    assert language.infer(language.window_scores(by["de"], logs)) == [(langs.index("de"), 1.0)]
    share, _ = language.fit_mixture(np.log(np.array([[0.9, 0.1], [0.1, 0.9], [0.9, 0.1]])))
    assert share[0] > 0.6


def test_quality_held_out(spark, documents, odd, empty):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = quality.predict_quality(documents, labels)
    assert got.count() == documents.count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    few = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1), (2, 0)], "doc_id long, quality int")
    assert quality.predict_quality(odd, few).count() == odd.count() and quality.predict_quality(empty, few).count() == 0
    assert {r.score for r in quality.predict_quality(odd, few.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, few).columns == odd.columns


def test_distinct_lines_of_long_texts():
    clean = "\n".join(f"line {i} of a long and clean text" for i in range(70_000))
    half = clean + "\n" + "again\n" * 69_999 + "again"
    for text, level in ((clean, quality.LEVELS - 1), (half, int((70_001 / 140_000) ** 0.5 * quality.LEVELS)), ("a\n" * 600_000, 0), ("a\nb\n", quality.LEVELS - 1), ("\n" * 10, 3)):
        raw = text.encode()
        assert quality.distinct_lines(raw) == len(set(raw.split(b"\n")))
        assert quality.features(text)[0][-1] - quality.WORD_CELLS - (quality._STATS - 1) * quality.LEVELS == level


def test_machine_is_the_sum_over_pairs():
    m = quality.Machine(bias=0.3, seed=2)
    at, x = quality.features("Some words, some WORDS!\nand 12 more")
    plain = 0.3 + (m.w[at] * x).sum() + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert m.raw(at, x, np.zeros(1, int))[0][0] == pytest.approx(plain)


def test_pipeline(spark):
    import corpus_pipeline

    from nearfield.llm import decontamination, ngram_join

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, kept[-1], SMALL)
        assert out.columns == names
        kept.append(out.cache())
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    good = {r.doc_id for r in quality.predict_quality(docs, labels).where("predicted = 1").collect()}
    assert ids[1] == good
    assert ids[2] == {r.doc_id for r in ngram_join.near_groups(kept[1]).where("doc_id = component_id").collect()}
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontamination.digest(decontamination.contamination(kept[3], bench)).where("contaminated").count() == 0
    taken = {r.doc_id: r.taken for r in mixing.taken_words(kept[3]).collect()}
    mixed = kept[4].groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()
    assert {r.doc_id: r.n for r in mixed} == {i: t for i, t in taken.items() if t}
    last = corpus_pipeline.STAGES[4][1](spark, kept[4], SMALL)
    assert last.count() == kept[4].count()

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.operators import knn
from nearfield.operators.blocks import BestMatches


def brute_force(left, right, ids, k, metric):
    """Expected (left, id) pairs, best first, ties by id."""
    left, right = left.astype(np.float64), right.astype(np.float64)
    if metric == "l2":
        key = np.square(right[None] - left[:, None]).sum(axis=2)
    else:
        norm = [np.sqrt(np.square(side).sum(axis=1)) for side in (left, right)]
        lengths = norm[0][:, None] * norm[1][None]
        dots = (right[None] * left[:, None]).sum(axis=2)
        key = -np.where(lengths > 0, dots / np.where(lengths > 0, lengths, 1), 0.0)
    return [
        (row, int(ids[i])) for row in range(len(left)) for i in np.lexsort((ids, key[row]))[:k]
    ]


@settings(max_examples=60, deadline=None)
@given(
    seed=st.integers(0, 10_000), k=st.integers(1, 30), n=st.integers(1, 80),
    metric=st.sampled_from(["l2", "cosine"]), step=st.integers(1, 40), copies=st.booleans(),
)
def test_blocks_match_brute_force(seed, k, n, metric, step, copies):
    rng = np.random.default_rng(seed)
    left = rng.integers(-3, 4, size=(5, 3)).astype(np.float32)
    right = rng.integers(-3, 4, size=(n, 3)).astype(np.float32)
    if copies:
        right[: n // 2] = right[0]
    ids = rng.permutation(n)
    best = BestMatches(left, k, metric)
    for start in range(0, n, step):
        best.update(right[start:start + step], ids[start:start + step])
    rows, _, found = best.result()
    assert list(zip(rows.tolist(), found.tolist())) == brute_force(left, right, ids, k, metric)


def test_blocks_survive_float32_overflow():
    left = np.array([[1e30, 0.0]])
    right = np.array([[1e30, 0.0], [-1e30, 0.0], [1e30, 1e30]])
    best = BestMatches(left, 2)
    best.update(right, np.array([5, 6, 7]))
    assert best.result()[2].tolist() == [5, 7]


@pytest.fixture(scope="module")
def skewed(spark):
    """300 items of which 120 are copies of one vector."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[40:160] = vectors[40]
    items = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "image_id long, embedding array<float>"
    )
    return vectors, items


@pytest.mark.parametrize("bound,block_rows", [(8192, 1 << 14), (10, 1 << 14), (0, 37)])
def test_every_path_matches_brute_force(skewed, bound, block_rows):
    vectors, items = skewed
    queries = items.withColumnRenamed("image_id", "query_id")
    hits = knn.exact_hits(queries, items, 7, max_broadcast_rows=bound, block_rows=block_rows)
    found = [(r.query_id, r.image_id) for r in hits.orderBy("query_id", "rank").collect()]
    assert found == brute_force(vectors, vectors, np.arange(300), 7, "l2")


def test_hot_cell_is_split(skewed):
    vectors, items = skewed
    cell = F.when(F.col("image_id") < 200, 1).otherwise(F.col("image_id") % 3 + 2).alias("cell")
    placed = items.select("image_id", "embedding", cell)
    queries = placed.withColumnRenamed("image_id", "query_id")
    hits = knn.top_hits(knn.cell_grid_hits(queries, placed, 5, block_rows=20), 5)
    found = {}
    for r in hits.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.image_id)
    cells = np.where(np.arange(300) < 200, 1, np.arange(300) % 3 + 2)
    for cell_id in (1, 2, 3, 4):
        inside = np.flatnonzero(cells == cell_id)
        expected = brute_force(vectors[inside], vectors[inside], inside, 5, "l2")
        assert [(inside[row], i) for row, i in expected] == [(q, i) for q in inside for i in found[q]]


@pytest.mark.parametrize("bound", [8192, 0])
def test_fewer_items_than_k(make, bound):
    items = make([(3, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0])], "image_id long, embedding array<float>")
    queries = make([(7, [0.0, 0.0])], "query_id long, embedding array<float>")
    rows = knn.knn_exact(queries, items, 10, max_broadcast_rows=bound).orderBy("rank").collect()
    assert [(r.image_id, r.distance) for r in rows] == [(1, 0.0), (3, 0.0), (2, 1.0)]


def test_empty_sides(make):
    items = make([], "image_id long, embedding array<float>")
    queries = make([(7, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert knn.knn_exact(queries, items, 3).count() == 0
    assert knn.knn_exact(queries, items, 3, max_broadcast_rows=0).count() == 0
    none = queries.filter("query_id < 0")
    some = make([(1, [0.0, 0.0])], "image_id long, embedding array<float>")
    assert knn.knn_exact(none, some, 3).count() == 0


def test_mixed_dimensions_are_refused(make):
    items = make([(1, [0.0]), (2, [0.0, 1.0])], "image_id long, embedding array<float>")
    queries = make([(7, [0.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="dimension"):
        knn.knn_exact(queries, items, 3).collect()


def test_statistics(make):
    items = make([(1, [0.0]), (2, [2.0])], "image_id long, embedding array<float>")
    queries = make([(7, [0.0])], "query_id long, embedding array<float>")
    row = knn.hit_statistics(knn.knn_exact(queries, items, 5)).first()
    assert (row.n_hits, row.min_distance, row.max_distance, row.mean_distance) == (2, 0.0, 4.0, 2.0)
    assert row.min_score < row.mean_score < row.max_score


def test_query_blocks_scan_without_shuffling_vectors(spark, make):
    rng = np.random.default_rng(4)
    items = make([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 4)))], "image_id long, embedding array<float>")
    queries = items.select(F.col("image_id").alias("query_id"), "embedding")
    blocks = knn.knn_exact(queries, items, 5, max_broadcast_rows=50)
    grid = knn.knn_exact(queries, items, 5, max_broadcast_rows=0)
    key = lambda df: sorted((r.query_id, r.rank, r.image_id) for r in df.collect())
    assert key(blocks) == key(grid) == key(knn.knn_exact(queries, items, 5))
    assert "FlatMapCoGroups" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_equal_vectors_hold_few_candidates():
    from nearfield.operators.blocks import BestMatches

    left, right = np.ones((50, 8)), np.ones((9000, 8))
    best = BestMatches(left, 3)
    best.update(right, np.arange(9000)[::-1].copy())
    rows, value, ids = best.result()
    assert ids.reshape(50, 3).tolist() == [[0, 1, 2]] * 50 and len(best._found[0]) == 150


def test_a_task_holds_one_tile_of_values():
    import tracemalloc

    from nearfield.operators.blocks import BestMatches

    left, right = (np.random.default_rng(i).normal(size=(4096, 16)).astype(np.float32) for i in (1, 2))
    tracemalloc.start()
    best = BestMatches(left, 5)
    best.update(right, np.arange(4096))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    rows, value, ids = best.result()
    for i in range(0, 4096, 500):
        exact = np.square(right.astype(np.float64) - left[i]).sum(axis=1)
        order = np.lexsort((np.arange(4096), exact))[:5]
        assert ids[rows == i].tolist() == order.tolist() and np.allclose(value[rows == i], exact[order])


@pytest.mark.parametrize("scale", [1e-20, 1e-3, 1e12, 1e18])
def test_vectors_of_any_length_are_exact(scale):
    from nearfield.operators.blocks import BestMatches

    left, right = (scale * np.random.default_rng(i).normal(size=(60, 8)) for i in (1, 2))
    best = BestMatches(left, 4)
    best.update(right, np.arange(60))
    expected = [np.argsort(np.square(right - row).sum(axis=1))[:4].tolist() for row in left]
    assert best.result()[2].reshape(60, 4).tolist() == expected


def test_small_blocks_copy_no_row_without_bound(skewed, monkeypatch):
    _, items = skewed
    queries = items.withColumnRenamed("image_id", "query_id")
    chunks = []
    real = knn._match_grid
    monkeypatch.setattr(knn, "_match_grid", lambda q, i, *a: chunks.append(i.selectExpr("max(query_chunks)", "max(item_chunks)").first()) or real(q, i, *a))
    found = knn.top_hits(knn.flat_grid_hits(queries, items, 3, block_rows=2), 3)
    cells = knn.top_hits(knn.cell_grid_hits(queries.withColumn("cell", F.lit(1)), items.withColumn("cell", F.lit(1)), 3, block_rows=2), 3)
    key = lambda df: sorted((r.query_id, r["rank"], r.image_id) for r in df.collect())
    assert [tuple(c) for c in chunks] == [(knn.MAX_CHUNKS, knn.MAX_CHUNKS)] * 2
    assert key(found) == key(cells) == key(knn.exact_hits(queries, items, 3))

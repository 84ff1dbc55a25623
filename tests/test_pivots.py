"""The exact join by pivots against a flat search."""

import numpy as np
import pytest

from nearfield.operators import knn, pivots


def frame(spark, vectors, key, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], f"{key} long, embedding array<float>")


def shown(hits):
    return sorted((r.query_id, r["rank"], r.image_id, round(r.distance, 5)) for r in hits.select("query_id", "rank", "image_id", "distance").collect())


def clusters(n, seed, centres=12, dim=6):
    rng = np.random.default_rng(seed)
    return (20 * np.random.default_rng(9).normal(size=(centres, dim))[rng.integers(centres, size=n)] + rng.normal(size=(n, dim))).astype(np.float32)


@pytest.fixture(scope="module")
def sides(spark):
    items = clusters(1500, 1)
    items[100:600] = items[100]  # a third are copies of one vector
    return frame(spark, clusters(400, 2), "query_id"), frame(spark, items, "image_id")


@pytest.mark.parametrize("k,count,block_rows", [(1, None, 1 << 14), (7, 5, 100), (7, 1, 300), (40, 300, 1 << 14)])
def test_equal_to_a_flat_search(sides, k, count, block_rows):
    queries, items = sides
    got = knn.top_hits(pivots.pivot_hits(queries, items, k, pivots=count, block_rows=block_rows), k)
    assert shown(got) == shown(knn.exact_hits(queries, items, k))


def test_large_query_sets_take_this_way(sides, monkeypatch):
    queries, items = sides
    monkeypatch.setattr(knn, "MAX_SCANS", 0)
    taken = []
    real = pivots.pivot_hits
    monkeypatch.setattr(pivots, "pivot_hits", lambda *a, **b: taken.append(1) or real(*a, **b))
    assert shown(knn.knn_exact(queries, items, 5, max_broadcast_rows=10)) == shown(knn.knn_exact(queries, items, 5)) and taken


def test_unclustered_vectors_and_few_items(spark):
    rng = np.random.default_rng(4)
    queries = frame(spark, rng.normal(size=(50, 16)).astype(np.float32), "query_id")
    items = frame(spark, rng.normal(size=(200, 16)).astype(np.float32), "image_id")
    assert shown(knn.top_hits(pivots.pivot_hits(queries, items, 3), 3)) == shown(knn.exact_hits(queries, items, 3))
    few = items.where("image_id < 3")
    assert shown(knn.top_hits(pivots.pivot_hits(queries, few, 10, pivots=2), 10)) == shown(knn.exact_hits(queries, few, 10))
    assert pivots.pivot_hits(queries, items.limit(0), 3).count() == 0
    assert pivots.pivot_hits(queries.limit(0), items, 3).count() == 0


def test_two_vectors_under_one_query_are_both_searched(spark):
    items = frame(spark, [[0, 0], [10, 10], [11, 10]], "image_id")
    queries = frame(spark, [[0, 0.1], [10, 10.1]], "query_id", [5, 5])
    assert [r[2] for r in shown(knn.top_hits(pivots.pivot_hits(queries, items, 2, pivots=2), 2))] == [0, 1]


def test_vectors_of_clusters_go_to_few_cells(spark, sides):
    queries, items = sides
    chosen = pivots.choose_pivots(items, 40)
    bounds = pivots.cell_bounds(pivots.place_items(items, chosen), 5)
    start = pivots._visits(queries, chosen, bounds, 5, True)
    known = start.join(knn.exact_hits(queries, items, 5).where("rank = 5").selectExpr("query_id", "sqrt(distance) AS reached"), "query_id")
    more = pivots._visits(known.selectExpr("query_id", "embedding", "reached AS most"), chosen, bounds, 5, False)
    n = queries.count()
    assert start.count() == n and len(bounds) >= 25 and more.count() < 4 * n


def test_plan_moves_vectors_by_cell_only(sides):
    queries, items = sides
    plan = pivots.pivot_hits(queries, items, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "SinglePartition" not in plan


def test_vectors_that_do_not_cluster_meet_in_a_bounded_grid(spark, sides, monkeypatch):
    taken = []
    flat, cells = pivots.flat_grid_hits, pivots.cell_grid_hits
    monkeypatch.setattr(pivots, "flat_grid_hits", lambda *a, **b: taken.append("flat") or flat(*a, **b))
    monkeypatch.setattr(pivots, "cell_grid_hits", lambda *a, **b: taken.append("cells") or cells(*a, **b))
    rng = np.random.default_rng(4)
    queries = frame(spark, rng.normal(size=(300, 16)).astype(np.float32), "query_id")
    items = frame(spark, rng.normal(size=(900, 16)).astype(np.float32), "image_id")
    got = knn.top_hits(pivots.pivot_hits(queries, items, 3, block_rows=60), 3)
    assert shown(got) == shown(knn.exact_hits(queries, items, 3)) and taken == ["cells", "flat"]
    taken.clear()
    pivots.pivot_hits(*sides, 5, pivots=40, block_rows=60)
    assert taken == ["cells", "cells"]

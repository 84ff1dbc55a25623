import pytest

from nearfield.operators import prototypes as P
from nearfield.operators import search as two_stage

QUERY = "query_id long, embedding array<float>"


def test_prototypes_are_means_of_items_with_vectors(catalog):
    rows = P.all_prototypes(catalog["vectors"], catalog["images"]).orderBy("category_id").collect()
    assert [tuple(r) for r in rows] == [(1, [0.5, 0.5], 2), (2, [4.0, 0.0], 1)]


@pytest.mark.parametrize("bound", [8192, 0])
def test_ties_and_zero_vectors(make, bound):
    prototypes = make([(5, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1)], "prototypes")
    queries = make([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], QUERY)
    rows = P.top_categories(queries, prototypes, 3, max_broadcast_rows=bound).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.category_id, r.similarity) for r in rows] == [
        (1, 2, 1.0), (1, 5, 1.0), (1, 3, 0.0),
        (2, 2, 0.0), (2, 3, 0.0), (2, 5, 0.0),
        (3, 3, 0.0), (3, 2, -1.0), (3, 5, -1.0),
    ]


def test_unnamed_categories_get_a_stand_in(make, catalog):
    prototypes = make([(1, [1.0, 0.0], 1), (8, [0.0, 1.0], 1)], "prototypes")
    queries = make([(1, [1.0, 0.0])], QUERY)
    rows = P.rank_prototypes(queries, prototypes, catalog["categories"]).orderBy("rank").collect()
    assert [(r.rank, r.category_name) for r in rows] == [(1, "cat"), (2, "Category 8")]


@pytest.mark.parametrize("bound", [8192, 0])
def test_prediction_without_prototypes_defaults(make, bound):
    items = make([(5, [1.0, 0.0])], "image_id long, embedding array<float>")
    row = P.predict_category(items, make([], "prototypes"), max_broadcast_rows=bound).first()
    assert (row.image_id, row.predicted_category, row.similarity) == (5, 1, None)
    prototypes = make([(3, [0.0, 1.0], 1), (4, [2.0, 0.1], 1)], "prototypes")
    assert P.predict_category(items, prototypes, max_broadcast_rows=bound).first().predicted_category == 4


@pytest.mark.parametrize("bound", [8192, 0])
def test_hits_in_the_top_categories_are_complete(make, bound):
    images = make([(i, b"", "{}", 1 if i <= 6 else 2, str(i)) for i in range(1, 9)], "images")
    vectors = make([(i, [float(i)], None, i) for i in range(1, 9)], "vectors")
    prototypes = make([(1, [-1.0], 6), (2, [1.0], 2)], "prototypes")
    queries = make([(0, [0.5])], QUERY)
    args = (queries, vectors, images, prototypes, 1, 1)
    post = two_stage.search_postfilter(*args, max_broadcast_rows=bound)
    pre = two_stage.search_prefilter(*args, max_broadcast_rows=bound)
    assert [(r.image_id, r.rank, r.category_id) for r in post.collect()] == [(7, 1, 2)]
    assert [(r.image_id, r.rank) for r in pre.collect()] == [(7, 1)]


def test_search_drops_hits_without_item(make, catalog):
    queries = make([(0, [9.0, 9.0])], QUERY)
    found = two_stage.search(queries, catalog["vectors"], catalog["images"], catalog["categories"], limit=2)
    rows = found.collect()
    assert [r.image_id for r in rows] == [3]
    assert rows[0].used_prototype_filtering is False and rows[0].prototype_categories is None


def test_search_reports_chosen_categories(make, catalog):
    queries = make([(0, [1.0, 0.0])], QUERY)
    prototypes = P.all_prototypes(catalog["vectors"], catalog["images"])
    row = two_stage.search(
        queries, catalog["vectors"], catalog["images"], catalog["categories"], prototypes,
        use_prototypes=True, prototype_limit=2, limit=1,
    ).first()
    assert (row.image_id, row.category_name, row.prototype_categories) == (1, "cat", [2, 1])


@pytest.mark.parametrize("limit,categories", [(0, 3), (10, 0)])
def test_bounds(catalog, make, limit, categories):
    queries = make([(0, [1.0, 0.0])], QUERY)
    with pytest.raises(ValueError):
        two_stage.search(
            queries, catalog["vectors"], catalog["images"], catalog["categories"],
            limit=limit, prototype_limit=categories,
        )

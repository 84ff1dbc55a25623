from datetime import datetime

import numpy as np
import pytest

from nearfield.operators import ann
from nearfield.plans import requests

UPLOAD = "upload_id long, content binary, content_type string, size long, filename string, category_id int"


@pytest.fixture
def embedder():
    def embed(contents):
        if b"broken" in contents:
            raise RuntimeError("cannot decode")
        return np.array([[float(c == b"dogs"), 1.0] for c in contents])

    return embed


def test_upload(make, catalog, embedder):
    prototypes = make([(1, [0.0, 1.0], 1), (2, [1.0, 1.0], 1)], "prototypes")
    uploads = make([
        (1, b"cats", "image/png", 4, "a.png", None), (2, b"dogs", "image/png", None, "b.png", None),
        (3, b"cats", "image/png", 4, "c.png", None), (4, b"text", "text/plain", 4, "d.txt", None),
        (5, b"broken", "image/png", 6, "e.png", None), (6, b"owls", "image/png", 4, "f.png", 3),
    ], UPLOAD)
    index = ann.flat_build(catalog["vectors"].select("image_id", "embedding"))
    done = requests.upload(
        uploads, catalog["images"], catalog["vectors"], prototypes, embedder, datetime(2024, 1, 5), index
    )
    items = done.images.orderBy("image_id").collect()
    assert [(r.image_id, bytes(r.content), r.category_id) for r in items] == [(5, b"cats", 1), (6, b"dogs", 2), (7, b"owls", 3)]
    assert items[0].metadata == '{"filename":"a.png","content_type":"image/png","upload_source":"api"}'
    assert sorted((r.vector_id, r.image_id) for r in done.vectors.collect()) == [(10, 5), (11, 6), (12, 7)]
    assert sorted((r.image_id, r.category_id, r.op) for r in done.changes.collect()) == [
        (5, 1, "INSERT"), (6, 2, "INSERT"), (7, 3, "INSERT"),
    ]
    assert done.index.cells.count() == 7
    assert {r.upload_id: r.reject_reason for r in done.rejected.collect()} == {
        3: "Duplicate image detected", 4: "File must be an image", 5: "RuntimeError: cannot decode",
    }


def test_queries_from_contents(make, embedder):
    wanted = make([(1, b"dogs", "image/png", 4), (2, b"x", None, 1), (3, b"broken", "image/png", 6)],
                  "query_id long, content binary, content_type string, size long")
    queries, rejected = requests.embed_queries(wanted, embedder)
    assert [(r.query_id, r.embedding) for r in queries.collect()] == [(1, [1.0, 1.0])]
    assert sorted(r.query_id for r in rejected.collect()) == [2, 3]

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from nearfield import schemas  # noqa: E402
from nearfield.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(memory="6g", app="nearfield-tests")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Builds a DataFrame of a catalog table, or of any schema string."""
    def build(rows, schema):
        return spark.createDataFrame(rows, schemas.CATALOG.get(schema, schema))

    return build


@pytest.fixture
def catalog(make):
    """Three categories, the last one empty; item 4 has no vector, vector 9 no item."""
    from datetime import datetime

    return {
        "categories": make([(1, "cat", 2), (2, "dog", 2), (3, "owl", 0)], "categories"),
        "images": make([
            (1, b"img", '{"source":"a","split":"train"}', 1, "h1"),
            (2, b"img2", '{"source":"a","split":"test"}', 1, "h2"),
            (3, b"img3", '{"source":"b","split":"train"}', 2, "h3"),
            (4, b"img4", "{}", 2, "h4"),
        ], "images"),
        "vectors": make([
            (1, [1.0, 0.0], None, 1), (2, [0.0, 1.0], 1, 2), (3, [4.0, 0.0], None, 3), (9, [9.0, 9.0], 7, 9),
        ], "vectors"),
        "prototypes": make([(1, [0.5, 0.5], 2), (3, [7.0, 7.0], 1)], "prototypes"),
        "indexes": make([(1, "flatl2", "index/1", 2, 3)], "indexes"),
        "recompute_queue": make([], "recompute_queue"),
        "deletion_queue": make([(9, datetime(2024, 1, 1))], "deletion_queue"),
    }

import math

from pyspark.sql import functions as F

from nearfield.functions import scalars as S
from nearfield.functions import vectors as V


def test_vector_functions(make):
    df = make([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    rows = df.select(
        V.dot("a", "b"), V.l2_norm("a"), V.cosine("a", "b"), V.squared_l2("a", "b")
    ).collect()
    assert tuple(rows[0]) == (24.0, 5.0, 0.96, 2.0)
    assert tuple(rows[1]) == (0.0, 0.0, 0.0, 5.0)


def test_sigmoid_is_half_at_threshold(make):
    df = make([(500.0,), (0.0,)], "d double")
    half, near = (r[0] for r in df.select(V.sigmoid_score("d")).collect())
    assert half == 0.5
    assert math.isclose(near, 1 / (1 + math.exp(-5)))


def test_text_form_of_vectors(make):
    df = make([("[0.5,1.25, -2]",)], "embedding string")
    parsed = V.parse_vector_text(df, "embedding")
    assert parsed.dtypes == [("embedding", "array<float>")]
    assert parsed.first()[0] == [0.5, 1.25, -2.0]


def test_percent_text(make):
    df = make([(0.1234,), (0.0,), (None,), (1.0,)], "s double")
    assert [r[0] for r in df.select(S.percent_text("s")).collect()] == ["12.3", "N/A", "N/A", "100.0"]


def test_floored_count_and_labels(make):
    df = make([(None, -3, None, 7), (5, 2, "cat", 1)], "n long, d long, name string, id int")
    rows = df.select(S.floored_count("n", "d"), S.category_label("name", "id"), S.label_to_category("id")).collect()
    assert [tuple(r) for r in rows] == [(0, "Category 7", 8), (7, "cat", 2)]


def test_metadata_and_hash(make):
    df = make([(b"abc", '{"source":"x"}')], "content binary, metadata string")
    row = df.select(
        S.content_sha256("content"), S.metadata_field("metadata", "source"),
        S.metadata_field("metadata", "none"), S.metadata_json(F.lit(1).alias("a")),
    ).first()
    assert row[0] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert tuple(row)[1:] == ("x", None, '{"a":1}')

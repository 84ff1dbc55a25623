"""Vector arithmetic as Spark columns, in double precision."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the score curve: half similarity at this squared distance,
# and the slope there.
SCORE_THRESHOLD = 500.0
SCORE_STEEPNESS = 0.01


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_double(vector) -> Column:
    return _col(vector).cast("array<double>")


def _sum_zip(a, b, combine) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), combine), F.lit(0.0), lambda acc, x: acc + x
    )


def dot(a, b) -> Column:
    """Inner product."""
    return _sum_zip(a, b, lambda x, y: x * y)


def l2_norm(a) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a, b) -> Column:
    """Cosine similarity; 0.0 when either vector has no length."""
    lengths = l2_norm(a) * l2_norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def squared_l2(a, b) -> Column:
    """Squared Euclidean distance, the distance reported by every search here."""
    return _sum_zip(a, b, lambda x, y: (x - y) * (x - y))


def sigmoid_score(
    distance, threshold: float = SCORE_THRESHOLD, steepness: float = SCORE_STEEPNESS
) -> Column:
    """Similarity in (0, 1) from a squared distance.

    The defaults suit vectors whose good matches lie at 400 to 600; unit-norm
    vectors all score about 0.99, so rank by distance and never by score.
    """
    exponent = F.lit(float(steepness)) * (_col(distance) - F.lit(float(threshold)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(exponent))


def parse_vector_text(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Turn the text form ``"[0.1,0.2]"`` into an array of floats."""
    return df.withColumn(out or column, F.from_json(F.col(column), "array<float>"))


def to_long(df: DataFrame, key: str, vector: str, value: str = "value") -> DataFrame:
    """One row per vector element: key, pos, value."""
    return df.select(key, F.posexplode(as_double(vector)).alias("pos", value))

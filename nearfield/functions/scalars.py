"""Scalar helpers of catalog queries, all as built-in Spark expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ten category names, in order of their 1-based ids.
CATEGORY_NAMES = (
    "airplane", "automobile", "bird", "cat", "deer",
    "dog", "frog", "horse", "ship", "truck",
)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def percent_text(score) -> Column:
    """Score as a percentage with one decimal; 'N/A' when absent or zero."""
    value = _col(score)
    shown = F.format_string("%.1f", value * 100)
    return F.when(value.isNull() | (value == 0), F.lit("N/A")).otherwise(shown)


def content_sha256(content) -> Column:
    """Hex SHA-256 of the content bytes."""
    return F.sha2(_col(content), 256)


def metadata_json(*fields) -> Column:
    """JSON object of the given columns."""
    return F.to_json(F.struct(*fields))


def metadata_field(metadata, name: str) -> Column:
    """Text of a top-level JSON field, null when absent."""
    return F.get_json_object(_col(metadata), f"$.{name}")


def iso_timestamp(ts) -> Column:
    """ISO-8601 text with the session's offset; microseconds only when there are any."""
    value = _col(ts)
    fraction = F.date_format(value, "SSSSSS")
    return F.concat(
        F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.date_format(value, "xxx"),
    )


def label_to_category(label) -> Column:
    """Category id (from 1) of a class label (from 0)."""
    return (_col(label) + 1).cast("int")


def category_label(name, category_id) -> Column:
    """The category's name, or ``Category {id}`` when it has none."""
    return F.coalesce(_col(name), F.concat(F.lit("Category "), _col(category_id).cast("string")))


def floored_count(count, delta) -> Column:
    """count + delta, absent count taken as 0, never below 0."""
    moved = F.coalesce(_col(count), F.lit(0)) + F.coalesce(_col(delta), F.lit(0))
    return F.greatest(moved, F.lit(0)).cast("long")

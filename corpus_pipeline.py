"""The pipeline from raw documents to token files: quality, near copies, benchmark passages, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The first four return the columns of
``docs``: documents that the quality classifier rejects go; of each group of near copies (similarity of 0.8 or more by
five-word shingles) the smallest id stays; hit spans of benchmark items are cut out, and documents that are mostly hit go;
the mixture has a row for each pass in which it takes words of a document. The last one writes the token files and returns
what they hold.
"""

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import decontamination, mixing, ngram_join, quality, token_files
from nearfield.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.tokens_round_trip(docs)


STAGES = [("quality", keep_good), ("near copies", drop_near_copies), ("decontamination", decontaminate), ("mixture", mix), ("tokens", tokenize)]

#: Learned, random and binary stages have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

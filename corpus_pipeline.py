"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``docs``. Every row is a document of its own: rows that repeat a doc_id, or
have none, stay or go one by one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, near_dedup, packing, quality
from tessera.session import intermediate_tables, materialize


#: Near copies link from this similarity of their sets of five-word shingles; op3 has its own.
NEAR_PERCENT = 80
#: Bits of a row number that say which row of its file.
_ROW_BITS = 24


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number for each row, and the name of its column.

    The number is made of a hash of the row's file and its place there, so a scan of
    files needs no copy, and every scan gives the same numbers. Other frames are
    written first. A seed is taken for which no two files have the same hash.
    """
    try:
        file = docs.metadataColumn("_metadata")
        docs.select(file["row_index"])
    except AnalysisException:
        return _numbered(materialize(docs, "documents", lasting=True))
    row = "__row"
    while row in docs.columns:
        row += "_"
    place = lambda seed: F.shiftleft(F.xxhash64(file["file_path"], F.lit(seed)), _ROW_BITS)
    files = docs.select(file["file_path"].alias("path"), *[place(seed).alias(f"s{seed}") for seed in range(8)]).distinct()
    n = files.agg(F.countDistinct("path"), *[F.countDistinct(f"s{seed}") for seed in range(8)]).first()
    seed = next((k for k in range(8) if n[k + 1] == n[0]), None)
    if seed is None:
        raise ValueError(f"no distinct numbers for {n[0]} files")
    index = F.when(file["row_index"] < 1 << _ROW_BITS, file["row_index"]).otherwise(F.raise_error(F.lit("a file has too many rows to number")))
    return docs.withColumn(row, place(seed) + index), row


def _kept(docs: DataFrame, found) -> DataFrame:
    """The rows of which ``found(numbered, row)``, a table of row and keep_row, says that they stay."""
    numbered, row = _numbered(docs)
    with intermediate_tables(docs.sparkSession):
        dropped = materialize(found(numbered, row).where("row <> keep_row").select(F.col("row").alias(row)), "dropped", lasting=True)
    return numbered.join(dropped, row, "left_anti").drop(row)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    NULL and empty texts are scored like any other; rows that repeat an id, or have
    none, each stay or go by their text.
    """
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, one stays."""
    return _kept(docs, lambda numbered, row: exact_dedup.exact_duplicates(numbered, row_column=row))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest id stays (NULL ids last)."""
    return _kept(docs, lambda numbered, row: near_dedup.near_duplicates(numbered, percent=NEAR_PERCENT, row_column=row))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences.

    NULL and empty texts are a piece of the end id alone; repeated rows are packed each.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", good_quality), ("exact dedup", exact_copies), ("near dedup", near_copies), ("best-fit packing", packed)]
#: Model fitting and tokenisation have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

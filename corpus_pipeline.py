"""Documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of ``documents``; the last returns packed pieces.
Null text counts as empty, and quality rules reject it; of equal rows, and of a group of near copies, one row stays, that of the least id
(a null id only where no other is); further columns of any name come along; a table without rows gives none at every stage.
Each result is written as Parquet in the shared folder and read again as the next stage's input, so a lost executor costs no earlier stage.
"""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm import decontaminate, line_dedup, packing, quality_rules, superminhash
from bundlelens.llm.common import keep_rows
from bundlelens.llm.queries import TOKENIZER, named, table
from bundlelens.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines too common among their host's documents go from the others."""
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line stays of each group of alike lines; documents with little left go."""
    return line_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by five-word shingles at 80 percent."""
    return superminhash.deduplicate(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    clean = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated")
    return keep_rows(docs, clean)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 2048."""
    out = packing.pack(docs, TOKENIZER, 2048, end_id=0)
    return named(out, "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("decontamination", benchmark), ("packing", packed)]
#: Several stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/pipeline-{uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs

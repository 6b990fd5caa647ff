"""The registered queries of the subpackage: each operator on its whole table, and SQL where it can say the same."""

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm import (conversation_repair, decontaminate, gam, hard_negatives, line_dedup, mixing, oracles, packing, quality_rules, substring,
                            suffix_array, superminhash, surrogates, token_store)
from bundlelens.session import shared_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col("id").alias("doc_id"), *columns)


def op1(spark, sf_dir):
    out = suffix_array.remove_repeats(table(spark, sf_dir, "documents"), 400)
    return named(out, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2(spark, sf_dir):
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), 35)
    return named(out, "n_words", "n_removed", "kept_sha256")


def op3(spark, sf_dir):
    return named(quality_rules.judge(table(spark, sf_dir, "documents")), *quality_rules.COUNTS, "n_line_words", "base_failed", "kept")


def op4(spark, sf_dir):
    return named(line_dedup.mark_lines(table(spark, sf_dir, "documents")), "line_no", "first_id", "first_line", "kept")


def op5(spark, sf_dir):
    return named(gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "held_out", "score", "predicted")


def op6(spark, sf_dir):
    return named(superminhash.near_duplicates(table(spark, sf_dir, "documents")), "n_shingles", "component_id", "kept")


def op7(spark, sf_dir):
    out = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, 2048, end_id=0)
    return named(out, "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


def op8(spark, sf_dir):
    return named(surrogates.replace(table(spark, sf_dir, "documents"), key="registered query"), "text", "n_entities", "kinds")


def op9(spark, sf_dir):
    out = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return named(out, "contaminated", "items", "share")


def op10(spark, sf_dir):
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/store-{uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=2)
    return named(token_store.checksums(token_store.read_store(spark, path)), "start", "n_tokens", "ids_crc32")


def op11(spark, sf_dir):
    return named(mixing.plan(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeat=3), "size", "source_size", "target", "taken", "source", "copies")


def op12(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    out = conversation_repair.report(conversation_repair.damage(rows), every=rows)
    return out.withColumnRenamed("conv", "conv_id")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix_array": op1, "op2_substring": op2, "op3_quality_rules": op3, "op4_line_dedup": op4, "op5_quality_gam": op5, "op6_superminhash": op6,
            "op7_best_fit": op7, "op8_surrogates": op8, "op9_decontaminate": op9, "op10_token_store": op10, "op11_mixing": op11,
            "op12_hard_negatives": op12, "op13_conversation_repair": op13, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

"""What the text operators share: the document view, tables written between steps, words, chunks of bounded size."""

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.session import shared_dir

#: Bytes of text that a Python step turns into arrays at once.
CHUNK_BYTES = 1 << 21


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """``id``, ``th`` (hash of the text), ``text`` (null: empty) and renamed further columns.

    Columns are picked by name, so extra columns of any name do no harm. A row is told from others by ``id`` and
    ``th`` together, which also holds where ids are null or repeated; rows equal in both have equal results.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"),
                     *(F.col(f"`{c}`").alias(name) for name, c in more.items()))


def same_row(a: DataFrame, b: DataFrame):
    """Join condition of two frames that carry ``id`` and ``th``."""
    return a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])


def hold(df: DataFrame) -> DataFrame:
    """Write a frame that several steps read to a table in the shared folder and return that table.

    A lost executor then costs the reading of files, not the steps before. The tables of an application lie in one
    folder, ``llm-<application>`` in ``spark.checkpoint.dir``, which may be deleted when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_type(df: DataFrame, column: str = "id") -> str:
    return df.schema[column].dataType.simpleString()


def keep_rows(docs: DataFrame, kept: DataFrame, extra: str | None = None, id_col: str = "doc_id", text_col: str = "text",
              once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose (``id``, ``th``) is in ``kept``, with their columns; ``once``: one of equal rows.

    ``extra`` names a column of ``kept`` that comes along as ``_llm_extra``.
    """
    d = kept.select(F.col("id").alias("_llm_id"), F.col("th").alias("_llm_th"), *([F.col(extra).alias("_llm_extra")] if extra else []))
    d = d.dropDuplicates(["_llm_id", "_llm_th"])
    out = docs.withColumn("_llm_key", F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    if once:
        out = out.dropDuplicates([id_col, "_llm_key"])
    out = out.join(d, F.col(f"`{id_col}`").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_key") == F.col("_llm_th")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(["_llm_extra"] if extra else []))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``limit`` bytes together; a longer text makes a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, computed once each; emptied when it has grown large."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of an unsigned array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes, by start."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[i : i + m] + np.uint64(i + 1))
    return mixed(out)

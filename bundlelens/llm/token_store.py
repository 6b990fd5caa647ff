"""Token ids as compressed binary blocks with a shared dictionary and an offset index.

A store is a folder of three tables written by Spark's own writers, so any file system and lost executors are theirs to
handle: ``dictionary`` (its bytes and hash, one row), ``blocks`` and ``starts``. A block holds consecutive documents in ascending id:

    payload  one Zstandard frame per document, one after another
    index    little-endian: for each document the place of its frame's end in the payload (uint32) and its number of ids (uint32)
    ids      the documents' ids

A document is read by its row in the index and one frame; nothing else of the block is decompressed.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm.common import documents, id_type, utf8
from bundlelens.llm.tokens import encoder


def train_dictionary(docs: DataFrame, tokenizer: str, max_docs: int = 2_000, size: int = 64 << 10) -> bytes:
    """Dictionary from the id arrays of the ``max_docs`` documents whose ids hash lowest, each cut to 16 KB.

    The hash bounds what all tasks send together, before the limit makes it exact; the dictionary only affects size, every document is compressed with it.
    Without enough material the dictionary is empty and frames stand alone.
    """
    import zstandard

    lowest = F.col("h") / F.lit(2.0**64) + 0.5 < max_docs / max(1, docs.count())
    rows = docs.select(F.xxhash64("id", "th").alias("h"), F.substring("text", 1, 16_384).alias("text")).filter(lowest).orderBy("h").limit(max_docs).collect()
    samples = [x[:16_384] for x in encoder(tokenizer).encode([r["text"].encode() for r in rows]) if x]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def block_rows(tokenizer: str, dictionary: bytes, end_id: int, block_docs: int, level: int, kind: pa.DataType):
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches):
        import zstandard
        from pyspark import TaskContext

        enc, part, number, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        press = zstandard.ZstdCompressor(level=level, write_content_size=True, **shared)
        name = hashlib.sha256(dictionary).digest()[:8]
        for batch in batches:
            for lo in range(0, batch.num_rows, block_docs):
                frames, ends, counts = [], [], []
                for data in enc.encode(utf8(batch.column("text").slice(lo, block_docs))):
                    frames.append(press.compress(data + end))
                    ends.append(len(frames[-1]) + (ends[-1] if ends else 0))
                    counts.append(len(data) // 4 + 1)
                index = np.array([ends, counts], "<u4").T.tobytes()
                ids = batch.column("id").slice(lo, len(counts)).to_pylist()
                known = [x for x in ids if x is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([sum(counts)], pa.int64()),
                     pa.array([name], pa.binary()), pa.array([known[0] if known else None], kind), pa.array([known[-1] if known else None], kind),
                     pa.array([ids], pa.list_(kind)), pa.array([index], pa.binary()), pa.array([b"".join(frames)], pa.binary())],
                    ["part", "block", "part_start", "n_tokens", "dictionary", "least", "greatest", "ids", "index", "payload"])
                number, start = number + 1, start + sum(counts)

    return rows


def write_store(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_docs: int = 256, level: int = 3,
                id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all texts of ``df`` in ascending id order to the folder ``path``, which must not exist.

    The order is made by ranges of ids, one task each; where each range begins follows from the ranges' totals, one row per range.
    Null ids come first; equal ids stay together in any order; null text is empty text, stored as the end id alone.
    """
    docs = documents(df, id_col, text_col)
    spark = df.sparkSession
    dictionary = train_dictionary(docs, tokenizer)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["id"].dataType)
    ordered = docs.repartitionByRange("id", "th").sortWithinPartitions("id", "th").select("id", "text")
    blocks = ordered.mapInArrow(block_rows(tokenizer, dictionary, end_id, block_docs, level, kind),
                                f"part int, block long, part_start long, n_tokens long, dictionary binary, least {id_type(docs)}, greatest {id_type(docs)}, ids array<{id_type(docs)}>, index binary, payload binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).tolist()
    starts = [(r["part"], b) for r, b in zip(totals, before)]
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{path}/starts")
    spark.createDataFrame([(dictionary, hashlib.sha256(dictionary).digest()[:8])], "content binary, name binary").coalesce(1).write.parquet(f"{path}/dictionary")


def read_rows(dictionary: bytes, names: list[str]):
    def rows(batches):
        import zstandard

        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        press = zstandard.ZstdDecompressor(**shared)
        name = hashlib.sha256(dictionary).digest()[:8]
        for batch in batches:
            ids = batch.column("ids")
            for i in range(batch.num_rows):
                if batch.column("dictionary")[i].as_py() != name:
                    raise ValueError("a block was written with another dictionary")
                index = np.frombuffer(batch.column("index")[i].as_py(), "<u4").reshape(-1, 2).astype(np.int64)
                payload = memoryview(batch.column("payload")[i].as_py())
                data = [press.decompress(payload[a:b]) for a, b in zip([0, *index[:-1, 0]], index[:, 0])]
                start = batch.column("start")[i].as_py() + np.cumsum(index[:, 1]) - index[:, 1]
                yield pa.RecordBatch.from_arrays([ids[i].values, pa.array(start), pa.array(index[:, 1]), pa.array(data, pa.binary())], names)

    return rows


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) of every stored document."""
    blocks = spark.read.parquet(f"{path}/blocks")
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["content"])
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    # One row per written range, so the side is as small as the number of tasks.
    placed = blocks.join(spark.read.parquet(f"{path}/starts"), "part").select(
        (F.col("start") + F.col("part_start")).alias("start"), "dictionary", "ids", "index", "payload")
    return placed.mapInArrow(read_rows(dictionary, ["id", "start", "n_tokens", "ids"]), f"id {kind}, start long, n_tokens long, ids binary")


def checksums(store: DataFrame) -> DataFrame:
    """``ids_crc32`` instead of the ids."""
    return store.select("id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def read_document(spark: SparkSession, path: str, doc_id) -> DataFrame:
    """One document: ranges of ids are looked up in the files' statistics, and only the document's own frame is decompressed."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["content"])
    blocks = spark.read.parquet(f"{path}/blocks").filter((F.col("least") <= doc_id) & (F.col("greatest") >= doc_id)).filter(F.array_contains("ids", doc_id))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def rows(batches):
        import zstandard

        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        press = zstandard.ZstdDecompressor(**shared)
        for batch in batches:
            for i in range(batch.num_rows):
                ends = [0, *np.frombuffer(batch.column("index")[i].as_py(), "<u4")[::2].tolist()]
                for k, x in enumerate(batch.column("ids")[i].as_py()):
                    if x == doc_id:
                        data = press.decompress(batch.column("payload")[i].as_py()[ends[k] : ends[k + 1]])
                        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["ids"])

    return blocks.select("ids", "index", "payload").mapInArrow(rows, "ids binary").select(F.lit(doc_id).cast(kind).alias("id"), "ids")

"""Quality rules: counts over each text, and lines that too many documents of a host share."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import WordHashes, documents, grams, hold, id_type, keep_rows, utf8

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def line_key(line: bytes) -> int:
    """Hash of a line without regard to letters' case, digits' values and blank space; 0 without words."""
    words = line.lower().translate(_DIGITS).split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else 0


#: So many least hashes of a document's runs beside a line tell its near copies.
MINIMA = 4


def line_families(lines: list[tuple[int, int]], runs: np.ndarray, whole: int) -> tuple[int, dict[int, int]]:
    """The document's family, by which its near copies count once: its least hashes of runs; and per line key, of runs that don't touch the line.

    ``lines`` are keys and numbers of words. With too few such runs only copies of the whole text are one family.
    """
    touched: set[int] = set()
    of = [key for key, n in lines for _ in range(n)]
    least = np.argsort(runs, kind="stable")
    places, values = least.tolist(), runs[least].tolist()

    def family(key: int | None) -> int:
        found: list[int] = []
        for at, value in zip(places, values):
            if (not found or value != found[-1]) and key not in of[at : at + 3]:
                found.append(value)
                if key is None:
                    touched.update(of[at : at + 3])
                if len(found) == MINIMA:
                    return xxhash.xxh3_64_intdigest(b"".join(v.to_bytes(8, "little") for v in found)) - (1 << 63)
        return whole

    usual = family(None)
    return usual, {key: family(key) if key in touched else usual for key, n in lines}


def text_counts(text: bytes, hashes: WordHashes) -> tuple:
    s = text.decode("utf-8", "replace")
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.split()]
    repeat, whole = 0, xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)
    runs = grams(hashes.of(words), 3)
    if n >= 3:
        _, of, count = np.unique(runs, return_inverse=True, return_counts=True)
        often = count[of] > 1
        if often.any():
            marked = np.zeros(n, bool)
            for k in range(3):
                marked[k : k + len(often)] |= often
            repeat = int(marked.sum())
    return n, len(s) - sum(map(s.count, BLANKS)), sum(map(s.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, whole, runs


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LINES = pa.list_(pa.struct([("key", pa.int64()), ("words", pa.int32()), ("family", pa.int64())]))


def count_rows(near_copies_once: bool):
    return lambda batches: counted_batches(batches, near_copies_once)


def counted_batches(batches, near_copies_once: bool):
    hashes = WordHashes()
    for batch in batches:
        texts = utf8(batch.column("text"))
        for lo in range(0, len(texts), 1000):
            part = texts[lo : lo + 1000]
            counts = [text_counts(t, hashes) for t in part]
            lines, kinds = [], []
            for t, (*_, whole, runs) in zip(part, counts):
                keyed = [(line_key(x), len(x.split())) for x in t.split(b"\n")]
                kind, families = line_families(keyed, runs, whole) if near_copies_once else (whole, {})
                kinds.append(kind)
                words: dict[int, int] = {}
                for key, n in keyed:
                    if key:
                        words[key] = words.get(key, 0) + n
                lines.append([{"key": k, "words": n, "family": families.get(k, whole)} for k, n in words.items()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, 1000) for c in ("id", "th", "host")),
                                              *(pa.array(c, pa.int64()) for c in list(zip(*counts))[: len(COUNTS)]), pa.array(kinds, pa.int64()), pa.array(lines, LINES)],
                                             ["id", "th", "host", *COUNTS, "family", "lines"])


def judge(df: DataFrame, min_words: int = 50, max_repeat_pct: int = 50, min_line_docs: int = 20, max_line_share: float = 0.05,
          min_left_pct: int = 30, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_line_docs: int = 10_000,
          near_copies_once: bool = False) -> DataFrame:
    """Per row ``id``, ``th``, the counts, ``base_failed``, ``common`` (keys of lines to remove), ``n_line_words`` (words in them), ``kept``.

    A line is removed when more than ``min_line_docs`` of a host's documents have it and these are more than ``max_line_share`` of
    them or more than ``max_line_docs``. Documents are counted by their words, so exact copies of a document count once and don't make its
    lines common. With ``near_copies_once``, documents that have a line and agree in the least ``MINIMA`` hashes of three-word runs beside it
    also count as one for that line; lines of depleted pages, which have little else, may then be missed. A document is rejected if it fails the counts or if less than ``min_left_pct`` percent of its words are left.
    Null and empty texts fail for want of words; a null host is a host of its own; equal rows are judged alike; lines
    are compared without regard to case, digits' values and spacing. Groups are counted after pre-aggregation, and a host's
    lines lie in many groups, so a host with a third of all rows is spread like any other.
    """
    docs = documents(df, id_col, text_col, host=host_col)
    kind, host = id_type(docs), id_type(docs, "host")
    counted = hold(docs.select("id", "th", "host", "text").mapInArrow(
        count_rows(near_copies_once), f"id {kind}, th long, host {host}, {', '.join(f'{c} long' for c in COUNTS)}, family long, lines array<struct<key:long,words:int,family:long>>"))
    lines = counted.select("id", "th", "host", F.inline("lines"))
    hosts = counted.groupBy("host").agg(F.count_distinct("family").alias("n_docs"))
    often = lines.groupBy("host", "key").agg(F.count_distinct("family").alias("n")).filter(F.col("n") > min_line_docs)
    often = often.withColumnsRenamed({"host": "h"}).join(hosts, F.col("h").eqNullSafe(F.col("host"))).filter(
        (F.col("n") > F.col("n_docs") * max_line_share) | (F.col("n") > max_line_docs))
    often = often.select("h", F.col("key").alias("k"))
    # Equal rows have the same lines: the sums are taken per row of one kind, hence the distinct.
    found = lines.join(often, F.col("host").eqNullSafe(F.col("h")) & (F.col("key") == F.col("k"))).select("id", "th", "host", "key", "words").distinct()
    found = found.groupBy("id", "th", "host").agg(F.collect_list("key").alias("common"), F.sum("words").cast("long").alias("n_line_words"))
    found = found.withColumnsRenamed({"id": "i", "th": "t", "host": "h"})
    out = counted.drop("lines", "family").join(
        found, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")) & F.col("host").eqNullSafe(F.col("h")), "left").drop("i", "t", "h")
    n, lost = F.col("n_words"), F.coalesce("n_line_words", F.lit(0))
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * n)
    return out.withColumns({"base_failed": failed, "n_line_words": lost, "kept": ~failed & (100 * (n - lost) >= min_left_pct * n)})


def drop_lines(text: bytes, common: set[int]) -> str:
    return b"\n".join(x for x in text.split(b"\n") if line_key(x) not in common).decode()


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """Rows of ``df`` that are kept, common lines removed from their texts; columns as in ``df``.

    The verdict depends on the host too, so equal texts under one id but several hosts follow the verdict of the host that keeps most.
    """
    verdict = judge(df, id_col=id_col, text_col=text_col, host_col=host_col, **limits).filter("kept")
    verdict = verdict.groupBy("id", "th").agg(F.min_by("common", F.coalesce("n_line_words", F.lit(0))).alias("common"))
    marked = keep_rows(df, verdict, "common", id_col, text_col)
    others = [c for c in df.columns if c != text_col]
    fields = ", ".join([*(f"`{c}` {id_type(df, c)}" for c in others), "_llm_new string"])
    out = marked.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text_col}`").alias("_llm_text"), "_llm_extra").mapInArrow(cut_rows, fields)
    return out.select(*(F.col("_llm_new").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns))


def cut_rows(batches):
    for batch in batches:
        texts = [drop_lines(t, set(c)) if c else t.decode() for t, c in zip(utf8(batch.column("_llm_text")), batch.column("_llm_extra").to_pylist())]
        others = batch.schema.names[:-2]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], [*others, "_llm_new"])

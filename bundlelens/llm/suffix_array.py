"""Exact removal of long repeated byte strings, by interval expansion on a Burrows-Wheeler transform.

The surroundings of anchors that share what follows them (see ``anchors``) are sorted by it: a suffix array of the
anchored suffixes, with the common prefix of neighbours. The bytes before the suffixes, in that order, are the
transform's column. An interval is the set of suffixes that start with the same string; one step back splits it by that
column, keeping the order. All intervals are extended together, breadth first, so common prefixes are met by increasing
length, and an interval is dropped when it holds one suffix or can no longer reach the least length. The order of the
suffixes never changes, so the common prefix of two suffixes of an interval is the least value between them in the first
array, read from a table of range minima.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.anchors import Windows, merged, repeated_spans
from bundlelens.llm.common import documents, id_type, same_row, utf8


def range_minima(x: np.ndarray) -> list[np.ndarray]:
    table = [x]
    span = 1
    while span * 2 <= len(x):
        table.append(np.minimum(table[-1][:-span], table[-1][span:]))
        span *= 2
    return table


def least_between(table: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least of values i+1..j, for i < j."""
    n = j - i
    level = np.frexp(n)[1] - 1
    out = np.empty(len(i), table[0].dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][i[at] + 1], table[k][j[at] - (1 << int(k)) + 1])
    return out


def expand_intervals(spec: Windows, items: list[dict]) -> list[list[tuple[int, int]]]:
    """Per item the ranges of windows (by their distance before the anchor) that another item of its group also has."""
    n, length = len(items), spec.length
    group = np.unique(np.array([x["core"] for x in items]), return_inverse=True)[1]
    before = np.array([x["before"] for x in items])
    after = np.array([len(x["body"]) for x in items]) - before
    right = np.zeros((n, length), np.uint8)
    left = np.zeros((n, max(1, before.max())), np.uint8)
    for i, x in enumerate(items):
        body = np.frombuffer(x["body"], np.uint8)
        right[i, : after[i]] = body[before[i] :]
        left[i, : before[i]] = body[: before[i]][::-1]
    # Sorted by group, then by what follows the anchor.
    named = np.concatenate([group.astype(">u4").view(np.uint8).reshape(n, 4), right, np.ones((n, 1), np.uint8)], 1)
    order = np.argsort(np.ascontiguousarray(named).view(f"S{named.shape[1]}").ravel(), kind="stable")
    group, before, after, left = group[order], before[order], after[order], left[order]
    right = right[order]
    lo = np.array([max(x["lo"], x["whole_lo"]) for x in items])[order]
    hi = np.array([min(x["hi"], x["whole_hi"]) for x in items])[order]
    first = np.array([x["whole_lo"] for x in items])[order]
    common = np.zeros(n, np.int32)
    if n > 1:
        differ = np.ones((n - 1, length + 1), bool)
        np.not_equal(right[1:], right[:-1], out=differ[:, :length])
        common[1:] = np.minimum(np.minimum(differ.argmax(1), after[1:]), after[:-1])
        common[1:][group[1:] != group[:-1]] = 0
    table = range_minima(common)
    covered = np.zeros((n, spec.reach), bool)
    # ``rows`` are ranks, sorted by interval and rank.
    rows, interval = np.arange(n), group.astype(np.int64)
    link = None
    for depth in range(int(first.min()), spec.reach):
        stay = depth <= hi[rows]
        old = depth > first[rows]
        if not stay.all():
            rows, interval, old, link = rows[stay], interval[stay], old[stay], None
        if not len(rows):
            break
        if old.any():
            byte = np.where(old, left[rows, depth - 1] if depth else 0, 0).astype(np.int64)
            same = interval[1:] == interval[:-1]
            if (same & (byte[1:] != byte[:-1])).any():
                name = interval * 256 + byte
                at = np.argsort(name, kind="stable")
                rows, name = rows[at], name[at]
                interval = np.cumsum(np.concatenate([[0], name[1:] != name[:-1]]))
                link = None
        if link is None:
            while True:
                same = interval[1:] == interval[:-1]
                link = np.zeros(len(rows) + 1, np.int32)
                where = np.flatnonzero(same)
                link[where + 1] = least_between(table, rows[where], rows[where + 1])
                best = np.maximum(link[:-1], link[1:])
                # A suffix goes when its interval has no other, or none that can reach the least length with what is left before it.
                stay = best + hi[rows] >= length
                if stay.all():
                    break
                rows, interval = rows[stay], interval[stay]
                if not len(rows):
                    break
            if not len(rows):
                break
        hit = rows[(best + depth >= length)]
        hit = hit[(depth >= lo[hit]) & (depth >= first[hit])]
        covered[hit, depth] = True
    out: list[list[tuple[int, int]]] = [[] for _ in items]
    edge = np.diff(np.pad(covered.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    for (r, a), (_, b) in zip(np.argwhere(edge == 1), np.argwhere(edge == -1)):
        out[order[r]].append((int(a), int(b) - 1))
    return out


def remove_repeats(df: DataFrame, min_bytes: int = 400, reach: int | None = None, max_group: int = 50_000,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``th``, ``spans`` (removed byte ranges, merged), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``.

    Every byte of a ``min_bytes`` string that also starts elsewhere, in the same text or another, is removed; ``kept`` is
    what remains, as bytes (a cut may fall inside a character). Null text is empty text; a text below ``min_bytes`` keeps
    all; an equal row is another document, so both lose their repeats; an empty table gives no rows. Anchors are found
    by 64-bit hashes, repeats are confirmed on bytes; whole surroundings count as equal if two 64-bit hashes agree.
    """
    docs = documents(df, id_col, text_col)
    spec = Windows(False, min_bytes, reach or max(1, min(255, min_bytes * 5 // 8)), max_group)
    spans = repeated_spans(docs, spec, expand_intervals)
    joined = docs.join(spans.withColumnsRenamed({"id": "sid", "th": "sth"}), F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")), "left")
    kind = id_type(docs)
    return joined.select("id", "th", "text", "spans").mapInArrow(cut_rows, f"id {kind}, th long, spans array<struct<start:long,end:long>>, n_bytes long, "
                                                                   "n_removed long, n_spans long, kept binary, kept_sha256 string")


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def cut_rows(batches):
    for batch in batches:
        texts, out = utf8(batch.column("text")), []
        for lo in range(0, len(texts), 500):
            out = []
            for text, spans in zip(texts[lo : lo + 500], batch.column("spans").slice(lo, 500).to_pylist()):
                runs = merged(spans)
                at = [0, *(x for run in runs for x in run), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(at[::2], at[1::2]))
                out.append(([{"start": a, "end": b} for a, b in runs], len(text), len(text) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest()))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), [SPAN, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, 500), batch.column("th").slice(lo, 500), *cols],
                                             ["id", "th", "spans", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

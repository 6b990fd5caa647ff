"""Exact removal of repeated word runs, by prefix-partitioned suffix trees.

Suffixes are grouped by a shared prefix whose length varies: anchors with the same first words make a group (see
``anchors``), and a group too large for a task is split by longer prefixes. Each group's tree is built in one task as
the sorted order of its suffixes, cut at the least depth: ranks of one word are doubled to ranks of two, four and more
words, until suffixes with the same rank share that many words. Those are the leaves below one deep internal node; a node with
two leaves or more is a repeat.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.anchors import Windows, merged, repeated_spans
from bundlelens.llm.common import documents, id_type, utf8


def ranks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rank of each pair, in the order of pairs."""
    return np.unique(x.astype(np.int64) * (int(y.max()) + 1) + y, return_inverse=True)[1]


def deep_nodes(spec: Windows, items: list[dict]) -> list[list[tuple[int, int]]]:
    """Per item the ranges of windows (by their distance before the anchor) that another item of its group also has."""
    names: dict[bytes, int] = {}
    texts = [x["body"].split() for x in items]
    word = np.fromiter((names.setdefault(w, len(names)) for t in texts for w in t), np.int64)
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    # Suffixes of the items by window: item, distance before the anchor, place.
    lo = np.array([max(x["lo"], x["whole_lo"]) for x in items])
    hi = np.array([min(x["hi"], x["whole_hi"]) for x in items])
    count = np.maximum(hi - lo + 1, 0)
    item = np.repeat(np.arange(len(items)), count)
    depth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[item]
    place = starts[item] + np.array([x["before"] for x in items])[item] - depth
    rank, span = word, 1
    while span * 2 <= spec.length:
        rank = ranks(rank[:-span], rank[span:])
        span *= 2
    if span < spec.length:
        rank = ranks(rank[: len(word) - spec.length + 1], rank[spec.length - span :])
    group = np.unique(np.array([x["core"] for x in items]), return_inverse=True)[1]
    # A node of the tree of one group; windows at other distances from the anchor belong to other anchors as well.
    node = ranks(ranks(group[item], depth), rank[place])
    repeated = np.bincount(node)[node] > 1
    out: list[list[tuple[int, int]]] = [[] for _ in items]
    for i, d in zip(item[repeated].tolist(), depth[repeated].tolist()):
        if out[i] and out[i][-1][1] == d - 1:
            out[i][-1] = (out[i][-1][0], d)
        else:
            out[i].append((d, d))
    return out


def remove_repeats(df: DataFrame, min_words: int = 35, reach: int | None = None, max_group: int = 50_000,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``th``, ``spans`` (removed word ranges, merged), ``n_words``, ``n_removed``, ``kept`` (words joined by blanks).

    Every word of a run of ``min_words`` words that also starts elsewhere, in the same text or another, is removed. Null
    text has no words; a shorter text keeps all; an equal row is another document, so both lose their repeats; an empty
    table gives no rows. Anchors are found by 64-bit hashes, repeats are confirmed on words; whole surroundings count as
    equal if two 64-bit hashes agree.
    """
    docs = documents(df, id_col, text_col)
    spec = Windows(True, min_words, reach or min_words - 7, max_group)
    spans = repeated_spans(docs, spec, deep_nodes)
    joined = docs.join(spans.withColumnsRenamed({"id": "sid", "th": "sth"}), F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")), "left")
    kind = id_type(docs)
    return joined.select("id", "th", "text", "spans").mapInArrow(cut_rows, f"id {kind}, th long, spans array<struct<start:long,end:long>>, n_words long, "
                                                                   "n_removed long, kept string, kept_sha256 string")


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def cut_rows(batches):
    for batch in batches:
        texts = utf8(batch.column("text"))
        for lo in range(0, len(texts), 500):
            out = []
            for text, spans in zip(texts[lo : lo + 500], batch.column("spans").slice(lo, 500).to_pylist()):
                words, runs = text.split(), merged(spans)
                at = [0, *(x for run in runs for x in run), len(words)]
                left = [w for a, b in zip(at[::2], at[1::2]) for w in words[a:b]]
                kept = b" ".join(left)
                out.append(([{"start": a, "end": b} for a, b in runs], len(words), len(words) - len(left), kept.decode(), hashlib.sha256(kept).hexdigest()))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), [SPAN, pa.int64(), pa.int64(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, 500), batch.column("th").slice(lo, 500), *cols],
                                             ["id", "th", "spans", "n_words", "n_removed", "kept", "kept_sha256"])

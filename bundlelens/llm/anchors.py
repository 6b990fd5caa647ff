"""Long repeats by anchors: the part that the two exact deduplications share.

A window is ``length`` consecutive units (bytes or words) of one text. Each window has an anchor, the position among
its first ``reach`` where the hash of a short run is least; equal windows have it at the same place. So each window
that repeats is seen by comparing the surroundings of anchors that share what follows them:

1. Anchors with a hash of the ``length - reach + 1`` units that follow (the part in every window of that anchor) are
   counted; those that occur once are dropped. Only counts are shuffled for them.
2. Surroundings (all windows of an anchor) that are equal as a whole are repeated as a whole. One of each different
   kind is fetched from its text for groups that hold several kinds.
3. A group of up to ``max_group`` kinds is compared in one task by the operator's own method. A larger one isn't: its range of
   windows is halved, which makes the part longer that all windows of a half share, kinds equal on a half become one, and
   halves found once are dropped. So the inside of a passage that very many documents share is one kind after a few steps, and groups fall
   apart until each fits. Nothing is cut off.
4. Covered windows go back to all anchors of their kind and become spans of their documents.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import WordHashes, chunks, grams, hold, id_type, mixed, same_row, utf8

RUN = 8


@dataclass(frozen=True)
class Windows:
    """``words``: units are words, else bytes. ``length`` units make a window, whose anchor is among its first ``reach``.

    A group of ``max_group`` kinds takes about 3 KB each in the task that compares it.
    """

    words: bool
    length: int
    reach: int
    max_group: int = 50_000

    def __post_init__(self):
        if not (0 < self.reach and self.reach + RUN - 1 <= self.length):
            raise ValueError(f"reach must be from 1 to length - {RUN - 1}")

    def units(self, text: bytes) -> tuple[bytes, np.ndarray | None, list[bytes]]:
        """The text with single blanks between words, where each unit begins (None: every byte), and the words."""
        if not self.words:
            return text, None, []
        words = text.split()
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
        return b" ".join(words), starts, words


def piece(text: bytes, starts: np.ndarray | None, i: int, j: int) -> bytes:
    return text[i:j] if starts is None else text[starts[i] : max(starts[i], starts[j] - 1)]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n]) if span < width else x[:n]


def find_anchors(runs: np.ndarray, lengths: np.ndarray, spec: Windows) -> np.ndarray:
    """Positions of anchors in texts that lie one after another; ``runs`` has the hash of the run at each unit."""
    ends = np.cumsum(lengths)
    n_windows = np.maximum(lengths - spec.length + 1, 0)
    if not n_windows.any():
        return np.empty(0, np.int64)
    packed = (runs & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(runs), dtype=np.uint64)
    first = sliding_least(packed, spec.reach)
    offset = np.repeat((ends - lengths) - (np.cumsum(n_windows) - n_windows), n_windows)
    at = (first[np.arange(n_windows.sum()) + offset] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def anchor_rows(spec: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    core = spec.length - spec.reach + 1

    def rows(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = utf8(batch.column("text"))
            for lo, hi in chunks(texts):
                part = [spec.units(t) for t in texts[lo:hi]]
                lengths = np.array([len(t) if s is None else len(s) - 1 for t, s, _ in part])
                if spec.words:
                    runs = grams(np.concatenate([hashes.of(w) for _, _, w in part]), RUN)
                else:
                    data = np.frombuffer(b"".join(t for t, _, _ in part) or b"\0", np.uint8)
                    runs = np.empty(0, np.uint64)
                    if len(data) >= RUN:
                        runs = mixed(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, RUN)).view("<u8").ravel())
                at = find_anchors(runs, lengths, spec)
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, at, "right")
                pos = at - (ends - lengths)[doc]
                least = np.maximum(0, pos + spec.length - lengths[doc])
                most = np.minimum(pos, spec.reach - 1)
                key, ctx = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
                for i, (d, p, m) in enumerate(zip(doc.tolist(), pos.tolist(), most.tolist())):
                    text, starts, _ = part[d]
                    key[i] = xxhash.xxh3_64_intdigest(piece(text, starts, p, p + core))
                    ctx[i] = xxhash.xxh3_64_intdigest(piece(text, starts, p - m, min(p + spec.length, lengths[d])), m)
                rows_at = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows_at), batch.column("th").take(rows_at), pa.array(pos, pa.int32()),
                     pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(least, pa.int32()), pa.array(most, pa.int32())],
                    ["id", "th", "pos", "key", "ctx", "least", "most"])

    return rows


def fetch_rows(spec: Windows):
    """Surroundings of wanted anchors, cut from their texts; windows are named by how far before the anchor they start."""

    def rows(batches):
        for batch in batches:
            for text, wanted in zip(utf8(batch.column("text")), batch.column("wanted").to_pylist()):
                text, starts, _ = spec.units(text)
                n = len(text) if starts is None else len(starts) - 1
                yield item_batch([(w["key"], w["ctx"], w["n"], piece(text, starts, w["pos"] - w["most"], min(w["pos"] + spec.length, n)),
                                   w["most"], w["least"], w["most"], 0, spec.reach - 1, w["size"], w["part"]) for w in wanted])

    return rows


#: An item: the hash that groups it, its kind, of how many it stands, its units, the units before the anchor, the windows it
#: has, the range of windows its group is compared on, how many kinds the group has, and (large groups) the part of the rows it is dealt to.
ITEM = "core long, ctx long, n long, body binary, before int, lo int, hi int, whole_lo int, whole_hi int, size long, part int"
ITEM_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int32()] * 5, pa.int64(), pa.int32()]
ITEM_NAMES = [x.split()[0] for x in ITEM.split(", ")]


def item_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(ITEM_TYPES)], ITEM_NAMES)


def halves(spec: Windows):
    """Both halves of each item's range of windows, grouped by what all windows of the half share, cut to what they cover."""

    def rows(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                text, starts, _ = spec.units(x["body"])
                n = len(text) if starts is None else len(starts) - 1
                middle = (x["whole_lo"] + x["whole_hi"]) // 2
                for a, b in ((x["whole_lo"], middle), (middle + 1, x["whole_hi"])):
                    lo, hi = max(a, x["lo"]), min(b, x["hi"])
                    if lo <= hi:
                        shared = piece(text, starts, x["before"] - a, x["before"] + spec.length - b)
                        body = piece(text, starts, x["before"] - hi, min(n, x["before"] + spec.length - a))
                        core = xxhash.xxh3_64_intdigest(shared, a << 20 | b) - (1 << 63)
                        ctx = xxhash.xxh3_64_intdigest(body, lo << 20 | hi) - (1 << 63)
                        out.append((core, ctx, x["n"], body, hi, lo, hi, a, b, 0, 0, x["core"], x["ctx"]))
            batch = item_batch([r[:-2] for r in out])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r[-2] for r in out], pa.int64()), pa.array([r[-1] for r in out], pa.int64())],
                                             [*ITEM_NAMES, "whole_core", "whole_ctx"])

    return rows


def compared(spec: Windows, method):
    """Stream items, sorted by group, through ``method``, several small groups at once; items of large groups pass.

    A row is a range of windows found in another kind too (``found``, in ``lo`` and ``hi``) or an item.
    """
    def rows(batches):
        held: list[dict] = []
        large: list[dict] = []
        seen: set[int] = set()

        def done():
            out = [(x["core"], x["ctx"], 0, None, 0, lo, hi, 0, 0, 0, 0) for x, spans in zip(held, method(spec, held)) for lo, hi in spans] if held else []
            batch = item_batch(out + [tuple(x[c] for c in ITEM_NAMES) for x in large])
            held.clear()
            large.clear()
            return pa.RecordBatch.from_arrays([*batch.columns, batch.column("body").is_null()], [*ITEM_NAMES, "found"])

        core = None
        for batch in batches:
            for x in batch.to_pylist():
                if x["core"] != core:
                    core, seen = x["core"], set()
                    if len(held) >= 2_000:
                        yield done()
                if x["size"] > spec.max_group:
                    large.append(x)
                    if len(large) >= 5_000:
                        yield done()
                # Equal rows of the table give the same item twice.
                elif x["ctx"] not in seen:
                    seen.add(x["ctx"])
                    held.append(x)
        yield done()

    return rows


def repeated_spans(docs: DataFrame, spec: Windows, method) -> DataFrame:
    """``id``, ``th``, ``spans``: stretches of each document covered by repeated windows, in units, unmerged.

    ``method(spec, items)`` gets items of whole groups and returns, for each, the ranges of its windows that also
    occur in another item of its group.
    """
    kind = id_type(docs)
    anchors = hold(docs.select("id", "th", "text").mapInArrow(
        anchor_rows(spec), f"id {kind}, th long, pos int, key long, ctx long, least int, most int"))
    often = hold(anchors.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"))
    again = hold(anchors.join(often, "key"))
    kinds = again.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "pos", "least", "most")).alias("one"))
    kinds = hold(kinds)
    several = hold(kinds.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    part = F.pmod(F.xxhash64("ctx", "key"), F.ceil(F.col("size") / spec.max_group)).cast("int").alias("part")
    wanted = kinds.join(several, "key").groupBy(F.col("one.id").alias("id"), F.col("one.th").alias("th")).agg(F.collect_list(F.struct(
        "key", "ctx", "n", "size", part, "one.pos", "one.least", "one.most")).alias("wanted"))
    items = docs.select("id", "th", "text").join(wanted, same_row(docs, wanted)).select("text", "wanted").mapInArrow(fetch_rows(spec), ITEM)
    levels = []
    while True:
        out = hold(items.repartition("core", "part").sortWithinPartitions("core", "part").mapInArrow(compared(spec, method), f"{ITEM}, found boolean"))
        found = out.filter("found").select("core", "ctx", "lo", "hi")
        if levels:
            found = found.unionByName(items.filter("n > 1").select("core", "ctx", "lo", "hi"))
        large = out.filter("not found")
        if large.isEmpty():
            break
        parts = hold(large.dropDuplicates(["core", "ctx"]).mapInArrow(halves(spec), f"{ITEM}, whole_core long, whole_ctx long"))
        one = parts.groupBy("core", "ctx").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ITEM_NAMES[3:9]))
        sizes = hold(one.groupBy("core").agg(F.count("*").alias("size"), F.sum("n").alias("all")).filter("all > 1").drop("all"))
        levels.append((found, parts.select("core", "ctx", "whole_core", "whole_ctx")))
        part = F.pmod(F.xxhash64("ctx", "core"), F.ceil(F.col("size") / spec.max_group)).cast("int").alias("part")
        items = hold(one.join(sizes, "core").withColumn("part", part).select(*ITEM_NAMES))
    for upper, parts in reversed(levels):
        found = upper.unionByName(found.join(parts, ["core", "ctx"]).select(F.col("whole_core").alias("core"), F.col("whole_ctx").alias("ctx"), "lo", "hi"))
    found = found.groupBy(F.col("core").alias("key"), "ctx").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    known = kinds.select("key", "ctx", "n").join(found, ["key", "ctx"], "left").filter("n > 1 or ranges is not null")
    whole = F.array(F.struct(F.col("least").alias("lo"), F.col("most").alias("hi")))
    spans = again.join(known, ["key", "ctx"]).select("id", "th", "pos", F.inline(F.when(F.col("n") > 1, whole).otherwise(F.col("ranges"))))
    span = F.struct((F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + spec.length).alias("end"))
    return spans.groupBy("id", "th").agg(F.collect_set(span).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]

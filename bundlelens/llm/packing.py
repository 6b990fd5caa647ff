"""Packing of tokenized texts into fixed-length sequences, bounded-space best fit."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import documents, hold, id_type, utf8
from bundlelens.llm.tokens import encoder


class OpenBins:
    """Best fit over a fixed number of open bins.

    Bit f of ``mask`` is set when a bin with f free places is open, so the tightest bin that takes a piece is the lowest bit at or
    above its length. When all are open and none fits, the fullest (lowest bit) is closed for a new one.
    """

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next = size, most, first
        self.mask, self.count = 0, 0
        self.bins: dict[int, list[int]] = {}

    def put(self, length: int) -> tuple[int, int]:
        """Bin and place of a piece."""
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            bin_, free, self.next = self.next, self.size, self.next + 1
        if free > length:
            self.bins.setdefault(free - length, []).append(bin_)
            self.mask |= 1 << (free - length)
            self.count += 1
        return bin_, self.size - free

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        bin_ = stack.pop()
        self.count -= 1
        if not stack:
            del self.bins[free]
            self.mask &= ~(1 << free)
        return bin_


def piece_rows(path: str, size: int, end_id: int, ids: bool):
    """Pieces of each text: ids, the end id, cut only where longer than a sequence."""
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]):
        enc = encoder(path)
        for batch in batches:
            texts = utf8(batch.column("text"))
            for lo in range(0, len(texts), 2000):
                out, doc = [], []
                for i, data in enumerate(enc.encode(texts[lo : lo + 2000]), lo):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * size)):
                        part = data[at : at + 4 * size]
                        doc.append(i)
                        out.append((k, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None))
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                rows_at = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(rows_at), *(pa.array([r[j] for r in out], t) for j, t in enumerate(types))],
                                                 ["id", "piece", "start", "length", "ids_crc32", "ids"])

    return rows


def place_rows(size: int, most: int, kept: list[str]):
    """Sequence and offset of pieces that come longest first; the stretch of sequence numbers is the task's own."""

    def rows(batches):
        from pyspark import TaskContext

        bins = OpenBins(size, most, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([p[0] for p in placed], pa.int64()),
                                              pa.array([p[1] for p in placed], pa.int32())], [*kept, "sequence_id", "offset"])

    return rows


def pack(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, open_bins: int = 65_536, ids: bool = False,
         per_task: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, (``ids``,) ``sequence_id``, ``offset`` of every piece of every text.

    Texts are encoded by the file ``tokenizer`` and closed by ``end_id``; only texts above ``size`` ids are cut. Pieces are dealt
    at random over tasks of about ``per_task`` pieces, each task having the same mix of lengths, and go longest first through
    ``open_bins`` open sequences; each task leaves at most that many open at its end, nearly all full since the shortest pieces
    come last. Null or empty text is one piece with the end id alone; equal rows are packed each; an empty table gives no rows.
    """
    docs = documents(df, id_col, text_col)
    pieces = docs.select("id", "text").mapInArrow(piece_rows(tokenizer, size, end_id, ids), f"id {id_type(docs)}, piece int, start long, length int, ids_crc32 long, ids binary")
    pieces = hold(pieces if ids else pieces.drop("ids"))
    tasks = max(1, -(-pieces.count() // per_task))
    kept = pieces.columns
    dealt = pieces.repartition(tasks, F.xxhash64("id", "piece", "ids_crc32")).sortWithinPartitions(F.desc("length"), "id", "piece", "ids_crc32")
    types = ", ".join(f"`{c}` {id_type(pieces, c)}" for c in kept)
    return dealt.mapInArrow(place_rows(size, open_bins, kept), f"{types}, sequence_id long, offset int")

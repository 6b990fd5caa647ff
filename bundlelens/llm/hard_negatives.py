"""Hard negatives by exact inner products, scored through tables of subset sums.

Components are whole numbers. A candidate is kept as bit planes: for each bit of its components, and each group of eight dimensions, one
byte. An anchor has, for each group, the sums of all 256 subsets of its eight components. A score is then looked up byte by byte and
added, doubling from plane to plane; the highest plane, the sign's, counts negative.

Anchors and candidates are dealt into blocks, and each pair of blocks is one stretch of rows that a task reads in order: the anchors, of
which there are so many at most, then the candidates one Arrow batch at a time.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bundlelens.llm.common import hold

#: Dimensions of a group, which one byte indexes.
GROUP = 8
#: Anchors and candidates whose scores are held at once.
TILE_ANCHORS, TILE_ROWS = 128, 512


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``row`` (a number of its own), ``id``, ``label`` and ``v``, the floors of ``scale`` times the components, of the rows that take part."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), vector.alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as long integers, missing components as 0."""
    lists = column.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def planes(v: np.ndarray, bits: int) -> np.ndarray:
    """Row, bit and group of eight dimensions to a byte, in two's complement."""
    return np.stack([np.packbits(((v >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], axis=1)


def packed_rows(width: int, bits: int):
    def rows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                data = planes(matrix(part.column("v"), width), bits)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "id", "label")), pa.array([x.tobytes() for x in data], pa.binary())],
                                                 ["row", "id", "label", "data"])

    return rows


def subset_sums(v: np.ndarray) -> np.ndarray:
    """Group, subset of its dimensions as a byte, and anchor to the sum of the anchor's components in the subset."""
    parts = np.ascontiguousarray(v.T).reshape(-1, GROUP, len(v))
    out = np.zeros((len(parts), 1 << GROUP, len(v)), v.dtype)
    for i in range(GROUP):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + parts[:, i, None]
    return out


def scores(sums: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Candidates' bit planes and anchors' subset sums to all inner products, candidate by anchor."""
    out = np.zeros((len(data), sums.shape[2]), sums.dtype)
    found = np.empty_like(out)
    for b in range(data.shape[1] - 1, -1, -1):
        for g in range(data.shape[2]):
            np.take(sums[g], data[:, b, g], axis=0, out=found, mode="clip")
            out += found
        if b == data.shape[1] - 1:
            np.negative(out, out=out)
        if b:
            out <<= 1
    return out


class Best:
    """The ``k`` highest scores per slot, with what belongs to them; of equal scores, those that came first."""

    def __init__(self, slots: int, k: int, dtype):
        self.least = np.iinfo(dtype).min
        self.score = np.full((slots, k), self.least, dtype)
        self.id, self.row = np.zeros((slots, k), np.int64), np.full((slots, k), -1)

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        """Each slot's entries come in the order in which they count."""
        k = self.score.shape[1]
        touched, at = np.unique(slot, return_inverse=True)
        slots = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
        columns = [np.concatenate([a[touched].ravel(), b]) for a, b in ((self.score, score), (self.id, id_), (self.row, row))]
        order = np.lexsort((np.arange(len(slots)), ~columns[0], slots))
        place = np.arange(len(slots)) - np.searchsorted(slots[order], np.arange(len(touched)))[slots[order]]
        order, place = order[place < k], place[place < k]
        for target, values in zip((self.score, self.id, self.row), columns):
            target[touched[slots[order]], place] = values[order]

    def entries(self) -> tuple[np.ndarray, ...]:
        slot, place = np.nonzero(self.row >= 0)
        return slot, self.score[slot, place], self.id[slot, place], self.row[slot, place]


class Positives:
    """The best rows of an anchor's label, itself among them."""

    def __init__(self, anchors: list[dict], k: int, dtype):
        self.anchors, self.best = [a["row"] for a in anchors], Best(len(anchors), k, dtype)

    def add(self, lo: int, found: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        hit, a = np.nonzero(found > self.best.score[lo : lo + found.shape[1], -1])
        if len(hit):
            self.best.add(a + lo, found[hit, a], ids[hit], rows[hit])

    def table(self) -> list[np.ndarray]:
        slot, score, id_, row = self.best.entries()
        return [np.array(self.anchors, np.int64)[slot], np.zeros(len(slot), np.int64), score.astype(np.int64), id_, row]


class Negatives:
    """The best rows of other labels below each different score of an anchor's positives."""

    def __init__(self, anchors: list[dict], k: int, dtype, low: int, high: int):
        goals = [sorted(set(a["goals"])) for a in anchors]
        self.anchors, self.labels, self.k = [a["row"] for a in anchors], np.array([a["label"] for a in anchors]), k
        self.slots = max(map(len, goals))
        span = np.iinfo(dtype)
        self.goal = np.zeros((len(anchors), self.slots), np.int64)
        # An empty range where an anchor has fewer goals.
        self.low, self.high = np.full(self.goal.shape, span.max, np.int64), np.full(self.goal.shape, span.min, np.int64)
        for i, own in enumerate(goals):
            for j, s in enumerate(own):
                self.goal[i, j], self.low[i, j], self.high[i, j] = s, -(-s * low // 100), s * high // 100
        self.best = Best(self.goal.size, k, dtype)

    def add(self, lo: int, found: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        hi = lo + found.shape[1]
        other = labels[:, None] != self.labels[None, lo:hi]
        for j in range(self.slots):
            slots = np.arange(lo, hi) * self.slots + j
            hit, a = np.nonzero((found > self.best.score[slots, -1]) & other & (found >= self.low[lo:hi, j]) & (found <= self.high[lo:hi, j]))
            if len(hit):
                self.best.add(slots[a], found[hit, a], ids[hit], rows[hit])

    def table(self) -> list[np.ndarray]:
        slot, score, id_, row = self.best.entries()
        return [np.array(self.anchors, np.int64)[slot // self.slots], self.goal.ravel()[slot], score.astype(np.int64), id_, row]


FOUND = ["anchor", "goal", "score", "id", "row"]


def scored_rows(width: int, bits: int, dtype, collect):
    """Per pair of blocks: read its anchors, then score its candidates, which come in order of their ids, and give what ``collect`` keeps."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: list[dict] = []
        pair, kept, sums = None, None, []

        def result():
            if kept is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in kept.table()], FOUND)

        for batch in batches:
            pairs, members = batch.column("pair").to_pylist(), batch.column("member").to_numpy(zero_copy_only=False)
            starts = [i for i in range(len(pairs)) if not i or pairs[i] != pairs[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(pairs)]):
                if pairs[lo] != pair:
                    yield from result()
                    pair, kept, sums, anchors = pairs[lo], None, [], []
                first = lo + int((~members[lo:hi].astype(bool)).sum())
                anchors += batch.slice(lo, first - lo).select(["row", "label", "data", "goals"]).to_pylist()
                if first == hi or not anchors:
                    continue
                if kept is None:
                    v = np.stack([np.frombuffer(a["data"], np.int64) for a in anchors]).astype(dtype)
                    sums = [subset_sums(v[i : i + TILE_ANCHORS]) for i in range(0, len(v), TILE_ANCHORS)]
                    kept = collect(anchors)
                part = batch.slice(first, hi - first)
                ids, nums, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row", "label"))
                data = np.frombuffer(b"".join(part.column("data").to_pylist()), np.uint8).reshape(len(ids), bits, width // GROUP)
                for at in range(0, len(ids), TILE_ROWS):
                    tile = slice(at, at + TILE_ROWS)
                    for i, own in enumerate(sums):
                        kept.add(i * TILE_ANCHORS, scores(own, data[tile]), ids[tile], nums[tile], labels[tile])
        yield from result()

    return rows


def anchor_rows(width: int):
    def rows(batches):
        for batch in batches:
            data = matrix(batch.column("v"), width)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label", "goals")), pa.array([x.tobytes() for x in data], pa.binary())],
                                             ["row", "id", "label", "goals", "data"])

    return rows


def pairs_of_blocks(anchors: DataFrame, candidates: DataFrame, same_label: bool, anchor_block: int, row_block: int) -> DataFrame:
    """Anchors and candidates, each once for every block of the other side; with ``same_label``, blocks hold one label each and only its own meet."""
    size = lambda n, block: F.ceil(n / block).cast("int")
    if same_label:
        count = lambda df, name, block: df.groupBy(F.col("label").alias("g")).agg(size(F.count("*"), block).alias(name))
        blocks = hold(count(anchors, "na", anchor_block).join(count(candidates, "nc", row_block), "g"))
        sized = lambda df: df.withColumn("g", F.col("label")).join(blocks, "g")
    else:
        whole = {"g": F.lit(0), "na": size(F.lit(anchors.count()), anchor_block), "nc": size(F.lit(candidates.count()), row_block)}
        sized = lambda df: df.withColumns(whole)

    def dealt(df: DataFrame, member: bool, own: str, others: str) -> DataFrame:
        # Without rows on the other side there are no blocks to deal to.
        mine, other = F.pmod(F.xxhash64("row"), own).cast("int"), F.explode(F.filter(F.sequence(F.lit(0), F.col(others)), lambda i: i < F.col(others)))
        df = sized(df).withColumn("mine", mine).withColumn("other", other)
        a, c = ("other", "mine") if member else ("mine", "other")
        return df.select(F.concat_ws("/", "g", a, c).alias("pair"), F.lit(member).alias("member"), "row", "id", "label", "goals", "data")

    both = dealt(anchors, False, "na", "nc").unionByName(dealt(candidates, True, "nc", "na"))
    return both.repartition("pair").sortWithinPartitions("pair", "member", "id", "row")


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` by score and id of what all blocks have found, with ``place`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(df: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         anchor_block: int = 1024, row_block: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` is a condition on ``id`` and ``label``. A score is the inner product of the floors of ``scale`` times the components. Rows are
    ordered by score, highest first, ties by id. An anchor's positives are its first ``n_positives`` other rows of its label; for each of them, the
    negatives are the first ``n_negatives`` rows of other labels with a score from ``low`` to ``high`` percent of the positive's.

    Rows without id, label or vector, or with a component that is null or not finite, take no part; of vectors of different lengths, the
    missing components count as 0. Repeated rows are rows of their own, so the twin of an anchor is one of its positives and an anchor
    itself. An empty table, or one without anchors, gives no rows. Scores that could leave 64 bits are an error.
    """
    rows = hold(whole_numbers(df, id_col, vector_col, label_col, scale))
    anchors = rows.filter(is_anchor)
    size = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, -x - 1)))), F.lit(0))).first()
    width = max(1, -(-size[0] // GROUP)) * GROUP
    bits, bound = int(size[1]).bit_length() + 1, width * (int(size[1]) + 1) ** 2
    if bound >= 1 << 62:
        raise ValueError("the components are too large for exact scores in 64 bits")
    dtype = np.int32 if bound < 1 << 30 else np.int64
    label = rows.schema["label"].dataType.simpleString()
    packed = hold(rows.select("row", "id", "label", "v").mapInArrow(packed_rows(width, bits), f"row long, id long, label {label}, data binary"))
    candidates = packed.withColumn("goals", F.lit(None).cast("array<long>"))

    def search(heads: DataFrame, same_label: bool, collect) -> DataFrame:
        heads = heads.select("row", "id", "label", "goals", "v").mapInArrow(anchor_rows(width), f"row long, id long, label {label}, goals array<long>, data binary")
        met = pairs_of_blocks(hold(heads), candidates, same_label, anchor_block, row_block)
        return met.mapInArrow(scored_rows(width, bits, dtype, collect), ", ".join(f"{c} long" for c in FOUND))

    near = search(anchors.withColumn("goals", F.lit(None).cast("array<long>")), True, lambda a: Positives(a, n_positives + 1, dtype))
    # The anchor itself is among the first n + 1 or behind them.
    near = first_of(near, ["anchor"], n_positives + 1).filter("row <> anchor")
    near = hold(first_of(near, ["anchor"], n_positives).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    goals = near.groupBy("anchor").agg(F.collect_set("positive_score").alias("goals"))
    heads = anchors.join(goals, F.col("row") == F.col("anchor")).drop("anchor")
    far = search(heads, False, lambda a: Negatives(a, n_negatives, dtype, low, high))
    far = first_of(far, ["anchor", "goal"], n_negatives).select(F.col("anchor").alias("a"), "goal", "place", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(far, (F.col("anchor") == F.col("a")) & (F.col("positive_score") == F.col("goal")))
    out = out.join(anchors.select("row", F.col("id").alias("anchor_id")), F.col("anchor") == F.col("row"))
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

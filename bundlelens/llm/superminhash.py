"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import WordHashes, chunks, documents, grams, hold, id_type, keep_rows, mixed, same_row, utf8
from bundlelens.llm.components import components

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS


def shingles(text: bytes, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``n`` words, letters A-Z lowered; a shorter text is one run, no words give none."""
    words = text.lower().split()
    return np.unique(grams(hashes.of(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash of each set.

    Each element deals out the slots in a random order of its own, drawn one by one, and gives the j-th slot the value j plus a random
    fraction; a slot keeps the least value. All elements take one step at a time, and a set stops as soon as all its slots are
    below the next step, which for large sets is after a few. Values are held as fixed point, j in the upper half.
    """
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    flat = out.ravel()
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(element), 1))
    for j in range(SLOTS):
        if not len(element):
            break
        x = mixed(element + np.uint64((j + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        k = j + ((x & np.uint64(0xFFFFFFFF)) % np.uint64(SLOTS - j)).astype(np.int64)
        row = np.arange(len(element))
        slot = order[row, k]
        order[row, k] = order[:, j]
        np.minimum.at(flat, owner * SLOTS + slot, (x >> np.uint64(32)) | np.uint64(j << 32))
        going = (out.max(1) >= np.uint64((j + 1) << 32))[owner]
        if not going.all():
            element, owner, order = element[going], owner[going], order[going]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]) + np.uint64(1)
    for r in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def sketch_rows(n: int):
    def rows(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = utf8(batch.column("text"))
            for lo, hi in chunks(texts, 1 << 20):
                sets = [shingles(t, hashes, n) for t in texts[lo:hi]]
                keys = band_keys(signatures(sets)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), batch.column("th").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array(list(keys), pa.list_(pa.int64()))], ["id", "th", "n_shingles", "c", "bands"])

    return rows


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def hub_rows(n: int, percent: int):
    """Compare members with their hub, which comes first in each sorted group; only the hub is kept in memory."""

    def rows(batches):
        hashes, hub, name = WordHashes(), None, None
        for batch in batches:
            a, b = [], []
            for pivot, is_member, c, text in zip(*(batch.column(x).to_pylist() for x in ("pivot", "member", "c")), utf8(batch.column("text")), strict=True):
                own = shingles(text, hashes, n)
                if not is_member:
                    hub, name = own, pivot
                elif name == pivot and alike(own, hub, percent):
                    a.append(pivot)
                    b.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows


def cross_links(names: list[bytes], comps: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between members of different components that join them: every member outside the largest is compared with all others."""
    parent = {c: c for c in comps}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    sizes = np.array([len(s) for s in sets])
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    count: dict[bytes, int] = {}
    for c in comps:
        count[c] = count.get(c, 0) + 1
    largest = max(count, key=lambda c: (count[c], c))
    out = []
    for i, c in enumerate(comps):
        if c == largest:
            continue
        lo, hi = np.searchsorted(element, sets[i], "left"), np.searchsorted(element, sets[i], "right")
        m = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes - both)).tolist():
            if root(comps[j]) != root(c):
                parent[root(comps[j])] = root(c)
                out.append((names[i], names[j]))
    return out


def block_rows(n: int, percent: int):
    def rows(batches):
        hashes = WordHashes()
        held: list[tuple] = []

        def done():
            out = cross_links([h[1] for h in held], [h[2] for h in held], [h[3] for h in held], percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for block, c, comp, text in zip(*(batch.column(x).to_pylist() for x in ("block", "c", "comp")), utf8(batch.column("text"))):
                if held and held[-1][0] != block:
                    yield done()
                    held.clear()
                held.append((block, c, comp, shingles(text, hashes, n)))
        if held:
            yield done()

    return rows


def near_duplicates(df: DataFrame, words: int = 4, percent: int = 80, block: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id``, ``th``, ``n_shingles``, ``component_id`` (least id reachable by links), ``kept``.

    Texts are linked when their sets of ``words``-word shingles share at least ``percent`` percent of their union. Equal sets are one class,
    so copies never meet in pairs. Classes sharing a band are candidates: each bucket's members are first compared with one hub, the class
    with most documents; then buckets whose members lie in several components compare the rest, in blocks of ``block`` members, until
    every candidate pair between components has been judged. Verification is on whole sets; a pair at exactly 80 percent is a
    candidate with probability above 1 - 1e-7. Null and empty texts have no shingles and link with nothing; a null id is never a
    component's name unless alone; of rows with the least id (repeated rows), all are kept; an empty table gives no rows.
    """
    docs = documents(df, id_col, text_col)
    kind = id_type(docs)
    marks = hold(docs.select("id", "th", "text").mapInArrow(sketch_rows(words), f"id {kind}, th long, n_shingles long, c binary, bands array<long>"))
    some = marks.filter("c is not null")
    classes = hold(some.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min(F.struct("id", "th")).alias("one"),
                                         F.min("bands").alias("bands")))
    bands = classes.select("c", "n", F.explode("bands").alias("b"))
    shared = hold(bands.groupBy("b").agg(F.count("*").alias("size")).filter("size > 1"))
    members = hold(bands.join(shared, "b"))
    hubs = members.groupBy("b").agg(F.max(F.struct("n", "c")).getField("c").alias("pivot"))
    pairs = hold(members.join(hubs, "b").filter("c <> pivot").select("pivot", "c").distinct())
    wanted = members.select("c").distinct().join(classes.select("c", "one"), "c").select("c", F.col("one.id").alias("id"), F.col("one.th").alias("th"))
    texts = hold(docs.join(wanted, same_row(docs, wanted)).select("c", "text").dropDuplicates(["c"]))

    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = pairs.join(parts, "pivot").select("pivot", "c", F.pmod(F.xxhash64("c"), "parts").cast("int").alias("part"), F.lit(True).alias("member"))
    heads = parts.select("pivot", F.col("pivot").alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"))
    compared = dealt.unionByName(heads).join(texts, "c").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member")
    links = hold(compared.select("pivot", "member", "c", "text").mapInArrow(hub_rows(words, percent), "a binary, b binary"))

    linked = components(links)
    placed = members.filter("size > 2").join(linked, F.col("c") == F.col("node"), "left").select("b", "c", F.coalesce("component", "c").alias("comp"))
    # Buckets with the same members need one look.
    mixed_ = placed.groupBy("b").agg(F.count("*").alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y"),
                                     F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("r"))
    mixed_ = mixed_.filter("x <> y").groupBy("size", "s", "r").agg(F.min("b").alias("b"))
    mixed_ = mixed_.select("b", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    rest = placed.join(mixed_, "b")
    part = F.pmod(F.xxhash64("c", "b"), "parts").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rest = rest.withColumn("i", part).withColumn("j", other)
    rest = rest.select(F.concat_ws("/", "b", F.least("i", "j"), F.greatest("i", "j")).alias("block"), "c", "comp")
    rest = rest.join(texts, "c").repartition("block").sortWithinPartitions("block", "c")
    more = hold(rest.select("block", "c", "comp", "text").mapInArrow(block_rows(words, percent), "a binary, b binary"))
    if not more.isEmpty():
        linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = classes.select("c", "least").join(linked, F.col("c") == F.col("node"), "left").select("c", "least", "component")
    least = named.filter("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    named = named.join(least, "component", "left").select(F.col("c").alias("class"), F.coalesce("smallest", "least").alias("smallest"))
    out = marks.select("id", "th", "n_shingles", "c").join(named, F.col("c") == F.col("class"), "left")
    name = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return out.select("id", "th", "n_shingles", name.alias("component_id"), F.col("id").eqNullSafe(name).alias("kept"))


def deduplicate(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that are kept, one of each group; of equal rows one stays."""
    kept = near_duplicates(df, words, percent, id_col=id_col, text_col=text_col).filter("kept")
    kept = hold(kept.groupBy("id", "th").agg(F.count("*").alias("n")))
    return keep_rows(df, kept, None, id_col, text_col, once=not kept.filter("n > 1").isEmpty())

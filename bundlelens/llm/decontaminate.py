"""Benchmark decontamination by templates.

Texts become tokens in which numbers, units and names are typed placeholders. Windows of the items' templates are a table, joined by hash
with those of the documents; pairs with enough windows in common are aligned, and equal placeholders of the item must then have equal
values in the document, so that a question with other numbers or names is caught and a chance match of placeholders is not.
"""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import documents, hold, id_type, mixed, utf8

#: Units of measure that count as one placeholder.
UNITS = frozenset("""mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec secs second
seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent
cents percent pct degree degrees mph kph kmh""".split())
NUMBER, UNIT, NAME, PLAIN = 1, 2, 3, 0
#: Bits of the filter of item windows that goes to the tasks, 4 MB whatever the benchmark's size; what passes by chance ends in the join.
FILTER_BITS = 1 << 25
_EDGE = re.compile(r"^\W+|\W+$")
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?(?:st|nd|rd|th)?")


class Tokens(dict):
    """Per word as written one number: hash of its plain form and, in the low five bits, its type, capital, end of sentence, whether it is a word."""

    def __missing__(self, word: bytes):
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        text = word.decode("utf-8", "replace")
        if text.isalpha():
            # Letters alone have no marks at their ends and are no number.
            low = text.lower()
            code = (UNIT if low in UNITS else PLAIN) | text[0].isupper() << 2 | 1 << 4
        else:
            core = _EDGE.sub("", text)
            low = core.lower()
            kind = NUMBER if _NUMBER.fullmatch(core) else UNIT if low in UNITS else PLAIN
            code = kind | core[:1].isupper() << 2 | (text[-1:] in ".!?:|") << 3 | bool(core) << 4
        value = self[word] = xxhash.xxh3_64_intdigest(low) & ~31 | code
        return value


#: What stands for a type of token in a template.
_PLACEHOLDER = mixed(np.arange(4, dtype=np.uint64))


def template(text: bytes, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Three rows of hashes of a text's tokens, plain, typed and by value, and the tokens' types.

    A capitalised word is a name unless it begins a sentence or line; runs of marks alone are no tokens.
    """
    words = text.split()
    value = np.fromiter(map(tokens.__getitem__, words), np.uint64, len(words))
    code = (value & np.uint64(31)).astype(np.uint8)
    kind = code & 3
    name = (code & 7) == 4
    name[:1] = False
    name[1:] &= (code[:-1] & 8) == 0
    kind[name] = NAME
    word = code > 15
    if not word.all():
        value, kind = value[word], kind[word]
    value &= ~np.uint64(31)
    forms = np.empty((3, len(value)), np.uint64)
    forms[:] = value
    # Numbers and units are placeholders in both forms, names only in the typed one, for texts that changed their case.
    at = np.flatnonzero(kind)
    forms[1, at] = _PLACEHOLDER[kind[at]]
    at = at[kind[at] != NAME]
    forms[0, at] = forms[1, at]
    return forms, kind


def covered(ats: list[int], n: int) -> int:
    """Tokens that windows of ``n`` tokens at the sorted places ``ats`` cover together."""
    return sum(min(n, b - a) for a, b in zip(ats, ats[1:])) + n if ats else 0


class Doc:
    """Forms of a text's tokens and, per window of a length, its keys."""

    def __init__(self, text: bytes, tokens: Tokens):
        forms, self.kind = template(text, tokens)
        self.values, self.mixed = forms[2], mixed(forms)

    def keys(self, n: int) -> np.ndarray:
        """Windows of ``n`` tokens as join keys, a row per form; different lengths, and templates and values, never meet."""
        m = self.mixed.shape[1] - n + 1
        if m <= 0:
            return np.empty((3, 0), np.uint64)
        out = self.mixed[:, :m].copy()
        for k in range(1, n):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += self.mixed[:, k : k + m]
        out ^= mixed(np.array([[2 * n + 1], [2 * n + 1], [2 * n + 2]], np.uint64))
        return mixed(out)


class Item:
    """Windows of an item as sorted pairs of key and place, and how many of its tokens make a leak."""

    def __init__(self, text: bytes, tokens: Tokens, size: int, share: float, run: int, min_plain: int):
        doc = Doc(text, tokens)
        self.values, self.kind, self.length = doc.values, doc.kind, len(doc.values)
        self.n = n = min(size, self.length)
        self.need, self.row = int(np.ceil(self.length * share - 1e-9)), run - n + 1
        self.least = -(-min(self.need, run) // n) if n else 0
        self.key, self.at = np.empty(0, np.uint64), np.empty(0, np.int64)
        if not n:
            return
        few, found = (doc.kind == PLAIN).sum() < min_plain, []
        plain, typed, whole = doc.keys(n)
        for own, word in ((plain, (doc.kind == PLAIN) | (doc.kind == NAME)), (typed, doc.kind == PLAIN)):
            weak = few | (np.convolve(word, np.ones(n, int), "valid") < min(2, n))
            found.append(np.stack([np.where(weak, whole, own), np.arange(len(own), dtype=np.uint64)], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        self.key, self.at = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64)

    def match(self, doc: Doc) -> int:
        """Tokens of the item under windows of one alignment whose placeholders correspond; 0 if no alignment has ``need`` of them, or ``run`` in a row.

        Each window of the document votes for the alignments with the first and the last place of the item that has it. In every stretch of
        alignments of about half the item's length, the first and the last of those with most votes are tried. Work and memory grow with the sum of both lengths.
        """
        reach = (self.length - self.n + 1) // 2 + 10
        key, first, count = np.unique(self.key, return_index=True, return_counts=True)
        hits, places = [], []
        for form in doc.keys(self.n):
            if len(key) and len(form):
                k = np.minimum(np.searchsorted(key, form), len(key) - 1)
                p = np.flatnonzero(key[k] == form)
                hits.append(k[p])
                places.append(p)
        if not hits or not sum(map(len, hits)):
            return 0
        pairs = np.unique(np.stack([np.concatenate(hits), np.concatenate(places)], 1), axis=0)
        k, p = pairs[:, 0], pairs[:, 1]
        if covered(np.unique(np.concatenate([self.at[first[i] : first[i] + count[i]] for i in np.unique(k)])).tolist(), self.n) < min(self.need, self.row + self.n - 1):
            return 0
        shift, votes = np.unique(np.concatenate([p - self.at[first[k]], p - self.at[first[k] + count[k] - 1]]), return_counts=True)
        starts = np.flatnonzero(np.diff(shift // reach, prepend=shift[0] // reach - 1))
        for lo, hi in zip(starts, [*starts[1:], len(shift)]):
            top = lo + np.flatnonzero(votes[lo:hi] == votes[lo:hi].max())
            for d in sorted({int(shift[top[0]]), int(shift[top[-1]])}):
                total = self._aligned(doc, d, reach, key, k, p)
                if total:
                    return total
        return 0

    def _aligned(self, doc: Doc, d: int, reach: int, key: np.ndarray, k: np.ndarray, p: np.ndarray) -> int:
        """Per window of the item its nearest places in the document at and beyond alignment ``d``, nearer ones first, while their values agree."""
        n, wide = self.n, int(p.max()) + 1
        line, own = k * wide + p, np.searchsorted(key, self.key)
        near = np.searchsorted(line, own * wide + np.clip(self.at + d, 0, wide - 1), "right")
        at, there = [], []
        for pick in (near - 1, near):
            ok = (pick >= 0) & (pick < len(line))
            ok[ok] &= k[pick[ok]] == own[ok]
            at.append(self.at[ok])
            there.append(p[pick[ok]])
        at, there = np.concatenate(at), np.concatenate(there)
        away = np.abs(there - at - d)
        close = away <= reach
        at, there, away = at[close], there[close], away[close]
        if len(np.unique(at)) * n < min(self.need, self.row + n - 1):
            return 0
        order = np.lexsort((there, at, away))
        slots: dict[tuple[int, int], int] = {}
        seen: dict[int, int] = {}
        for a, b in zip(at[order].tolist(), there[order].tolist()):
            if a in seen:
                continue
            new: dict[tuple[int, int], int] = {}
            for j in range(n):
                if self.kind[a + j] and doc.kind[b + j]:
                    slot, value = (int(self.kind[a + j]), int(self.values[a + j])), int(doc.values[b + j])
                    if slots.get(slot, new.get(slot, value)) != value:
                        break
                    new[slot] = value
            else:
                slots.update(new)
                seen[a] = b
        ats = sorted(seen)
        total, longest, now = covered(ats, n), 0, 0
        for j, a in enumerate(ats):
            now = now + 1 if j and ats[j - 1] == a - 1 and seen[a - 1] == seen[a] - 1 else 1
            longest = max(longest, now)
        return total if total >= self.need or longest >= self.row else 0


def find_leaks(df: DataFrame, benchmark: DataFrame, window: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", run: int = 30, min_plain: int = 3) -> DataFrame:
    """Per row ``id``, ``th``, ``items`` (leaked benchmark items, sorted), ``share`` (of an item's tokens, at its first alignment that suffices; most of all items), ``contaminated``.

    A document leaks an item when ``window``-token windows of the item stand in it close together, their placeholders correspond, and they cover at
    least ``share`` of the item's tokens or ``run`` tokens in a row, so that edited items and excerpts of long ones count. Windows with less than two words
    beside placeholders, and all of an item with less than ``min_plain`` such words, are compared by their values as they stand. An item of fewer tokens is one window; an item without tokens, or null, leaks nowhere; null text leaks nothing; equal rows
    get equal results; an empty table of documents gives no rows, an empty benchmark no leaks; of items with one id each text counts.

    Items meet documents in a join of window hashes. Only windows that pass a filter of fixed size leave the tasks that read documents. Pairs
    with fewer windows in common than any leak has are dropped; each other pair is checked by itself.
    """
    docs = documents(df, id_col, text_col)
    bench = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col("text")).filter("item is not null and text is not null")
    bench = bench.withColumn("ih", F.xxhash64("text")).dropDuplicates(["item", "ih"])
    item_type, key_type = id_type(bench, "item"), id_type(docs)
    made = dict(size=window, share=share, run=run, min_plain=min_plain)

    def item_windows(batches):
        tokens = Tokens()
        for batch in batches:
            items = [Item(t, tokens, **made) for t in utf8(batch.column("text"))]
            found = [np.unique(x.key, return_counts=True) for x in items]
            row = pa.array(np.repeat(np.arange(len(items)), [len(w) for w, _ in found]))
            lead = [x.least for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(row), batch.column("ih").take(row), pa.array(np.concatenate([w for w, _ in found] or [[]]).astype(np.uint64).view(np.int64)),
                 pa.array(np.concatenate([c for _, c in found] or [[]]).astype(np.int64)), pa.array(np.array(lead, np.int64)).take(row),
                 pa.array(np.array([x.n for x in items], np.int64)).take(row)], ["item", "ih", "w", "places", "least", "n"])

    known = hold(bench.select("item", "ih", "text").mapInArrow(item_windows, f"item {item_type}, ih long, w long, places long, least long, n long"))
    lengths = sorted(r[0] for r in known.select("n").distinct().collect())
    bit = F.pmod("w", F.lit(FILTER_BITS)) + 1
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    part = known.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    for b, chunk in part.collect():
        bits[(b - 1) * len(chunk) : b * len(chunk)] = np.frombuffer(bytes(chunk), np.uint8)

    def doc_windows(batches):
        tokens, mask, one = Tokens(), np.uint64(FILTER_BITS - 1), np.uint8(1) << np.arange(8, dtype=np.uint8)
        for batch in batches:
            found = []
            for text in utf8(batch.column("text")):
                doc, some = Doc(text, tokens), [np.empty(0, np.uint64)]
                for n in lengths:
                    w = doc.keys(n).ravel()
                    x = w & mask
                    some.append(w[bits[x >> np.uint64(3)] & one[x & np.uint64(7)] > 0])
                found.append(np.unique(np.concatenate(some)))
            row = pa.array(np.repeat(np.arange(len(found)), [len(w) for w in found]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("th").take(row), pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))],
                                             ["id", "th", "w"])

    met = docs.select("id", "th", "text").mapInArrow(doc_windows, f"id {key_type}, th long, w long").join(known.drop("n"), "w")
    pairs = met.groupBy("id", "th", "item", "ih").agg(F.sum("places").alias("places"), F.max("least").alias("least")).filter("places >= least")
    pairs = hold(pairs.select("id", "th", "item", "ih"))

    def checked(batches):
        tokens = Tokens()
        item_of = lru_cache(1000)(lambda text: Item(text, tokens, **made))
        doc_of = lru_cache(2)(lambda text: Doc(text, tokens))
        for batch in batches:
            total = []
            for text, item in zip(utf8(batch.column("text")), utf8(batch.column("item_text"))):
                item = item_of(item)
                total.append(item.match(doc_of(text)) / item.length)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), batch.column("item"), pa.array(total, pa.float64())], ["id", "th", "item", "share"])

    i, t = F.col("id").alias("i"), F.col("th").alias("t")
    texts = docs.join(pairs.select(i, t).distinct(), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left_semi").dropDuplicates(["id", "th"])
    wide = pairs.join(bench.withColumnRenamed("text", "item_text"), ["item", "ih"]).select(i, t, "item", "item_text")
    wide = wide.join(texts, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))
    leaks = wide.select("id", "th", "text", "item", "item_text").mapInArrow(checked, f"id {key_type}, th long, item {item_type}, share double").filter("share > 0")
    leaks = leaks.groupBy(i, t).agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("share").alias("share"))
    out = docs.select("id", "th").join(leaks, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    return out.select("id", "th", F.coalesce("items", F.array().cast(f"array<{item_type}>")).alias("items"), F.coalesce("share", F.lit(0.0)).alias("share"),
                      F.col("items").isNotNull().alias("contaminated"))

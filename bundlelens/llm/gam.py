"""Quality classifier: an additive model with pairwise terms, boosted in turn over its terms.

Each term, one feature or a pair of features, is a lookup table over bins. Training goes round the terms; at each visit a shallow
tree over the term's bins is fitted to the gradient of the logistic loss and added to its table. A score is a sum of
looked-up values.
"""

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import documents, hold, id_type, utf8

FEATURES = ["log_words", "bytes_per_word", "symbols", "pipes", "capitals", "digits", "exclamations", "stops", "other_marks", "high_bytes",
            "different_words", "words_per_line", "repeated_lines", "capital_words"]
_SETS = {"symbols": b"#$%&*<>", "pipes": b"|", "digits": b"0123456789", "exclamations": b"!?", "stops": b".,", "other_marks": b"\"'()-/:;=@[]_{}~^`+\\"}


def features(text: bytes) -> list[float]:
    """Numbers from the whole text; every share is 0 for a text without words."""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    words = text.split()
    n, size = len(words), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = {k: count[list(v)].sum() / max(1, n) for k, v in _SETS.items()}
    upper, lower = count[65:91].sum(), count[97:123].sum()
    return [np.log1p(n), len(text) / max(1, n), share["symbols"], share["pipes"], upper / max(1, upper + lower), share["digits"], share["exclamations"],
            share["stops"], share["other_marks"], count[128:].sum() / size, len(set(words)) / max(1, n), n / max(1, len(lines)),
            1 - len(set(lines)) / max(1, len(lines)), sum(map(bytes.isupper, words)) / max(1, n)]


def feature_rows(batches):
    for batch in batches:
        texts = utf8(batch.column("text"))
        for lo in range(0, len(texts), 1000):
            table = np.array([features(t) for t in texts[lo : lo + 1000]])
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, 1000), batch.column("th").slice(lo, 1000),
                                              pa.array(list(table), pa.list_(pa.float64()))], ["id", "th", "x"])


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    wide: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], "right")]
        coarse = [np.searchsorted(w, x[:, j], "right") for j, w in enumerate(self.wide)]
        for (i, j), grid in zip(self.pairs, self.grids):
            total += grid[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def gain(g, h, smooth: float):
    return g * g / (h + smooth)


def tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """Value per bin of a tree with so many leaves, grown by the best cut of any leaf."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        k = np.arange(a + 1, b)
        gl, hl, gr, hr = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[k], ch[b] - ch[k]
        better = gain(gl, hl, smooth) + gain(gr, hr, smooth) - gain(cg[b] - cg[a], ch[b] - ch[a], smooth)
        return float(better.max()), int(k[better.argmax()])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        (better, cut), at = max((best(*p), i) for i, p in enumerate(parts))
        if better <= 1e-9:
            break
        a, b = parts[at]
        parts[at : at + 1] = [(a, cut), (cut, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """Value per cell of a tree that cuts one feature, then the other on each side; and its gain."""
    best_value, best_gain = np.zeros_like(g), 0.0
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(gg)):
            value, total = np.empty_like(gg), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                side_g, side_h = gg[rows].sum(0), hh[rows].sum(0)
                side = tree(side_g, side_h, 2, smooth)
                value[rows] = side
                total += float(-(side * side_g).sum() - 0.5 * (side * side * side_h).sum())
            if total > best_gain:
                best_gain, best_value = total, value.T if turn else value
    return best_value, best_gain


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 8, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 6,
        leaves: int = 3, rate: float = 0.15, smooth: float = 5.0) -> Model:
    """Model of ``y`` (0 or 1); without rows of both kinds, the smoothed share of ones everywhere."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    width = len(FEATURES)
    if not len(y) or y.min() == y.max():
        return Model(float(np.log(mean / (1 - mean))), [np.empty(0)] * width, [np.empty(0)] * width, [np.zeros(1)] * width)
    cuts = [quantile_cuts(x[:, j], bins) for j in range(width)]
    wide = [quantile_cuts(x[:, j], coarse) for j in range(width)]
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    model = Model(float(np.log(mean / (1 - mean))), cuts, wide, [np.zeros(len(c) + 1) for c in cuts])
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), leaves, smooth)
            table += step
            total += step[at[j]]
    cells, shapes = {}, {}
    g, h = slopes()
    ranked = []
    low = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(wide)]
    for i, j in combinations(range(width), 2):
        shapes[i, j] = (len(wide[i]) + 1, len(wide[j]) + 1)
        cells[i, j] = low[i] * shapes[i, j][1] + low[j]
        size = shapes[i, j][0] * shapes[i, j][1]
        ranked.append((pair_tree(*(np.bincount(cells[i, j], v, size).reshape(shapes[i, j]) for v in (g, h)), smooth)[1], (i, j)))
    model.pairs = [p for better, p in sorted(ranked, reverse=True)[:n_pairs] if better > 1e-6]
    model.grids = [np.zeros(shapes[p]) for p in model.pairs]
    for _ in range(pair_rounds):
        for p, grid in zip(model.pairs, model.grids):
            g, h = slopes()
            step = rate * pair_tree(*(np.bincount(cells[p], v, grid.size).reshape(grid.shape) for v in (g, h)), smooth)[0]
            grid += step
            total += step.ravel()[cells[p]]
    return model


def score_rows(model: Model):
    def rows(batches):
        for batch in batches:
            x = np.stack(batch.column("x").to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(model.scores(x))], ["id", "th", "score"])

    return rows


def classify(df: DataFrame, labels: DataFrame, max_train_rows: int = 40_000, threshold: float = 0.3, held_mod: int = 5, label: str = "quality",
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id``, ``held_out``, ``score``, ``predicted``.

    Rows whose crc32 of the id (as text) is a multiple of ``held_mod`` are held out. The model is fitted on at most ``max_train_rows`` labelled
    rows of the others, those whose id hashes lowest (about as many, at most as many); its input is the text alone. Features of all texts are computed once. Null text is
    empty text and gets a score as well; a null id is not held out and never labelled; labels other than 0 and 1 are ignored;
    repeated labels count each; with no usable labels every score is 0.5.
    """
    docs = documents(df, id_col, text_col)
    table = hold(docs.select("id", "th", "text").mapInArrow(feature_rows, f"id {id_type(docs)}, th long, x array<double>"))
    out = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(held_mod)) == 0, F.lit(False))
    known = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    sample = table.filter(~out).join(known, F.col("id") == F.col("i")).select("x", "y", F.xxhash64("id", "th").alias("h"))
    # Each task sends the driver its own lowest rows, so the hash bounds what all tasks send together before the limit makes it exact.
    lowest = F.col("h") / F.lit(2.0**64) + 0.5 < max_train_rows / max(1, sample.count())
    rows = sample.filter(lowest).orderBy("h", "y").limit(max_train_rows).select("x", "y").toPandas()
    x = np.stack(rows["x"]) if len(rows) else np.empty((0, len(FEATURES)))
    model = fit(x, rows["y"].to_numpy(float))
    scored = table.mapInArrow(score_rows(model), f"id {id_type(docs)}, th long, score double")
    return scored.select("id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

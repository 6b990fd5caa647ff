"""Fuzzy line deduplication, in DataFrame functions only.

Lines are compared by the ``width``-character shingles at every character. A signature of ``2 * bands`` least hashes per line is
made where the lines are read, grouped by the line's hash and combined before the shuffle, so texts of lines aren't
shuffled for it; texts of lines in shared buckets are then cut from their documents. Lines that share a band (two least hashes) are compared with the commonest of them; lines then left in
another component than it are compared with the rest of their bucket, where bitmaps of the shingles rule out pairs that cannot be
alike within the join. Similarity counts all shingles, by hashes of 64 bits; components are
found by distributed union-find.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bundlelens.llm.common import documents, hold
from bundlelens.llm.components import components

BLANKS = " \t\n\x0b\f\r"


def shingles(line: Column, width: int) -> Column:
    """All runs of ``width`` characters, in order, in time linear in the line's length.

    Where every character is one byte, runs are cut from the bytes; elsewhere each match of a pattern goes on by one character.
    """
    size = F.length(line)
    cut = F.transform(F.array(line.cast("binary")), lambda raw: F.transform(F.sequence(F.lit(0), size - width), lambda k: F.substring(raw, k + 1, width).cast("string")))
    matches = F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{width}}}))."), F.lit(1))
    return F.when((F.octet_length(line) == size) & (size >= width), cut[0]).otherwise(matches)


def place(k: Column) -> Column:
    """Where character ``k`` begins among four bytes per character. Bits need no test for overflow, which costs more than the sum."""
    return F.shiftleft(k, 2).bitwiseOR(F.lit(1))


def spread(lines: DataFrame, width: int, *columns: str) -> DataFrame:
    """``columns`` of ``lines``, ``k`` and ``s`` of each run of ``width`` characters of ``norm``, one row each.

    ``s`` has four bytes per character in all lines: places are then found at once, and equal runs are equal bytes.
    """
    rows = lines.select(*columns, F.encode("norm", "UTF-32").alias("raw"))
    last = F.shiftright(F.octet_length("raw"), 2) - width
    rows = rows.select(*columns, "raw", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("k"))
    return rows.select(*columns, "k", F.substring("raw", place(F.col("k")), F.lit(4 * width)).alias("s"))


def hashes(line: Column, width: int) -> Column:
    """A 64-bit hash of each run of ``width`` characters, in order, of the four bytes per character that ``spread`` cuts."""
    def cut(raw: Column) -> Column:
        last = F.shiftright(F.octet_length(raw), 2) - width
        each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.xxhash64(F.substring(raw, place(k), F.lit(4 * width))))
        return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))

    # Within a function the line is encoded once, not for each run.
    return F.transform(F.array(F.encode(line, "UTF-32")), cut)[0]


#: Runs of a line that one row of the grouped pass holds; a power of two.
STEP = 4


def signatures(lines: DataFrame, width: int, bands: int) -> DataFrame:
    """Per different line ``h``: ``n`` (how often it occurs), an ``id``, ``th`` and ``line_no`` where it stands, and a key per band.

    Each run is hashed once. A slot takes the run whose hash is nearest to the slot's own number, by exclusive or: two lines agree in it
    if the nearest of their union is in both, so with the probability of their similarity, and a line of few runs fills all slots.
    """
    slots = [(i << 32) // (2 * bands) + (i + 1) * 0x9E3779B1 % ((1 << 32) // (2 * bands)) - (1 << 31) for i in range(2 * bands)]
    rows = lines.select("h", F.xxhash64(F.lit(1), "norm").alias("h2"), "id", "th", "line_no", F.encode("norm", "UTF-32").alias("raw"))
    last = F.shiftright(F.octet_length("raw"), 2) - width
    rows = rows.select("*", last.alias("last"), F.explode(F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(STEP)))).alias("k"))
    # Behind the last run it is taken again, which changes no least value.
    run = lambda j: F.substring("raw", place(F.least(F.col("k").bitwiseOR(F.lit(j)), F.col("last"))), F.lit(4 * width))
    rows = rows.select("h", "h2", "id", "th", "line_no", "k", *(F.shiftright(F.xxhash64(run(j)), 32).cast("int").alias(f"v{j}") for j in range(STEP)))
    least = [F.min(F.least(*(F.col(f"v{j}").bitwiseXOR(F.lit(x)) for j in range(STEP)))).alias(f"m{i}") for i, x in enumerate(slots)]
    # All of ``first`` see the same row.
    where = [F.first(c).alias(c) for c in ("id", "th", "line_no")]
    signs = rows.groupBy("h").agg(F.count(F.when(F.col("k") == 0, True)).alias("n"), F.min("h2").alias("x"), F.max("h2").alias("y"), *where, *least)
    keys = F.array(*(F.xxhash64(F.lit(i), f"m{2 * i}", f"m{2 * i + 1}") for i in range(bands)))
    return signs.filter("x = y").select("h", "n", "id", "th", "line_no", keys.alias("keys"))


def normal(line: str) -> Column:
    return F.lower(F.btrim(line, F.lit(BLANKS)))


def split_lines(docs: DataFrame) -> DataFrame:
    """``id``, ``th``, ``line_no``, ``line`` as it stands, and ``norm`` to compare: lower case, without blanks at its ends."""
    lines = docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("norm", normal("line"))


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h`` and ``norm`` of the ``wanted`` lines (``h``, ``id``, ``th``, ``line_no``), cut from their documents' texts."""
    wanted = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("h", "line_no")).alias("of"))
    found = docs.join(wanted.withColumnsRenamed({"id": "wid", "th": "wth"}), F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")))
    # Within a function the text is split once, not for each line.
    cut = F.transform(F.array(F.split("text", "\n")), lambda parts: F.transform("of", lambda w: F.struct(w["h"].alias("h"), parts[w["line_no"]].alias("line"))))[0]
    return found.select(F.inline(cut)).select("h", normal("line").alias("norm")).dropDuplicates(["h"])


def alike(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose lines share at least ``percent`` percent of their shingles.

    Shingles are many times longer than their line, so they are taken after the joins.
    """
    left, right = (texts.select(F.col("h").alias(x), F.col("norm").alias(f"{x}_norm"), F.col("m").alias(f"{x}_m")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").filter(100 * F.least("a_m", "b_m") >= percent * F.greatest("a_m", "b_m"))
    common = F.size(F.array_intersect(hashes(F.col("a_norm"), width), hashes(F.col("b_norm"), width)))
    return both.filter(common * (100 + percent) >= percent * (F.col("a_m") + F.col("b_m"))).select("a", "b")


#: A set's bitmap has WIDE words of 64 bits; folded into WORDS of them, it is looked at first.
WORDS, WIDE = 8, 32


def bitmaps(texts: DataFrame, width: int) -> DataFrame:
    """``h``, ``m`` (number of shingles), a bitmap of them in ``wide`` and, folded, in ``w0``, ``w1``, ..."""
    each = spread(texts, width, "h", "m").select("h", "m", F.xxhash64("s").alias("x"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(63)).cast("int"))
    words = each.groupBy("h", F.shiftrightunsigned("x", 59).cast("int").alias("k")).agg(F.first("m").alias("m"), F.bit_or(bit).alias("v"))
    sets = words.groupBy("h").agg(F.first("m").alias("m"), F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("of"))
    sets = sets.select("h", "m", F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda k: F.coalesce(F.try_element_at("of", k), F.lit(0).cast("long"))).alias("wide"))

    def folded(k: int) -> Column:
        word = F.col("wide")[k]
        for i in range(k + WORDS, WIDE, WORDS):
            word = word.bitwiseOR(F.col("wide")[i])
        return word

    return sets.select("h", "m", "wide", *(folded(k).alias(f"w{k}") for k in range(WORDS)))


def may_be_alike(a: str, b: str, percent: int, also: Column | None = None) -> Column:
    """False only for pairs below ``percent``, or without ``also``: bits that differ are fewer than shingles that differ, of which a similar pair has few.

    The folded bitmaps rule out most pairs at little cost; ``also`` and the whole ones then nearly all others, also among long lines of one template.
    """
    differ = sum((F.bit_count(F.col(f"{a}w{k}").bitwiseXOR(F.col(f"{b}w{k}"))) for k in range(1, WORDS)), F.bit_count(F.col(f"{a}w0").bitwiseXOR(F.col(f"{b}w0"))))
    whole = F.aggregate(F.zip_with(f"{a}wide", f"{b}wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    m = F.col(f"{a}m"), F.col(f"{b}m")
    most = (m[0] + m[1]) * (100 - percent)
    few = (100 * F.least(*m) >= percent * F.greatest(*m)) & (differ * (100 + percent) <= most)
    return (few if also is None else few & also) & (whole * (100 + percent) <= most)


def in_components(members: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` with their component ``c``, and the hub's component (``center``) of buckets that lie in several."""
    named = linked.select(F.col("node").alias("h"), F.col("component").alias("c"))
    placed = hold(members.join(named, "h", "left").withColumn("c", F.coalesce("c", "h")))
    several = placed.groupBy("b").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.max(F.when(F.col("h") == F.col("hub"), F.col("c"))).alias("center"))
    return placed, hold(several.filter("x <> y").select("b", "center"))


def mark_lines(df: DataFrame, min_chars: int = 24, width: int = 12, bands: int = 8, percent: int = 80, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Per line ``id``, ``th``, ``line_no``, ``first_id``, ``first_line`` (the line of its component that stays) and ``kept``.

    A line's component is all lines reachable by pairs that are equal or share at least ``percent`` percent of their shingles, compared
    without case and blanks at the ends; the line with the least id and number stays. Lines under ``min_chars`` characters, blank ones among them, always stay.
    Shingles are the runs of ``width`` characters at each position. A pair at exactly 80 percent becomes a candidate with probability 1 - 3e-4, at 85 percent with 1 - 4e-5. Null text is one empty line. Ids that
    are null come first. Equal rows count as one document, so both keep the line that stays. An empty table gives no rows. Two lines whose 64-bit hashes
    collide are left alone.
    """
    docs = documents(df, id_col, text_col)
    lines = split_lines(docs).withColumns({"h": F.xxhash64("norm"), "long": F.length("norm") >= min_chars})
    signs = hold(signatures(lines.filter("long"), width, bands))
    bucket = Window.partitionBy("b")
    members = signs.select("h", "n", F.explode("keys").alias("b")).withColumns({"size": F.count("*").over(bucket), "hub": F.max(F.struct("n", "h")).over(bucket)["h"]})
    members = hold(members.filter("size > 1"))
    weights = hold(members.select("h", "n").distinct())
    members = members.drop("n")
    texts = fetched(docs, signs.join(weights.select("h"), "h"))
    texts = hold(texts.withColumn("m", F.size(F.array_distinct(hashes(F.col("norm"), width)))))
    tried = members.filter("h <> hub").select(F.col("hub").alias("a"), F.col("h").alias("b")).distinct()
    links = hold(alike(tried, texts, width, percent))
    linked = components(links)
    placed, center = in_components(members.filter("size > 2"), linked)
    # The commonest line outside the hub's component is a second hub, which joins most of what belongs together.
    outer = placed.join(center, "b").filter("c <> center").join(weights, "h").groupBy("b").agg(F.max(F.struct("n", "h", "c")).alias("o"))
    outer = outer.select("b", F.col("o.h").alias("o"), F.col("o.c").alias("oc"))
    second = placed.join(outer, "b").filter("c <> oc").select(F.col("o").alias("a"), F.col("h").alias("b")).distinct()
    links = hold(links.unionByName(alike(second, texts, width, percent)))
    linked = components(links)
    placed, center = in_components(placed.drop("c"), linked)
    # Buckets that lie in one component whole need no further look.
    bits = bitmaps(texts.join(placed.join(center.select("b"), "b").select("h").distinct(), "h"), width)
    bits = hold(bits.join(signs.select("h", "keys"), "h"))
    placed = hold(placed.join(center, "b").join(bits, "h"))
    outside = placed.filter("c <> center").select(F.col("b").alias("ob"), F.col("h").alias("o"), F.col("c").alias("oc"), F.col("m").alias("om"), F.col("keys").alias("okeys"), F.col("wide").alias("owide"),
                                                  *(F.col(f"w{k}").alias(f"ow{k}") for k in range(WORDS)))
    # A pair is made in the first bucket that it shares, not in each of them.
    first_shared = F.coalesce(*(F.when(F.col("okeys")[i] == F.col("keys")[i], F.col("keys")[i]) for i in range(bands)))
    cross = outside.join(placed.filter("h <> hub"), (F.col("ob") == F.col("b")) & (F.col("oc") != F.col("c"))
                         & ((F.col("c") == F.col("center")) | (F.col("o") < F.col("h"))) & may_be_alike("o", "", percent, first_shared == F.col("b")))
    more = hold(alike(cross.select(F.col("o").alias("a"), F.col("h").alias("b")), texts, width, percent))
    if not more.isEmpty():
        linked = components(links.unionByName(more))
    # Lines that occur once and are linked with none need no more looking up.
    nodes = linked.select(F.col("node").alias("h"), F.col("component").alias("c"))
    again = hold(signs.filter("n > 1").select("h").join(nodes, "h", "full").select("h", F.coalesce("c", "h").alias("c")))
    # Short lines are looked up by a key of their own, so they don't meet in one task.
    every = hold(lines.select("id", "th", "line_no", "long", F.when(F.col("long"), F.col("h")).otherwise(F.xxhash64(F.lit(2), "th", "line_no")).alias("key")))
    slim = every.filter("long").join(again, F.col("key") == F.col("h"))
    first = slim.groupBy("c").agg(F.min(F.struct("id", "th", "line_no")).alias("first"))
    found = again.join(first, "c").select("h", F.lit(True).alias("is"), "first")
    out = every.join(found, (F.col("key") == F.col("h")) & (F.col("long") == F.col("is")), "left")
    own = F.col("first").isNull() | (F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.th") == F.col("th")) & (F.col("first.line_no") == F.col("line_no")))
    return out.select("id", "th", "line_no", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("first_id"),
                      F.coalesce("first.line_no", "line_no").alias("first_line"), own.alias("kept"))


def deduplicate(df: DataFrame, min_left_pct: int = 30, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Rows of ``df`` with the lines that stay, in order; columns as in ``df``.

    A document of which less than ``min_left_pct`` percent of the characters stay says nothing of its own and goes; a text that was blank before stays.
    """
    marks = mark_lines(df, id_col=id_col, text_col=text_col, **limits).filter(~F.col("kept"))
    gone = marks.groupBy("id", "th").agg(F.collect_set("line_no").alias("gone"))
    g = gone.select(F.col("id").alias("_llm_id"), F.col("th").alias("_llm_th"), F.col("gone").alias("_llm_gone"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = df.join(g, F.col(f"`{id_col}`").eqNullSafe(F.col("_llm_id")) & (F.xxhash64(text) == F.col("_llm_th")), "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_llm_gone", i)), "\n")
    out = out.withColumn("_llm_new", F.when(F.col("_llm_gone").isNull(), F.col(f"`{text_col}`")).otherwise(left))
    out = out.filter(F.col("_llm_gone").isNull() | (100 * F.length("_llm_new") >= min_left_pct * F.length(text)))
    return out.select(*(F.col("_llm_new").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns))

"""Repair of conversations: the cheapest edits that make the turns a system turn at most, then user and assistant by turns.

The rows of a conversation are parsed with a weighted grammar in Chomsky normal form. Its nonterminals are [p, q], "leads from p to q", where p
and q say what may come next; its rules are [p, q] -> [p, r] [r, q], with single rows and insertions at the leaves. A cell of a span of rows
holds, for each nonterminal, the least (cost, audit). Leaves are closed under insertion, and cells are combined bottom-up by the
spans' length, 1, 2, 4 and so on: since [p, r] and [r, q] may meet at any row, one place to split a span gives the minimum over all.

A very long conversation is cut into ranges of its turns, each parsed by itself, and the ranges' cells are combined in the same way; the
tree is then walked down again, which gives each range the part of the audit to apply to its rows.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import hold, id_type

BLANKS = " \t\n\x0b\f\r"
#: What stands before the first turn, after a system, user and assistant turn; and where a turn of an initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
#: Nonterminals that derive anything, and the pairs of places whose cells combine to each.
PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q or q >= USER or (p, q) == (START, SYSTEM)]
AT = {pair: i for i, pair in enumerate(PAIRS)}
RULES = [[(AT[p, r], AT[r, q]) for r in range(4) if (p, r) in AT and (r, q) in AT] for p, q in PAIRS]

Cell = tuple[tuple[int, str] | None, ...]


@dataclass(frozen=True)
class Costs:
    """``truncated`` is added to a truncated row that stays. An insertion must cost something."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


def combine(x: Cell, y: Cell) -> Cell:
    out = []
    for rule in RULES:
        found = [(x[i][0] + y[j][0], x[i][1] + y[j][1]) for i, j in rule if x[i] and y[j]]
        out.append(min(found) if found else None)
    return tuple(out)


def cell_of(options: list[tuple[int, int, int, str]]) -> Cell:
    out: list[tuple[int, str] | None] = [None] * len(PAIRS)
    for p, q, cost, edit in options:
        at = AT[p, q]
        out[at] = min(out[at] or (cost, edit), (cost, edit))
    return tuple(out)


@lru_cache(maxsize=64)
def insertions(costs: Costs) -> Cell:
    """The least insertions that lead from each place to each other."""
    once = cell_of([(p, p, 0, "") for p in range(4)] + [(p, q, costs.insert, "I") for (p, c), q in STEPS.items() if c in NAMES])
    while (more := combine(once, once)) != once:
        once = more
    return once


@lru_cache(maxsize=1024)
def leaf(kind: str, costs: Costs) -> Cell:
    """A row: ``x`` must go; else its role's initial (``o``: another), in capitals if the text is cut off."""
    options = [(p, p, costs.delete, "D") for p in range(4)]
    if kind != "x":
        more = costs.truncated if kind.isupper() else 0
        options += [(p, q, more, "K") for (p, c), q in STEPS.items() if c == kind.lower()]
        options += [(p, q, costs.rerole + more, "R") for (p, c), q in STEPS.items() if c in NAMES]
    closure = insertions(costs)
    return combine(combine(closure, cell_of(options)), closure)


@lru_cache(maxsize=200_000)
def short_span(kinds: str, costs: Costs) -> Cell:
    return span(kinds, costs)


def span(kinds: str, costs: Costs) -> Cell:
    """The cell of a run of rows; without rows, that of insertions alone."""
    if len(kinds) < 2:
        return leaf(kinds, costs) if kinds else insertions(costs)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    inner = short_span if half <= 8 else span
    return combine(inner(kinds[:half], costs), inner(kinds[half:], costs))


def best(cell: Cell) -> tuple[tuple[int, str], int]:
    """The least (cost, audit) that gives whole conversations, and where it ends."""
    return min((cell[AT[START, q]], q) for q in ENDS if cell[AT[START, q]])


def split(cells: list[Cell]) -> tuple[tuple[int, str], list[tuple[int, int]]]:
    """The least (cost, audit) of ranges in a row, and the nonterminal of each."""
    levels = [cells]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([combine(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    found, end = best(levels[-1][0])
    chosen = [(START, end)]
    for row, above in zip(levels[-2::-1], levels[:0:-1]):
        down = []
        for i, (p, q) in enumerate(chosen):
            if 2 * i + 1 == len(row):
                down.append((p, q))
                continue
            x, y, want = row[2 * i], row[2 * i + 1], above[i][AT[p, q]]
            r = next(r for r in range(4) if (p, r) in AT and (r, q) in AT and x[AT[p, r]] and y[AT[r, q]]
                     and (x[AT[p, r]][0] + y[AT[r, q]][0], x[AT[p, r]][1] + y[AT[r, q]][1]) == want)
            down += [(p, r), (r, q)]
        chosen = down
    return found, chosen


def damage(df: DataFrame) -> DataFrame:
    """Rows with role and text damaged by a rule on conversation and turn; null values count as one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                     F.pmod(F.crc32(name.cast("binary")), F.lit(20)).alias("k"))
    rows = rows.filter("k <> 0").withColumn("text", F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("k") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("k")).drop("k")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows in order, as ranges of about equal numbers: ``part`` numbers the ranges, ``at`` the rows; with what a row says of itself.

    ``late`` tells a row whose role and text an earlier turn has. Such groups are counted before they are joined.
    """
    rows = rows.withColumn("h", F.md5(F.col("text").cast("binary")))
    often = rows.groupBy("conv", "role", "h").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("null_first")).filter("n > 1")
    often = often.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"), "first", "null_first")
    rows = rows.join(often, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g")), "left")
    late = F.col("turn").isNotNull() & F.coalesce(F.col("null_first") | (F.col("turn") > F.col("first")), F.lit(False))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    rows = rows.select("conv", "turn", "role", "text", "h", late.alias("late"), F.substring("role", 1, 1).alias("initial"),
                       F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").alias("fault"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h").asc()]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return hold(ranges.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))


PIECE = "part int, first_at long, kinds string, blank long, duplicate long, truncated long, illegal long, head string, tail string"
GOOD = {"su", "ua", "au"}


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation in each range: what its rows are, in order, and counts."""
    names = ["conv", *(x.split()[0] for x in PIECE.split(", "))]
    out: list[dict] = []
    types: list[pa.DataType] = []
    before = None

    def table(pieces: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["".join(x[c]) if c == "kinds" else x[c] for x in pieces], t) for c, t in zip(names, types)], names)

    for batch in batches:
        types = [batch.column("conv").type, pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string()]
        for conv, part, at, turn, role, h, initial, late, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "at", "turn", "role", "h", "initial", "late", "fault"))):
            if not out or (conv, part) != (out[-1]["conv"], out[-1]["part"]):
                out.append({"conv": conv, "part": part, "first_at": at, "kinds": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": initial})
            else:
                out[-1]["illegal"] += out[-1]["tail"] + initial not in GOOD
            now = out[-1]
            now["tail"] = initial
            same = (conv, turn, role, h)
            again, before = late or same == before, same
            found = "blank" if fault == "blank" else "duplicate" if again else fault
            kind = "x" if found in ("blank", "duplicate") else initial if initial in ("s", "u", "a") else "o"
            now["kinds"].append(kind.upper() if found == "truncated" else kind)
            if found:
                now[found] += 1
        if len(out) > 1:
            yield table(out[:-1])
            del out[:-1]
    if out:
        yield table(out)


SUMMARY = ["cost", "audit", "blank", "duplicate", "truncated", "illegal"]


def parsed_rows(costs: Costs):
    """Pieces of each conversation, which come in order, to the edits of each; the first also has what holds for the conversation."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        conv_type = None

        def done() -> pa.RecordBatch:
            cells = [span(x["kinds"], costs) for x in held]
            (cost, audit), chosen = split(cells)
            inner = sum(x["illegal"] for x in held) + sum(x["tail"] + y["head"] not in GOOD for x, y in zip(held, held[1:]))
            whole = {"cost": cost, "audit": audit, "illegal": inner} | {k: sum(x[k] for x in held) for k in ("blank", "duplicate", "truncated")}
            columns = [pa.array([x["conv"] for x in held], conv_type), pa.array([x["part"] for x in held], pa.int32()), pa.array([x["first_at"] for x in held], pa.int64()),
                       pa.array([p for p, _ in chosen], pa.int32()), pa.array([c[AT[pq]][1] for c, pq in zip(cells, chosen)], pa.string())]
            columns += [pa.array([whole[k]] + [None] * (len(held) - 1), pa.string() if k == "audit" else pa.int64()) for k in SUMMARY]
            return pa.RecordBatch.from_arrays(columns, ["conv", "part", "first_at", "state", "edits", *SUMMARY])

        for batch in batches:
            conv_type = batch.column("conv").type
            ready = []
            for x in batch.to_pylist():
                if held and x["conv"] != held[0]["conv"]:
                    ready.append(done())
                    held.clear()
                held.append(x)
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
        if held:
            yield done()

    return rows


def parse(rows: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """The rows in order, and the edits of each conversation's pieces."""
    placed = in_order(rows)
    conv = f"conv {id_type(rows, 'conv')}"
    slim = placed.select("conv", "part", "at", "turn", "role", "h", "initial", "late", "fault").repartition("part").sortWithinPartitions("part", "at")
    pieces = slim.mapInArrow(piece_rows, f"{conv}, {PIECE}")
    pieces = pieces.repartition("conv").sortWithinPartitions("conv", "part")
    kinds = ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in SUMMARY)
    return placed, hold(pieces.mapInArrow(parsed_rows(costs), f"{conv}, part int, first_at long, state int, edits string, {kinds}"))


def edited_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's edits, then its rows in order, to the rows of the repaired conversation and the deleted ones; ``sub`` puts those of one ``at`` in order."""
    edits, place, state, count, last = "", 0, START, 0, None
    out: list[tuple] = []
    types: list[pa.DataType] = []

    def table() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["conv", "at", "sub", "turn", "role", "text", "edit"])
        out.clear()
        return made

    def put(conv, at, turn, role, text, edit) -> None:
        nonlocal count
        out.append((conv, at, count, turn, role, text, edit))
        count += 1

    def insert(conv, at) -> None:
        """Insertions up to the next row's edit."""
        nonlocal place, state
        while edits[place : place + 1] == "I":
            symbol = "a" if state == USER else "u"
            put(conv, at, None, NAMES[symbol], "", "I")
            place, state = place + 1, STEPS[state, symbol]

    for batch in batches:
        types = [batch.column("conv").type, pa.int64(), pa.int64(), batch.column("turn").type, pa.string(), pa.string(), pa.string()]
        for conv, at, is_row, start, own, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "is_row", "state", "edits", "turn", "role", "text"))):
            if not is_row:
                if last:
                    insert(*last)
                edits, place, state, last = own, 0, start, (conv, at)
                continue
            last = (conv, at)
            insert(conv, at)
            edit, place = edits[place], place + 1
            if edit == "R":
                role = NAMES["a" if state == USER else "u"]
            if edit != "D":
                state = STEPS[state, role[:1]]
            put(conv, at, turn, role, text, edit)
        if out:
            yield table()
    if last:
        insert(*last)
    if out:
        yield table()


def edited(placed: DataFrame, parsed: DataFrame) -> DataFrame:
    """``conv``, ``at``, ``sub`` (the order), ``turn``, ``role``, ``text``, ``edit``: a piece's edits meet its rows in the range that they come from."""
    kind = placed.schema["turn"].dataType
    heads = parsed.select("conv", "part", F.col("first_at").alias("at"), F.lit(False).alias("is_row"), "state", "edits",
                          F.lit(None).cast(kind).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = placed.select("conv", "part", "at", F.lit(True).alias("is_row"), F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("edits"),
                         "turn", "role", "text")
    both = heads.unionByName(rows).repartition("part").sortWithinPartitions("part", "at", "is_row")
    return both.mapInArrow(edited_rows, f"conv {id_type(placed, 'conv')}, at long, sub long, turn {kind.simpleString()}, role string, text string, edit string")


def named(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"))


def repair(df: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: ``conv``, ``at``, ``sub`` (their order), ``turn`` (null: inserted), ``role``, ``text``, ``edit`` (K, R or I)."""
    placed, parsed = parse(named(df, conv_col, turn_col, role_col, text_col), costs)
    return edited(placed, parsed).filter("edit <> 'D'")


def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, which come in order; only the running hash is kept."""
    names: list = []
    hashes: list[str] = []
    running, kind = None, None

    def table() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(hashes, pa.string())], ["conv", "repaired_sha256"])
        names.clear()
        hashes.clear()
        return made

    now = None
    for batch in batches:
        kind = batch.column("conv").type
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
            if running is None or conv != now:
                if running is not None:
                    names.append(now)
                    hashes.append(running.hexdigest())
                running, now = hashlib.sha256(), conv
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        if names:
            yield table()
    if running is not None:
        names.append(now)
        hashes.append(running.hexdigest())
        yield table()


def report(df: DataFrame, costs: Costs = Costs(), every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Per conversation ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Rows come by turn, nulls first, rows of one turn by role and the MD5 of the text. A row counts with its first fault: blank text, role and text of an
    earlier row, or text whose last mark isn't a full stop, exclamation or question mark. Blank and duplicate rows must go. The audit has one letter per
    edit (keep, rerole, delete, insert) in order; of equally cheap ones, the least by code points. Rows equal in everything are duplicates of the
    first. Null roles and texts are one space; a null conversation is one conversation. ``every`` (default ``df``) names the conversations to
    report; one without rows has zeros, an empty audit and the hash of the empty string. An empty table gives no rows.
    """
    rows = named(df, conv_col, turn_col, role_col, text_col)
    placed, parsed = parse(rows, costs)
    hashes = edited(placed, parsed).filter("edit <> 'D'").select("conv", "at", "sub", "role", "text").repartition("conv").sortWithinPartitions("conv", "at", "sub")
    hashes = hashes.mapInArrow(hash_rows, f"conv {id_type(rows, 'conv')}, repaired_sha256 string")
    turns = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    out = (every if every is not None else df).select(F.col(f"`{conv_col}`").alias("conv")).distinct()
    whole = parsed.filter("audit is not null").select("conv", *SUMMARY)
    for more in (turns, whole, hashes):
        more = more.withColumnRenamed("conv", "c")
        out = out.join(more, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    zero = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))

"""Mixing, hard negatives and conversation repair against brute force, with their edge cases."""

import hashlib
import math
import random
import zlib
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bundlelens.llm import conversation_repair as cr
from bundlelens.llm import hard_negatives, mixing, quality_rules
from bundlelens.llm import queries as Q
from bundlelens.llm.oracles import SQL
from bundlelens.llm.tokens import Encoder

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
EXTRA = ", id int, row int, t int, s int, k int, c int, conv int, at int, part int, goals int, data int, g int"
N_EXTRA = EXTRA.count(",")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def words(text):
    return len((text or "").encode().split())


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing what is above the limits, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, rest = total - sum(most * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        goal = {s: most * sizes[s] if s in capped else left * weight[s] / rest for s in names}
        above = {s for s in names if goal[s] > most * sizes[s]}
        if not above:
            return goal
        capped |= above


def test_targets(spark):
    r = random.Random(3)
    for _ in range(6):
        sizes = {f"s{i}é" if i % 5 else ("Z" * i or None): r.choice([0, 1, 5, 1000, r.randint(1, 10**6)]) for i in range(r.randint(1, 40))}
        out = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
        found = {x.source: x.target for x in out.collect()}
        wanted = water(sizes)
        assert found.keys() == wanted.keys()
        assert all(math.isclose(found[s], wanted[s], rel_tol=1e-12) and found[s] <= 3 * sizes[s] for s in sizes)


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randint(1, 300) for _ in range(r.choice([0, 3, 40, 400]))), r.choice(["a", "b", "b", "b", None])) for i in range(600)]
    rows += [(None, None, None), (None, "one two", None), (1, "one  two\x0b", "a"), (1, None, "empty"), (2, "\n \t", "empty")] + [(7, "again and again", "rep")] * 400
    rows += [(8, "x " * 5000, "long")]
    df = spark.createDataFrame([(*x, *[1] * N_EXTRA) for x in rows], "doc_id long, text string, source string" + EXTRA)
    plan = mixing.plan(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    goal = water(sizes)
    assert len(plan) == len(rows)
    assert sorted(map(repr, ((x.id, x.source, x.size) for x in plan))) == sorted(map(repr, ((i, s, words(t)) for i, t, s in rows)))
    for x in plan:
        assert x.source_size == sizes[x.source] and math.isclose(x.target, goal[x.source], rel_tol=1e-12) and x.taken == x.size * x.copies
        rate = x.target / x.source_size if x.source_size else 0
        assert math.floor(rate) <= x.copies <= math.ceil(rate) <= 3
    # Repeated rows are drawn one by one.
    again = [x.copies for x in plan if x.source == "rep"]
    rate = goal["rep"] / sizes["rep"]
    assert len(again) == 400 and abs(sum(again) - 400 * rate) <= 5 * math.sqrt(400 * rate % 1 * (1 - rate % 1)) + 60 * (rate % 1 > 0)
    reran = mixing.plan(df.repartition(5)).collect()
    assert sorted(map(repr, reran)) == sorted(map(repr, plan))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    want = {}
    for x in plan:
        want[x.id, x.source, x.t] = want.get((x.id, x.source, x.t), 0) + x.copies
    got = {}
    for x in mixed.collect():
        key = (x.doc_id, x.source, hashlib.md5((x.text or "").encode()).hexdigest())
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.plan(spark.createDataFrame([], schema)).collect() == []
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)
    assert [x.taken for x in mixing.plan(empty).collect()] == [0, 0] and mixing.mix(empty).collect() == []


def plain_negatives(rows):
    """rows: (id, label, vector), all usable; every row is one of its own."""
    v = [(i, label, [math.floor(256 * float(x)) for x in vec]) for i, label, vec in rows]
    out = []
    for a, (aid, alabel, avec) in enumerate(v):
        if aid % 50:
            continue
        found = sorted((-sum(p * q for p, q in zip(avec, vec)), i, label, b) for b, (i, label, vec) in enumerate(v))
        for score, pid, _, _ in [x for x in found if x[2] == alabel and x[3] != a][:5]:
            near = [(i, -s) for s, i, label, _ in found if label != alabel and -50 * score <= -100 * s <= -95 * score][:3]
            out += [(aid, pid, n + 1, i, -score, s) for n, (i, s) in enumerate(near)]
    return sorted(out, key=repr)


NEGATIVES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def relabelled(rows):
    return [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]


def test_negatives_of_the_table(spark):
    rows = [(x.vec_id, x.label, x.embedding) for x in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    assert rows_of(Q.op12(spark, SF01), *NEGATIVES) == plain_negatives(relabelled(rows))


@pytest.mark.parametrize("size, spread, blocks", [(3, 1, (2, 5)), (8, 900, (1000, 1000)), (21, 60000, (3, 40))])
def test_negatives(spark, size, spread, blocks):
    r = random.Random(size)
    rows = [(r.randint(0, 120) * (1 if k % 3 else 25), r.randint(0, 2), [r.choice([r.uniform(-spread, spread), 0.0, -1.0, 0.5]) for _ in range(size)]) for k in range(250)]
    rows += rows[:30] + [(50, 1, rows[0][2])] * 3
    bad = [(50, None, [1.0] * size), (100, 1, None), (150, 1, [None] * size), (0, 1, [float("nan")] * size), (0, 2, [float("inf")] + [0.0] * (size - 1)), (None, 1, [1.0] * size)]
    df = spark.createDataFrame([(*x, *[1] * N_EXTRA) for x in rows + bad], "vec_id long, label int, embedding array<double>" + EXTRA)
    out = hard_negatives.mine(df, F.col("id") % 50 == 0, anchor_block=blocks[0], row_block=blocks[1])
    assert rows_of(out, *NEGATIVES) == plain_negatives(rows)


def test_negatives_edges(spark):
    schema = "vec_id long, label int, embedding array<float>"
    mine = lambda rows: hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("id") % 50 == 0).collect()
    assert mine([]) == [] and mine([(1, 1, [1.0])]) == [] and mine([(0, 1, [1.0]), (1, 2, [0.7])]) == []
    # Missing components count as 0; an empty vector scores 0 with all.
    assert [tuple(x) for x in mine([(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [1.5]), (3, 3, [])])] == [(0, 1, 1, 2, 131072, 98304)]
    with pytest.raises(ValueError):
        mine([(0, 1, [1e9]), (1, 1, [1e9])])


def test_subset_sums_and_planes():
    r = np.random.default_rng(1)
    for low, high in ((-300, 300), (0, 1), (-1, 0), (-128, 127)):
        v, w = r.integers(low, high + 1, (40, 24)), r.integers(low, high + 1, (9, 24))
        bits = int(max(v.max(), -v.min() - 1)).bit_length() + 1
        assert (hard_negatives.scores(hard_negatives.subset_sums(w), hard_negatives.planes(v, bits)) == v @ w.T).all()


def plain_repairs(rows, gap=3):
    """(cost, audit, repaired rows) of ordered (role, text) rows by trying all edits that aren't dearer than deleting everything."""
    fault = faults(rows)
    best = (4 * len(rows), "D" * len(rows), [])
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def go(i, cost, audit, out):
        nonlocal best
        if cost > best[0]:
            return
        state = out[-1][0][:1] if out else ""
        if i == len(rows) and state in ("", "a"):
            best = min(best, (cost, audit, out), key=lambda x: x[:2])
        for name in ("user", "assistant"):
            if name[0] in after[state] and not audit.endswith("I" * gap):
                go(i, cost + 3, audit + "I", out + [(name, "")])
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, cost + 4, audit + "D", out)
            if fault[i] in (None, "truncated"):
                more = 3 * (fault[i] is not None)
                if role[:1] and role[0] in after[state]:
                    go(i + 1, cost + more, audit + "K", out + [(role, text)])
                for name in ("user", "assistant"):
                    if name[0] in after[state]:
                        go(i + 1, cost + more + 3, audit + "R", out + [(name, text)])

    go(0, 0, "", [])
    return best


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        solid = text.strip(cr.BLANKS)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else text.replace(".", "").replace("!", "").replace("?", "") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain_report(rows, every):
    out = []
    for conv in {x[0] for x in every}:
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), hashlib.md5(x[3].encode()).hexdigest()))
        pairs = [x[2:] for x in own]
        turns = [x[1] for x in own if x[1] is not None]
        cost, audit, fixed = plain_repairs(pairs)
        fault = faults(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_of_the_table(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF01}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(Q.op13(spark, SF01), "conv_id", *REPORT) == plain_report(plain_damage(rows), rows)


def edge_conversations():
    r = random.Random(9)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", "S", None], ["Hi.", "Hi.", "what", "no!", " ", "", None, "x?\n ", ".", "Done. ", "é"]
    rows = [(c, r.choice([None, *range(6)]) if c % 3 == 0 else k, r.choice(roles), r.choice(texts)) for c in range(60) for k in range(r.randint(1, 6))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "No."), (None, 1, "user", "Hi."), (-5, None, None, None), (700, 3, "user", "long " * 40_000 + "."), (700, 9, "assistant", "ok.")]
    return rows + rows[:20]


def test_repair(spark):
    rows = edge_conversations()
    df = spark.createDataFrame([(*x, *[1] * N_EXTRA) for x in rows], "conv_id long, turn long, role string, text string" + EXTRA)
    got = rows_of(cr.report(cr.damage(df), every=df), "conv", *REPORT)
    assert got == plain_report(plain_damage(rows), rows)
    spaced = [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]
    assert rows_of(cr.report(df), "conv", *REPORT) == plain_report(spaced, rows)
    fixed = cr.repair(df).collect()
    for conv in {x.conv for x in fixed}:
        initials = "".join(x.role[:1] for x in sorted((x for x in fixed if x.conv == conv), key=lambda x: (x.at, x.sub)))
        assert initials.replace("ua", "") in ("", "s") and initials != "s"


def test_repair_in_ranges(spark):
    """One conversation far longer than a range of rows gets what one parse of all its rows gives."""
    r = random.Random(2)
    rows = [(1, k, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "cut", f"{k} is it.", "", f"{k}"])) for k in range(1500)] + [(2, 1, "user", "A."), (2, 2, "assistant", "B.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, parsed = cr.parse(cr.named(df, "conv_id", "turn", "role", "text"))
        assert parsed.filter("conv = 1").count() > 1
        (one,) = [x for x in cr.report(df).collect() if x.conv == 1]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pairs = [x[2:] for x in rows if x[0] == 1]
    fault = faults(pairs)
    kinds = "".join("x" if f in ("blank", "duplicate") else role[0].upper() if f else role[0] for (role, _), f in zip(pairs, fault))
    cell, _ = cr.best(cr.span(kinds, cr.Costs()))
    assert (one.cost, one.audit) == cell and one.duplicate == fault.count("duplicate") and one.truncated == fault.count("truncated")
    assert one.illegal == sum(a[0][0] + b[0][0] not in cr.GOOD for a, b in zip(pairs, pairs[1:]))


def test_repair_of_nothing(spark):
    assert cr.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_cells_against_all_edits():
    for n in range(4):
        for kinds in product("suaoUx", repeat=n):
            rows = [({"s": "system", "u": "user", "a": "assistant", "o": "tool", "U": "user", "x": "user"}[k], "" if k == "x" else f"t{i}" + ("" if k == "U" else "."))
                    for i, k in enumerate(kinds)]
            assert cr.best(cr.span("".join(kinds), cr.Costs()))[0] == plain_repairs(rows)[:2]


@pytest.mark.parametrize("key, table, cols", [("op11_mixing", "documents", ["doc_id", "size", "source_size", "target", "taken", "source", "copies"]),
                                              ("op12_hard_negatives", "embeddings", NEGATIVES),
                                              ("op3_quality_rules", "documents", ["doc_id", *quality_rules.COUNTS, "n_line_words", "base_failed", "kept"])])
def test_query_against_sql(spark, key, table, cols):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{SF01}/{table}.parquet')")
    out = con.execute(SQL[key])
    names = [c[0] for c in out.description]
    df = Q.queries()[key](spark, SF01)
    assert sorted(names) == sorted(df.columns) == sorted(cols)
    assert rows_of(df, *cols) == sorted((tuple(row[names.index(c)] for c in cols) for row in out.fetchall()), key=repr)


@pytest.mark.parametrize("limit", [0, 5, 700_000])
def test_a_full_word_cache_changes_nothing(limit):
    r = random.Random(6)
    texts = [" ".join(r.choice(["Word", "word.", "é", "12,5", "don't", f"x{r.randint(0, 99)}"]) for _ in range(r.randint(0, 30))) for _ in range(60)]
    enc = Encoder(Q.TOKENIZER, limit)
    assert list(enc.encode([t.encode() for t in texts])) == enc.ids(texts) and len(enc.known) <= limit

"""Operators whose result is fixed by a rule, against brute force."""

import brute
import pytest
from pyspark.sql import functions as F

from bundlelens.llm import queries as Q
from bundlelens.llm import packing, quality_rules, substring, suffix_array, superminhash, token_store
from bundlelens.llm.tokens import Encoder
from cases import documents, tricky  # noqa: F401

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def table_rows(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


OP1 = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
OP2 = ["doc_id", "n_words", "n_removed", "kept_sha256"]
OP3 = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
OP6 = ["doc_id", "n_shingles", "component_id", "kept"]
OP10 = ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("query, cols, plain", [(Q.op1, OP1, brute.op1), (Q.op2, OP2, brute.op2), (Q.op3, OP3, brute.op3), (Q.op6, OP6, brute.op6),
                                                (Q.op10, OP10, lambda rows: brute.op10(rows, Q.TOKENIZER))])
def test_query(spark, query, cols, plain):
    rows = table_rows(spark, SF001)
    assert rows_of(query(spark, SF001), *cols) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("query, cols, plain", [(Q.op2, OP2, brute.op2), (Q.op6, OP6, brute.op6)])
def test_query_larger(spark, query, cols, plain):
    assert rows_of(query(spark, SF01), *cols) == sorted(plain(table_rows(spark, SF01)), key=repr)


@pytest.mark.parametrize("max_group", [1, 3, 50_000])
@pytest.mark.parametrize("length, reach", [(40, 25), (20, 1), (400, 255)])
def test_bytes(documents, tricky, length, reach, max_group):
    rows = tricky * 2 if length == 40 else tricky
    out = suffix_array.remove_repeats(documents(rows), length, reach, max_group)
    assert rows_of(out, "id", *OP1[1:]) == sorted(brute.op1(rows, length), key=repr)


@pytest.mark.parametrize("max_group", [1, 3, 50_000])
@pytest.mark.parametrize("length", [8, 9, 12, 35])
def test_words(documents, tricky, length, max_group):
    rows = tricky * 2 if length == 12 else tricky
    out = substring.remove_repeats(documents(rows), length, None, max_group)
    assert rows_of(out, "id", *OP2[1:]) == sorted(brute.op2(rows, length), key=repr)


def test_counts(documents, tricky):
    assert rows_of(quality_rules.judge(documents(tricky)), "id", *OP3[1:]) == sorted(brute.op3(tricky), key=repr)


def test_near(documents, tricky):
    assert rows_of(superminhash.near_duplicates(documents(tricky), block=2), "id", *OP6[1:]) == sorted(brute.op6(tricky), key=repr)


def test_near_chain(documents):
    """Members that the hub isn't linked with still find each other."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(30):
        own = list(words)
        for j in range(k):
            own[(j * 7) % 120] = f"v{j}"
        rows.append((k, " ".join(own)))
        rows.append((100 + k, " ".join(own[:-1])))
    assert rows_of(superminhash.near_duplicates(documents(rows), block=3), "id", *OP6[1:]) == sorted(brute.op6(rows), key=repr)


def test_same_ids_twice(documents, tricky):
    rows = tricky + tricky[10:16] + [(None, "one text without an id here"), (None, None)]
    out = rows_of(superminhash.near_duplicates(documents(rows)), "id", "component_id")
    assert len(out) == len(rows) and (None, None) in out
    kept = superminhash.deduplicate(documents(rows), 4)
    assert kept.columns == documents(rows).columns
    assert len(kept.filter("doc_id = 10").collect()) == 1 and kept.filter("doc_id = 11").isEmpty()


def test_tokens_equal_the_library(tricky):
    ids, _ = brute.encode(tricky, Q.TOKENIZER, 0)
    import numpy as np

    own = [np.frombuffer(x, "<u4").tolist() + [0] for x in Encoder(Q.TOKENIZER, limit=10).encode([(t or "").encode() for _, t in tricky])]
    assert own == ids


def check_packing(out, rows, size):
    ids, crc = brute.encode(rows, Q.TOKENIZER, 0)
    pieces = {(i, k): (k * size, len(x[k * size : (k + 1) * size]), crc(x[k * size : (k + 1) * size])) for (i, _), x in zip(rows, ids) for k in range(-(-len(x) // size))}
    got = out.collect()
    assert {(r.id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(bins), sum(p[1] for p in pieces.values())


def test_packing(documents, tricky, spark):
    for size, bins, per in ((16, 2, 1000), (64, 100, 7)):
        check_packing(packing.pack(documents(tricky), Q.TOKENIZER, size, open_bins=bins, per_task=per), tricky, size)
    rows = table_rows(spark, SF001)
    n, total = check_packing(packing.pack(spark.read.parquet(f"{SF001}/documents.parquet"), Q.TOKENIZER), rows, 2048)
    assert n <= -(-total // 2048) + 2


def test_bins_against_a_search():
    import random

    r = random.Random(1)
    bins, open_, n = packing.OpenBins(50, 4, 0), {}, 0
    for _ in range(3000):
        length = r.randint(1, 50)
        fitting = [free for free in open_.values() if free >= length]
        at, offset = bins.put(length)
        if fitting:
            assert open_[at] == min(fitting) and offset == 50 - open_[at]
        else:
            if len(open_) == 4:
                del open_[min(open_, key=lambda b: (open_[b], b not in {x for s in bins.bins.values() for x in s} and -1))]
            assert offset == 0
            n += 1
            open_[at] = 50
        open_[at] -= length
        open_ = {b: f for b, f in open_.items() if f and any(b in s for s in bins.bins.values())}
        assert len(open_) <= 4


def test_store(documents, tricky, spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(documents(tricky), path, Q.TOKENIZER, block_docs=4)
    store = token_store.read_store(spark, path)
    assert rows_of(token_store.checksums(store), "id", *OP10[1:]) == sorted(brute.op10([(i, t or "") for i, t in tricky], Q.TOKENIZER), key=repr)
    found = token_store.read_document(spark, path, 24)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(least,24)" in plan and "GreaterThanOrEqual(greatest,24)" in plan
    one = found.collect()
    assert [bytes(r["ids"]) for r in one] == [bytes(r["ids"]) for r in store.filter("id = 24").collect()]


def test_store_is_read_by_one_python_step(documents, spark, tmp_path):
    """A second step in the same task would keep a second Python worker per core, each of which later fills its own word cache."""
    path = str(tmp_path / "store")
    token_store.write_store(documents([(1, "a b"), (2, None)]), path, Q.TOKENIZER)
    plan = token_store.checksums(token_store.read_store(spark, path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_empty(documents, spark, tmp_path):
    none = documents([(1, "x")]).filter("doc_id = 2")
    path = str(tmp_path / "none")
    token_store.write_store(none, path, Q.TOKENIZER)
    for out in (suffix_array.remove_repeats(none), substring.remove_repeats(none), quality_rules.judge(none), quality_rules.clean(none),
                superminhash.near_duplicates(none), superminhash.deduplicate(none), packing.pack(none, Q.TOKENIZER), token_store.read_store(spark, path)):
        assert out.isEmpty()

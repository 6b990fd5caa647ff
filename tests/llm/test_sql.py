"""The SQL of the corpus queries against brute force, and the queries against their SQL."""

import brute
import duckdb
import pytest

from bundlelens.llm import queries as Q
from bundlelens.llm.oracles import SQL

SF001 = "/root/testdata/sf0.001"
COLUMNS = {"op2_substring": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op6_superminhash": ["doc_id", "n_shingles", "component_id", "kept"]}
PLAIN = {"op2_substring": brute.op2, "op6_superminhash": brute.op6}


def answer(key, source, parameters=()):
    con = duckdb.connect()
    con.execute(f"create table documents as {source}")
    if parameters:
        con.executemany("insert into documents values (?, ?)", parameters)
    out = con.execute(SQL[key])
    names = [c[0] for c in out.description]
    return sorted((tuple(row[names.index(c)] for c in COLUMNS[key]) for row in out.fetchall()), key=repr)


@pytest.mark.parametrize("key", PLAIN)
def test_sql_on_edge_rows(key):
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(1, long), (2, long + " end"), (3, "x " + long[:300]), (4, None), (5, ""), (6, "Two words"), (7, "two WORDS"), (8, "É é\t\n\x0b a"), (9, long)]
    assert answer(key, "select null::bigint as doc_id, null::varchar as text where false", rows) == sorted(PLAIN[key](rows), key=repr)


@pytest.mark.parametrize("key", PLAIN)
def test_query_against_sql(spark, key):
    out = Q.queries()[key](spark, SF001)
    assert sorted(out.columns) == sorted(COLUMNS[key])
    assert sorted((tuple(r[c] for c in COLUMNS[key]) for r in out.collect()), key=repr) == answer(key, f"select doc_id, text from read_parquet('{SF001}/documents.parquet')")

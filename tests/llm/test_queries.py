"""Registered queries against their SQL, and what the contracts fix of the others, over small tables."""

import zlib

import duckdb
import pytest

from lumenfold.llm.queries import ORACLE_SQL, QUERIES
from lumenfold.sources import TABLES

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(want)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_held_out_documents_of_languages_and_scores(spark, duck):
    ids = [i for (i,) in duck.execute("SELECT doc_id FROM documents").fetchall()]
    for name, modulus, left in (("op2_identify_language", 4, 2), ("op4_score_texts", 10, 0)):
        got = {r.doc_id: r for r in QUERIES[name](spark, SMALL).collect()}
        assert sorted(got) == sorted(ids)
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == left) for i, r in got.items())
    tokens = {r.train_tokens for r in got.values()}
    assert tokens == {sum(r.n_tokens for r in got.values() if not r.held_out)}


def test_conversations_carry_the_probe(spark, duck):
    got = {r.conv_id: r for r in QUERIES["op5_format_chats"](spark, SMALL).collect()}
    assert len(got) == duck.execute("SELECT count(DISTINCT conv_id) FROM conversations").fetchone()[0] + 1
    assert (got[-7].n_turns, got[-7].loss_chars) == (2, len("</s>[INST] ok [/INST]"))


def test_every_embedding_is_a_picture(spark, duck):
    got = [r.picture_id for r in QUERIES["op6_picture_copies"](spark, SMALL).collect()]
    ids = [i for (i,) in duck.execute("SELECT vec_id FROM embeddings").fetchall()]
    assert sorted(got) == sorted([*ids, *(-1 - i for i in ids if i % 20 == 0)])


def test_ranked_lines_equal_sql_by_value(spark, duck):
    """Whole numbers and nulls as they are; a pandas column of numbers with nulls would hold floats on one side only."""
    got, want = QUERIES["op12_rank_lines"](spark, SMALL), duck.execute(ORACLE_SQL["op12_rank_lines"])
    columns = sorted(got.columns)
    places = [[d[0] for d in want.description].index(c) for c in columns]
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])
    rows = order(tuple(r[c] for c in columns) for r in got.collect())
    assert rows and all(x is None or type(x) is int for r in rows for x in r)
    assert rows == order(tuple(r[i] for i in places) for r in want.fetchall())

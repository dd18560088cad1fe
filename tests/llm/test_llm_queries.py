"""Queries with SQL give DuckDB's rows on the smallest tables; the others keep their contract there."""

import os

import pytest

from vecloom.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
COLUMNS = {
    "op1_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op2_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3_packing": ["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "bin_size"],
    "op6_quality": ["doc_id", "held_out", "score", "predicted"],
    "op7_nearest": ["query_id", "rank", "vec_id", "score"],
    "op9_chat": ["conv_id", "turn", "part", "role", "n_chars", "rendered_sha256"],
}


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = got.collect()
    if name in ("op1_token_counts", "op2_pii", "op6_quality"):
        assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert rows


def test_roles_on_conversations_not_learned_from(spark):
    from vecloom.llm.chat import fit_roles, parse_transcripts
    from vecloom.llm.quality import fold_of

    rows = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")  # the smallest tables hold out ten turns
    held = fold_of(rows["conv_id"]) == 0
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in rows.where(held).collect()}
    got = parse_transcripts(spark, rows.where(held), fit_roles(rows.where(~held))).where("part = 0").collect()
    assert sum(truth[r["conv_id"], r["turn"]] == r["role"] for r in got) / len(truth) > 0.95

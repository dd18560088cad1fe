"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["knn_euclid_block", "knn_cosine_block", "distance_cross_block", "tensor_sum_dim1", "tensor_broadcast_sub", "tensor_reshape", "tensor_subset", "tensor_replace_lastwins", "gram_matmul", "sparse_normalize_rows", "sparse_matvec", "sparse_row_pointers", "sparse_knn", "covariance", "pca_total_variance", "pca_predict_fixed_rotation", "kmeans_iterations", "distance_self_cosine", "diffusion_normalized_kernel", "tensor_to_host", "tensor_transfer", "tensor_cast_float32", "sparse_to_host", "svd_reconstruction", "knn_graph_mutual_gaussian", "provenance_stages"]


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: repr(float(v) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_provenance_of_the_whole_table(spark, monkeypatch):
    from vecloom import queries

    seen, knn = [], queries.neighbors.knn
    monkeypatch.setattr(queries.neighbors, "knn", lambda spark, x, *a, **b: seen.append(x.count()) or knn(spark, x, *a, **b))
    queries.QUERIES["provenance_stages"](spark, DATA).collect()
    assert seen == [spark.read.parquet(f"{DATA}/embeddings.parquet").count()]


def test_no_query_takes_a_part_of_its_table():
    for name, sql in entry.oracle_sql().items():
        assert not name.endswith("_whole") and " LIMIT " not in sql.upper(), name


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Transfers to the driver and back go in parts."""

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from vecloom import queries
from vecloom.operators.sparse import sparse
from vecloom.operators.tensor import tensor


@pytest.fixture
def parts_only(spark, monkeypatch):
    """No frame is collected whole, and three rows travel at once."""

    def refuse(self):
        raise AssertionError("collected whole")

    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    monkeypatch.setattr(queries, "CHUNK_ROWS", 3)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, x, *a, **b: made.append(len(x)) or create(self, x, *a, **b))
    return made


def test_tensors_come_in_parts(spark, parts_only, tmp_path):
    x = np.random.default_rng(1).normal(size=(7, 64))
    t = tensor(spark, np.where(x > 2, np.nan, x))
    assert np.array_equal(t.to_numpy(), np.where(x > 2, np.nan, x), equal_nan=True)
    assert t.cast("float32").to_numpy().dtype == np.float32
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    parts_only.clear()
    got = queries.QUERIES["tensor_to_host"](spark, str(tmp_path)).orderBy("row_id").collect()
    assert parts_only == [1, 1, 1]
    assert np.allclose([r["s"] for r in got], x @ np.arange(1, 65), atol=1e-6) and [r["row_id"] for r in got] == list(range(1, 8))


def test_sparse_matrices_come_in_parts(spark, parts_only, tmp_path):
    x = np.array([[0.0, 0, 3, 0], [1, 0, 0, 0], [4, 0, 5, 0], [0, 0, 0, 2]])
    v, i, p = sparse(spark, x).to_csc()
    assert v.tolist() == [1, 4, 3, 5, 2] and i.tolist() == [1, 2, 0, 2, 3] and p.tolist() == [0, 2, 2, 4, 5]
    lines = [(int(a), int(b), float(x[a, b]) / 2) for a, b in zip(*np.nonzero(x)) for _ in range(2)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts_only.clear()
    got = queries.QUERIES["sparse_to_host"](spark, str(tmp_path)).collect()
    assert parts_only == [1, 1]
    assert sorted(map(tuple, got)) == sorted((b + 1, a + 1, x[a, b]) for a, b in zip(*np.nonzero(x)))
    assert not sparse(spark, np.zeros((2, 3))).to_csc()[2].any()


def test_dense_cells_are_not_joined(spark, monkeypatch):
    from vecloom.operators import sparse as module

    monkeypatch.setattr(module, "CELLS", 5)
    x = np.zeros((6, 7))
    x[1, 6], x[4, 0], x[4, 3], x[5, 2] = 1, 2, 3, 4
    t = sparse(spark, x).to_tensor()
    assert t.cells.count() == 42 and np.array_equal(t.to_numpy(), x)
    assert "explode" not in t.cells._jdf.queryExecution().toString()

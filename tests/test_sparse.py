import numpy as np
import pytest

from vecloom.operators.sparse import sparse

S = np.array([[1.0, 4, 2], [0, 0, 3], [3, 5, 0], [2, 1, 6]])


def test_round_trip(spark):
    x = np.zeros((4, 3))
    x[0, 1], x[2, 0], x[3, 2] = 2, 5, -1
    s = sparse(spark, x)
    assert s.info()["nnz"] == 3 and np.array_equal(s.to_numpy(), x) and np.array_equal(s.to_tensor().to_numpy(), x)
    assert s.as_csr().format == "csr" and np.array_equal(s.t().t().to_numpy(), x)


def test_triplets_are_summed(spark):
    t = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (2, 2, 0.0)], "i long, j long, v double")
    assert sparse(spark, t, (2, 2)).info()["nnz"] == 1
    assert sparse(spark, t, (2, 2), drop_zeros=False).info()["nnz"] == 2


def test_pointers(spark):
    at = lambda x: [r["end"] for r in sparse(spark, x).row_pointers().orderBy("i").collect()]
    assert at(np.eye(4)) == [1, 2, 3, 4] and at(np.zeros((3, 2))) == [0, 0, 0]


def test_products_and_sums(spark):
    x = np.zeros((4, 5))
    x[0, 2], x[1, 0], x[1, 4], x[3, 1] = 2, -1, 4, 7
    s, y = sparse(spark, x), np.arange(10.0).reshape(5, 2)
    assert np.allclose(s.matmul(y).to_numpy(), x @ y) and np.allclose(s.matvec(y[:, 0]).to_numpy(), x @ y[:, 0])
    assert np.allclose(s.row_sums().to_numpy(), x.sum(1)) and np.allclose(s.col_sums().to_numpy(), x.sum(0))
    with pytest.raises(ValueError, match="one value per column"):
        s.matvec([1.0])
    with pytest.raises(ValueError, match="not conformable"):
        s.matmul(np.ones((2, 2)))


def test_normalize(spark):
    s = sparse(spark, S)
    assert np.allclose(s.normalize("rows", 100).to_numpy(), S * 100 / S.sum(1, keepdims=True))
    assert np.allclose(s.normalize("columns", 10, True).to_numpy(), np.log1p(S * 10 / S.sum(0)))
    with pytest.raises(ValueError, match="non-negative"):
        sparse(spark, np.array([[1.0, 2], [-1, 3]])).normalize()
    with pytest.raises(ValueError, match="positive finite sum"):
        sparse(spark, np.array([[1.0, 0], [0, 0]])).normalize()
    with pytest.raises(ValueError, match="finite number above 0"):
        s.normalize("rows", 0)


def test_validation(spark):
    with pytest.raises(ValueError, match="finite, non-missing"):
        sparse(spark, np.array([[np.nan]]))
    with pytest.raises(ValueError, match="numeric"):
        sparse(spark, np.array([["a"]]))
    assert [r["j"] for r in sparse(spark, np.array([[2.0, 1], [2, 0]])).constant_columns().collect()] == [1]


def test_missing_parts_of_triplets_are_refused(spark):
    for row in ((2, 2, None), (None, 1, 1.0), (1, None, 1.0), (2, 2, float("nan"))):
        with pytest.raises(ValueError):
            sparse(spark, spark.createDataFrame([(1, 1, 1.0), (2, 2, 3.0), row], "i long, j long, v double"))

import numpy as np
import pytest

from vecloom.operators.tensor import block_matmul, broadcast_shape, promoted, tensor


def six(spark):
    return tensor(spark, np.array([[1, 3, 5], [2, 4, 6]]))


def test_reductions(spark):
    t = six(spark)
    assert t.dtype == "integer" and t.sum().to_numpy().tolist() == [21.0]
    assert t.mean(1).to_numpy().tolist() == [1.5, 3.5, 5.5]
    kept = t.sum(2, keepdim=True)
    assert kept.shape == (2, 1) and kept.to_numpy().ravel().tolist() == [9, 12]
    assert t.sum([]).dtype == "float64" and np.array_equal(t.sum([]).to_numpy(), t.to_numpy())
    with pytest.raises(ValueError, match="one-based"):
        t.sum(3)
    with pytest.raises(ValueError, match="keepdim"):
        t.sum(1, keepdim=1)


def test_sum_of_integers_is_float(spark):
    t = tensor(spark, np.array([2147483647, 1]))
    assert t.dtype == "integer" and t.sum().to_numpy()[0] == 2147483648.0 and t.sum().dtype == "float64"


def test_broadcast_and_arithmetic(spark):
    t = six(spark)
    assert tensor(spark, np.array([1, 2, 3])).broadcast_to((2, 3)).to_numpy().tolist() == [[1, 2, 3], [1, 2, 3]]
    assert (t * np.array([0.5, 1, 1.5])).to_numpy().tolist() == [[0.5, 3, 7.5], [1, 4, 9]]
    half = 0.5 + t
    assert half.dtype == "float64" and half.to_numpy()[0, 0] == 1.5
    column = tensor(spark, np.array([[10.0], [20.0]]))
    assert (column + tensor(spark, np.array([[1.0, 2.0, 3.0]]))).to_numpy().tolist() == [[11, 12, 13], [21, 22, 23]]
    with pytest.raises(ValueError, match="not compatible for broadcasting"):
        broadcast_shape((2, 3), (2,))
    with pytest.raises(ValueError, match="fewer dimensions"):
        t.broadcast_to((3,))
    assert promoted("integer", "integer") == "float64" and promoted("integer", "float32") == "float32"


def test_ieee_results(spark):
    got = (tensor(spark, np.array([1.0, 0.0, -1.0])) / np.array([0.0, 0.0, 0.0])).to_numpy()
    assert got[0] == np.inf and np.isnan(got[1]) and got[2] == -np.inf
    assert (tensor(spark, np.array([1.0])) ** float("nan")).to_numpy()[0] == 1.0
    assert not np.signbit((-tensor(spark, np.array([0.0]))).to_numpy()[0])
    assert np.isnan(tensor(spark, np.array([np.nan, 1.0])).sum().to_numpy()[0])


def test_matmul(spark):
    big = tensor(spark, np.array([[50000]]))
    assert (big @ big).to_numpy()[0, 0] == 2_500_000_000 and (big @ big).dtype == "float64"
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(7, 5)), rng.normal(size=(5, 9))
    for got in (tensor(spark, a) @ tensor(spark, b), block_matmul(spark, tensor(spark, a), tensor(spark, b), 3)):
        assert np.allclose(got.to_numpy(), a @ b, rtol=1e-12)
    with pytest.raises(ValueError, match="not conformable"):
        tensor(spark, a) @ tensor(spark, a)
    with pytest.raises(ValueError, match="inner dimension names"):
        tensor(spark, np.ones((1, 2)), dimnames=[None, "ab"]) @ tensor(spark, np.ones((2, 1)), dimnames=["ac", None])


def test_reshape_and_transpose(spark):
    t = tensor(spark, np.arange(1, 7)).reshape((2, 3))
    assert t.to_numpy().tolist() == [[1, 3, 5], [2, 4, 6]]
    assert t.t().shape == (3, 2) and np.array_equal(t.t().to_numpy(), t.to_numpy().T)
    with pytest.raises(ValueError, match="exactly"):
        t.reshape((4, 2))
    with pytest.raises(ValueError, match="positive whole-number"):
        t.reshape((0, 2))


def test_subset(spark):
    x = np.arange(1, 13).reshape(3, 4, order="F")
    t = tensor(spark, x, dimnames=["abc", None])
    assert np.array_equal(t.subset([3, 1], [2, 3, 4]).to_numpy(), x[[2, 0]][:, 1:4])
    assert t[None, 2].shape == (3,) and t[2, 3].to_numpy().tolist() == [x[1, 2]]
    assert np.array_equal(t.subset([-1], [True, False]).to_numpy(), x[1:, ::2])
    assert t.subset(["c", "a"], None).dimnames[0] == ("c", "a")
    assert t.subset([2, 5], drop=True).to_numpy().tolist() == [2, 5]
    assert t.subset([2], None, drop=False).shape == (1, 4)
    with pytest.raises(ValueError, match="pick no cell"):
        t.subset([], None)
    with pytest.raises(ValueError, match="out of bounds"):
        t.subset([4], None)


def test_replace(spark):
    t = tensor(spark, np.arange(1, 10).reshape(3, 3, order="F"))
    got = t.replace(([1, 1, 3], 2), np.array([10, 20, 30])).to_numpy()
    assert got[0, 1] == 20 and got[2, 1] == 30 and got[1, 1] == 5
    i = six(spark).replace((None, 2), np.array([20, 30])).replace((1, 1), 9)
    assert i.to_numpy().tolist() == [[9, 20, 5], [2, 30, 6]]
    with pytest.raises(ValueError, match="exactly as integer"):
        i.replace((1, 1), 0.5)
    with pytest.raises(ValueError, match="no multiple"):
        t.replace((None, 1), [1, 2])


def test_validation_and_metadata(spark):
    with pytest.raises(ValueError, match="non-empty numeric"):
        tensor(spark, np.array([]))
    with pytest.raises(ValueError, match="exactly as integer"):
        tensor(spark, np.array([0.5]), dtype="integer")
    with pytest.raises(TypeError, match="not supported"):
        six(spark) == six(spark)
    t = six(spark)
    assert len(t) == 6 and t.to_device("executors") is t and "2 x 3" in repr(t)
    assert tensor(spark, np.array([0.1]), dtype="float32").to_numpy()[0] == np.float32(0.1)
    with pytest.raises(ValueError, match="matrix"):
        tensor(spark, np.ones((2, 2, 2))).as_matrix()
    assert tensor(spark, np.array([1, 2])).as_matrix().shape == (2, 1)
    with pytest.raises(ValueError, match="incompatible"):
        tensor(spark, np.ones(2), dimnames=["ab"]) + tensor(spark, np.ones(2), dimnames=["ac"])

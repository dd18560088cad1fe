"""Dense tensors of any rank in coordinate form: one row (i1, ..., ir, v) for each cell, indices from 1.

Shape, element type and dimension labels are driver metadata; every cell is a row of a lazy
DataFrame, so a chain of elementwise operators is one projection. Missing values are NaN.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vector import ieee_divide, ieee_power
from vecloom.plans import provenance as prov
from vecloom.sources.tables import fetched

RANK = {"integer": 0, "float32": 1, "float64": 2}
MOST_PRINTED = 100
INT_MAX = 2**31 - 1


def _axes(rank: int) -> list[str]:
    return [f"i{k + 1}" for k in range(rank)]


def _valid_shape(shape) -> tuple[int, ...]:
    out = tuple(shape) if isinstance(shape, (list, tuple, np.ndarray)) else (shape,)
    if not out or any(isinstance(n, bool) or int(n) != n or n < 1 for n in out):
        raise ValueError("The shape must hold positive whole-number dimensions.")
    return tuple(int(n) for n in out)


def _check_labels(labels, shape):
    if labels is None:
        return None
    if len(labels) != len(shape) or any(x is not None and len(x) != n for x, n in zip(labels, shape)):
        raise ValueError("Each dimension's labels must be as many as its extent.")
    labels = tuple(None if x is None else tuple(map(str, x)) for x in labels)
    return labels if any(x is not None for x in labels) else None


def exact_integer(v: Column) -> Column:
    """Whether a number is a whole number of 32 bits."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= INT_MAX) & (F.floor(v) == v)


@dataclass
class Tensor:
    cells: DataFrame
    shape: tuple[int, ...]
    dtype: str = "float64"
    dimnames: tuple | None = None
    stages: dict[str, prov.Stage] = field(default_factory=lambda: {"tensor_materialization": prov.stage(backend="sql")})
    device: str = "executors"
    provenance_schema: str = prov.SCHEMA

    # Metadata

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def compute_device(self) -> str:
        return prov.compute_device(self.stages)

    def __len__(self) -> int:
        return math.prod(self.shape)

    def _with(self, cells: DataFrame, stage: str, shape=None, dtype=None, dimnames=None) -> Tensor:
        return Tensor(cells, shape or self.shape, dtype or self.dtype, dimnames, {stage: prov.stage(backend="sql", reason="resident", requested="inherited")}, self.device)

    def __repr__(self) -> str:
        head = f"<Tensor {' x '.join(map(str, self.shape))} {self.dtype} on {self.device}>"
        return f"{head}\n{self.to_numpy()}" if len(self) <= MOST_PRINTED else head

    # Transfer

    def to_numpy(self) -> np.ndarray:
        """All cells on the driver, in the tensor's shape."""
        kind = {"integer": np.int32, "float32": np.float32, "float64": np.float64}[self.dtype]
        flat = np.full(len(self), np.nan)
        for p, v in fetched(self.cells.select(self._linear().alias("p"), F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))).alias("v"))):
            flat[p] = v
        return flat.astype(kind, copy=False).reshape(self.shape, order="F")

    def as_matrix(self) -> np.ndarray:
        if self.rank > 2:
            raise ValueError("Only tensors with one or two dimensions can become a matrix.")
        x = self.to_numpy()
        return x[:, None] if self.rank == 1 else x

    def to_device(self, device: str) -> Tensor:
        """The same tensor, kept in executor memory ("executors") or computed anew when asked for ("driver")."""
        if device not in prov.PLACES:
            raise ValueError(f"`device` must be one of {', '.join(prov.PLACES)}.")
        if device == self.device:
            return self
        out = Tensor(self.cells.persist() if device == "executors" else self.cells, self.shape, self.dtype, self.dimnames, {**self.stages, "device_transfer": prov.stage(device, "sql", "explicit_request", device)}, device)
        return out

    def rows(self) -> DataFrame:
        """row_id, features of a matrix."""
        if self.rank != 2:
            raise ValueError("Only a matrix has rows.")
        return self.cells.groupBy(F.col("i1").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i2", "v"))), lambda x: x["v"]).alias("features"))

    def _linear(self) -> Column:
        """Position from 0 with the first index running fastest."""
        out, step = F.lit(0).cast("long"), 1
        for axis, n in zip(_axes(self.rank), self.shape):
            out = out + (F.col(axis) - 1) * step
            step *= n
        return out

    # Elements

    def cast(self, dtype: str) -> Tensor:
        if dtype not in RANK:
            raise ValueError("The element type must be integer, float32 or float64.")
        if dtype == self.dtype:
            return self
        v = F.col("v")
        if dtype == "integer":
            if not self.cells.where(~exact_integer(v)).isEmpty():
                raise ValueError("The values cannot be represented exactly as integer dtype.")
        if dtype == "float32":
            v = v.cast("float").cast("double")
        return self._with(self.cells.select(*_axes(self.rank), v.alias("v")), "cast", dtype=dtype, dimnames=self.dimnames)

    def broadcast_to(self, shape) -> Tensor:
        """Repeat along new leading axes and along axes of extent 1."""
        shape = _valid_shape(shape)
        lead = len(shape) - self.rank
        if lead < 0:
            raise ValueError("The target shape cannot have fewer dimensions than the tensor.")
        if any(n not in (1, m) for n, m in zip(self.shape, shape[lead:])):
            raise ValueError("The tensor's shape is not compatible with the target shape.")
        cells = self.cells.select(*[F.col(f"i{k + 1}").alias(f"i{k + 1 + lead}") for k in range(self.rank)], "v")
        for k, m in enumerate(shape):
            old = self.shape[k - lead] if k >= lead else None
            if old is None or old != m:
                cells = cells.drop(f"i{k + 1}").withColumn(f"i{k + 1}", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(m).cast("long"))))
        labels = None
        if self.dimnames:
            labels = _check_labels([None] * lead + [x if n == m else None for x, n, m in zip(self.dimnames, self.shape, shape[lead:])], shape)
        return self._with(cells.select(*_axes(len(shape)), "v"), "broadcast", shape=shape, dimnames=labels)

    def _binary(self, other, op: str, swapped: bool = False) -> Tensor:
        if not isinstance(other, Tensor):
            if isinstance(other, (int, float, np.integer, np.floating)) and not isinstance(other, bool):
                kind = "integer" if isinstance(other, (int, np.integer)) and abs(int(other)) <= INT_MAX else "float64"
                if op in ("+", "-", "*", "/", "^"):  # a scalar needs no join
                    x, y = F.col("v"), F.lit(float(other))
                    return self._arithmetic(self.cells, y if swapped else x, x if swapped else y, op, self.shape, self.dimnames, kind)
            other = tensor(self.cells.sparkSession, np.asarray(other))
        a, b = (other, self) if swapped else (self, other)
        shape = broadcast_shape(a.shape, b.shape)
        a_cells, b_cells = a.broadcast_to(shape), b.broadcast_to(shape)
        labels = _merged_labels(a_cells.dimnames, b_cells.dimnames, shape)
        # The smaller operand is joined on its own axes and so repeats without being expanded.
        lead_a, lead_b = len(shape) - a.rank, len(shape) - b.rank
        if a.shape == shape or b.shape == shape:
            big, small, lead = (a, b, lead_b) if a.shape == shape else (b, a, lead_a)
            keys = [k for k, n in enumerate(small.shape) if n != 1]
            right = small.cells.select(*[F.col(f"i{k + 1}").alias(f"i{k + 1 + lead}") for k in keys], F.col("v").alias("w"))
            both = big.cells.join(right, [f"i{k + 1 + lead}" for k in keys]) if keys else big.cells.crossJoin(F.broadcast(right.limit(1)))
            x, y = (F.col("v"), F.col("w")) if big is a else (F.col("w"), F.col("v"))
            return a._arithmetic(both, x, y, op, shape, labels, b.dtype)
        both = a_cells.cells.join(b_cells.cells.withColumnRenamed("v", "w"), _axes(len(shape)))
        return a._arithmetic(both, F.col("v"), F.col("w"), op, shape, labels, b.dtype)

    def _arithmetic(self, cells: DataFrame, x: Column, y: Column, op: str, shape, labels, other_dtype: str) -> Tensor:
        v = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: ieee_divide(x, y), "^": lambda: ieee_power(x, y)}[op]()
        return self._with(cells.select(*_axes(len(shape)), v.alias("v")), "arithmetic", shape=shape, dtype=promoted(self.dtype, other_dtype), dimnames=labels)

    def __add__(self, o):
        return self._binary(o, "+")

    def __radd__(self, o):
        return self._binary(o, "+", True)

    def __sub__(self, o):
        return self._binary(o, "-")

    def __rsub__(self, o):
        return self._binary(o, "-", True)

    def __mul__(self, o):
        return self._binary(o, "*")

    def __rmul__(self, o):
        return self._binary(o, "*", True)

    def __truediv__(self, o):
        return self._binary(o, "/")

    def __rtruediv__(self, o):
        return self._binary(o, "/", True)

    def __pow__(self, o):
        return self._binary(o, "^")

    def __rpow__(self, o):
        return self._binary(o, "^", True)

    def __neg__(self):
        """0 - x, so that the negative of 0 is +0."""
        return self._with(self.cells.select(*_axes(self.rank), (F.lit(0.0) - F.col("v")).alias("v")), "arithmetic", dtype=self.dtype, dimnames=self.dimnames)

    def __pos__(self):
        return self

    def _unsupported(self, *_):
        raise TypeError("This operator is not supported for tensor objects.")

    __eq__ = __ne__ = __lt__ = __le__ = __gt__ = __ge__ = __mod__ = __floordiv__ = __and__ = __or__ = __invert__ = _unsupported
    __hash__ = object.__hash__

    # Shape

    def reshape(self, shape) -> Tensor:
        """The same values in column-major order under another shape; labels go."""
        shape = _valid_shape(shape)
        if math.prod(shape) != len(self):
            raise ValueError(f"The new shape must hold exactly {len(self)} values.")
        p, step, out = F.col("p"), 1, []
        for k, n in enumerate(shape):
            out.append((F.pmod(F.floor(p / step) if step > 1 else p, F.lit(n)) + 1).cast("long").alias(f"i{k + 1}"))
            step *= n
        return self._with(self.cells.select(self._linear().alias("p"), "v").select(*out, "v"), "reshape", shape=shape)

    def t(self) -> Tensor:
        if self.rank != 2:
            raise ValueError("Only a tensor with two dimensions can be transposed.")
        labels = tuple(reversed(self.dimnames)) if self.dimnames else None
        return self._with(self.cells.select(F.col("i2").alias("i1"), F.col("i1").alias("i2"), "v"), "transpose", shape=self.shape[::-1], dimnames=labels)

    # Reductions

    def _reduced(self, how: str, dim, keepdim: bool) -> Tensor:
        if not isinstance(keepdim, bool):
            raise ValueError("`keepdim` is True or False.")
        dims = list(range(1, self.rank + 1)) if dim is None else [dim] if isinstance(dim, (int, np.integer)) else list(dim)
        if any(isinstance(d, bool) or int(d) != d or not 1 <= d <= self.rank for d in dims) or len(set(dims)) != len(dims):
            raise ValueError("`dim` must hold valid one-based tensor dimensions, each once.")
        if not dims:
            return self.cast("float64") if self.dtype == "integer" else self
        kept = [k for k in range(self.rank) if k + 1 not in dims]
        value = (F.sum if how == "sum" else F.avg)("v").alias("v")
        got = self.cells.groupBy(*[f"i{k + 1}" for k in kept]).agg(value)
        one = F.lit(1).cast("long")
        if keepdim:
            shape = tuple(1 if k + 1 in dims else n for k, n in enumerate(self.shape))
            axes = [F.col(f"i{k + 1}") if k in kept else one.alias(f"i{k + 1}") for k in range(self.rank)]
            labels = self.dimnames and _check_labels([x if k in kept else None for k, x in enumerate(self.dimnames)], shape)
        elif kept:
            shape = tuple(self.shape[k] for k in kept)
            axes = [F.col(f"i{k + 1}").alias(f"i{j + 1}") for j, k in enumerate(kept)]
            labels = self.dimnames and _check_labels([self.dimnames[k] for k in kept], shape)
        else:
            shape, axes, labels = (1,), [one.alias("i1")], None
        return self._with(got.select(*axes, "v"), how, shape=shape, dtype="float64" if self.dtype == "integer" else self.dtype, dimnames=labels)

    def sum(self, dim=None, keepdim: bool = False) -> Tensor:
        return self._reduced("sum", dim, keepdim)

    def mean(self, dim=None, keepdim: bool = False) -> Tensor:
        return self._reduced("mean", dim, keepdim)

    # Products

    def matmul(self, other: Tensor) -> Tensor:
        """Matrix product by a join on the inner index; partial sums are formed before the shuffle."""
        _check_product(self, other)
        left = self.cells.select(F.col("i1"), F.col("i2").alias("k"), F.col("v").alias("a"))
        right = other.cells.select(F.col("i1").alias("k"), F.col("i2"), F.col("v").alias("b"))
        cells = left.join(right, "k").groupBy("i1", "i2").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
        return self._with(cells, "matrix_multiply", shape=(self.shape[0], other.shape[1]), dtype=promoted(self.dtype, other.dtype), dimnames=_product_labels(self, other))

    __matmul__ = matmul

    # Selection

    def _plan(self, index, drop: bool) -> tuple[np.ndarray, list[np.ndarray], tuple[int, ...], tuple | None]:
        index = index if isinstance(index, tuple) else (index,)
        if len(index) == 1 and self.rank != 1:
            pick = _positions(index[0], len(self), None)
            return pick, [pick], (len(pick),), None
        if len(index) != self.rank:
            raise ValueError("incorrect number of dimensions")
        picks = [_positions(s, n, self.dimnames[k] if self.dimnames else None) for k, (s, n) in enumerate(zip(index, self.shape))]
        labels = [tuple(self.dimnames[k][p - 1] for p in pick) if self.dimnames and self.dimnames[k] else None for k, pick in enumerate(picks)]
        keep = [k for k, p in enumerate(picks) if not drop or len(p) != 1]
        shape = tuple(len(picks[k]) for k in keep) or (1,)
        names = [labels[k] for k in keep] if keep else None
        return np.zeros(0), picks, shape, _check_labels(names, shape) if names and min(shape) else None

    def subset(self, *index, drop: bool = True) -> Tensor:
        """R's subscripts: positive, negative, logical (recycled) and label vectors, None for all; one vector counts cells in column-major order."""
        if not isinstance(drop, bool):
            raise ValueError("`drop` is True or False.")
        _, picks, shape, labels = self._plan(index, drop)
        if any(len(p) == 0 for p in picks):
            raise ValueError("The subscripts pick no cell, and a tensor has at least one.")
        spark, one = self.cells.sparkSession, len(index) == 1 and self.rank != 1
        cells = self.cells.select(self._linear().alias("q") + 1, "v").toDF("i1", "v") if one else self.cells
        for k, pick in enumerate(picks):
            if not one and np.array_equal(pick, np.arange(1, self.shape[k] + 1)):
                continue
            axis = f"i{k + 1}"
            if len(pick) and np.array_equal(pick, np.arange(pick[0], pick[0] + len(pick))):  # a range is a filter that reaches the scan
                cells = cells.where(F.col(axis).between(int(pick[0]), int(pick[-1]))).withColumn(axis, F.col(axis) - int(pick[0] - 1))
                continue
            plan = _index_frame(spark, axis, pick)
            cells = cells.join(F.broadcast(plan) if len(pick) < 1_000_000 else plan, axis).drop(axis).withColumnRenamed("new", axis)
        kept = [0] if one else [k for k, p in enumerate(picks) if not drop or len(p) != 1]
        axes = [F.col(f"i{k + 1}").alias(f"i{j + 1}") for j, k in enumerate(kept)] or [F.lit(1).cast("long").alias("i1")]
        return self._with(cells.select(*axes, "v"), "subset", shape=shape, dimnames=labels)

    def __getitem__(self, index) -> Tensor:
        return self.subset(*(index if isinstance(index, tuple) else (index,)))

    def replace(self, index: tuple, value) -> Tensor:
        """A tensor with the selected cells replaced; values recycle, and of writes to one cell the last wins."""
        index = index if isinstance(index, tuple) else (index,)
        _, picks, shape, _ = self._plan(index, False)
        n = math.prod(len(p) for p in picks)
        values = value.to_numpy().ravel(order="F") if isinstance(value, Tensor) else np.asarray(value)
        if values.dtype.kind not in "iuf" or values.size == 0:
            raise ValueError("New values are numbers, at least one.")
        values = values.ravel(order="F").astype(float)
        if self.dtype == "integer" and not all(np.isfinite(x) and x == np.floor(x) and abs(x) <= INT_MAX for x in values):
            raise ValueError("`value` cannot be represented exactly as integer dtype.")
        if self.dtype == "float32":
            values = values.astype(np.float32).astype(float)
        if n % len(values):
            raise ValueError("The cells to replace are no multiple of the new values.")
        if n == 0:
            return self._with(self.cells, "replacement", dimnames=self.dimnames)
        spark = self.cells.sparkSession
        # Positions of the writes are a cross product of the picks, made on the executors.
        plan, step = None, 1
        for k, pick in enumerate(picks):
            part = _index_frame(spark, f"s{k}", pick).withColumn("at", (F.col("new") - 1) * step).drop("new")
            plan = part if plan is None else plan.withColumnRenamed("at", "at0").crossJoin(F.broadcast(part)).withColumn("at", F.col("at") + F.col("at0")).drop("at0")
            step *= len(pick)
        if len(picks) == 1 and self.rank != 1:
            cell = F.col("s0") - 1
        else:
            cell, step = F.lit(0).cast("long"), 1
            for k, n_k in enumerate(self.shape):
                cell = cell + (F.col(f"s{k}") - 1) * step
                step *= n_k
        writes = plan.select(cell.alias("p"), "at")
        last = writes.groupBy("p").agg(F.max("at").alias("at")).select("p", F.pmod("at", F.lit(len(values))).alias("r"))
        given = _index_frame(spark, "r1", np.arange(1, len(values) + 1), values).select((F.col("r1") - 1).alias("r"), F.col("val").alias("w"))
        new = last.join(F.broadcast(given), "r").select("p", F.lit(True).alias("hit"), "w")
        cells = self.cells.withColumn("p", self._linear()).join(new, "p", "left").select(*_axes(self.rank), F.when(F.col("hit"), F.col("w")).otherwise(F.col("v")).alias("v"))
        return self._with(cells, "replacement", dimnames=self.dimnames)


def _index_frame(spark: SparkSession, axis: str, pick: np.ndarray, values: np.ndarray | None = None) -> DataFrame:
    """axis, new (the place in the selection) and, with values, val."""
    import pandas as pd

    data = {axis: np.asarray(pick, np.int64), "new": np.arange(1, len(pick) + 1, dtype=np.int64)} | ({"val": values} if values is not None else {})
    schema = f"{axis} long, new long" + (", val double" if values is not None else "")
    return spark.createDataFrame(pd.DataFrame(data), schema)


def _positions(s, n: int, labels) -> np.ndarray:
    """One axis's subscript as positions from 1."""
    if s is None or (isinstance(s, slice) and s == slice(None)):
        return np.arange(1, n + 1)
    s = [s] if isinstance(s, (int, float, str, bool, np.integer, np.floating)) else list(s)
    if not s:
        return np.zeros(0, int)
    if any(x is None or (isinstance(x, float) and math.isnan(x)) for x in s):
        raise ValueError("Missing subscripts are not supported.")
    if all(isinstance(x, str) for x in s):
        if labels is None or any(x not in labels for x in s):
            raise ValueError("subscript out of bounds")
        return np.array([labels.index(x) + 1 for x in s])
    if all(isinstance(x, (bool, np.bool_)) for x in s):
        if len(s) > n:
            raise ValueError("(subscript) logical subscript too long")
        return np.flatnonzero(np.resize(np.array(s, bool), n)) + 1
    v = np.trunc(np.array(s, float)).astype(int)
    v = v[v != 0]
    if (v < 0).any():
        if (v > 0).any():
            raise ValueError("can't mix positive and negative subscripts")
        return np.setdiff1d(np.arange(1, n + 1), -v)
    if (v > n).any():
        raise ValueError("subscript out of bounds")
    return v


def promoted(a: str, b: str) -> str:
    """Element type of an arithmetic result: two integers give float64, else the wider."""
    return "float64" if a == b == "integer" else max(a, b, key=RANK.get)


def broadcast_shape(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    rank = max(len(a), len(b))
    a, b = (1,) * (rank - len(a)) + tuple(a), (1,) * (rank - len(b)) + tuple(b)
    if any(n != m and 1 not in (n, m) for n, m in zip(a, b)):
        raise ValueError("The tensor shapes are not compatible for broadcasting.")
    return tuple(map(max, a, b))


def _merged_labels(a, b, shape):
    if not a or not b:
        return a or b
    for x, y in zip(a, b):
        if x is not None and y is not None and x != y:
            raise ValueError("The dimension names are incompatible for arithmetic.")
    return _check_labels([x if x is not None else y for x, y in zip(a, b)], shape)


def _check_product(x, y) -> None:
    if len(x.shape) != 2 or len(y.shape) != 2:
        raise ValueError("The operands must both be two-dimensional.")
    if x.shape[1] != y.shape[0]:
        raise ValueError("The operands are not conformable for matrix multiplication.")
    inner = (x.dimnames[1] if x.dimnames else None, y.dimnames[0] if y.dimnames else None)
    if None not in inner and inner[0] != inner[1]:
        raise ValueError("The inner dimension names are incompatible.")


def _product_labels(x, y):
    return _check_labels([x.dimnames[0] if x.dimnames else None, y.dimnames[1] if y.dimnames else None], (x.shape[0], y.shape[1]))


def tensor(spark: SparkSession, x, dtype: str | None = None, dimnames=None) -> Tensor:
    """A tensor from an array, a matrix or a vector on the driver; or another element type of a tensor."""
    if isinstance(x, Tensor):
        return x.cast(dtype) if dtype else x
    x = np.asarray(x)
    if x.dtype.kind not in "iuf" or x.size == 0:
        raise ValueError("A tensor needs a non-empty numeric object.")
    x = x.reshape(1) if x.ndim == 0 else x
    kind = dtype or ("integer" if x.dtype.kind in "iu" and np.abs(x.astype(float)).max() <= INT_MAX else "float32" if x.dtype == np.float32 else "float64")
    if kind not in RANK:
        raise ValueError("The element type must be integer, float32 or float64.")
    flat = x.ravel(order="F").astype(float)
    if kind == "integer" and not (np.isfinite(flat) & (flat == np.floor(flat)) & (np.abs(flat) <= INT_MAX)).all():
        raise ValueError("The values cannot be represented exactly as integer dtype.")
    if kind == "float32":
        flat = flat.astype(np.float32).astype(float)
    import pandas as pd

    places = np.unravel_index(np.arange(x.size), x.shape, order="F")
    frame = pd.DataFrame({**{f"i{k + 1}": p.astype(np.int64) + 1 for k, p in enumerate(places)}, "v": flat})
    cells = spark.createDataFrame(frame, ", ".join(f"{a} long" for a in _axes(x.ndim)) + ", v double")
    if np.isnan(flat).any():  # pandas' missing values would come as nulls
        cells = cells.withColumn("v", F.coalesce("v", F.lit(float("nan"))))
    return Tensor(cells, x.shape, kind, _check_labels(dimnames, x.shape))


def tensor_of_rows(rows: DataFrame, n_rows: int, n_cols: int, dtype: str = "float64") -> Tensor:
    """A matrix from row_id (from 1) and features."""
    cells = rows.select(F.col("row_id").alias("i1"), F.posexplode("features").alias("p", "v")).select("i1", (F.col("p") + 1).cast("long").alias("i2"), F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))).alias("v"))
    return Tensor(cells, _valid_shape((n_rows, n_cols)), dtype)


def block_matmul(spark: SparkSession, x: Tensor, y: Tensor, block: int = 1024) -> Tensor:
    """Matrix product of large dense tensors by square blocks: NumPy products of block pairs, summed by block."""
    import pyarrow as pa

    _check_product(x, y)

    def blocks(t: Tensor, keys: tuple[str, str]) -> DataFrame:
        at = [F.floor((F.col(a) - 1) / block).alias(k) for a, k in zip(("i1", "i2"), keys)]
        within = [F.pmod(F.col(a) - 1, F.lit(block)).cast("int").alias(a) for a in ("i1", "i2")]
        return t.cells.select(*at, F.struct(*within, "v").alias("c")).groupBy(*keys).agg(F.collect_list("c").alias(f"c_{keys[0]}{keys[1]}"))

    pairs = blocks(x, ("bi", "bk")).join(blocks(y, ("bk", "bj")), "bk")
    n, k, m = x.shape[0], x.shape[1], y.shape[1]

    def dense(cells: pa.Scalar, rows: int, cols: int) -> np.ndarray:
        flat = cells.values.flatten()
        out = np.zeros((rows, cols))
        out[flat[0].to_numpy(), flat[1].to_numpy()] = flat[2].to_numpy()
        return out

    def multiply(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                bi, bk, bj = (batch.column(c)[r].as_py() for c in ("bi", "bk", "bj"))
                size = lambda total, b: min(block, total - b * block)
                product = dense(batch.column("c_bibk")[r], size(n, bi), size(k, bk)) @ dense(batch.column("c_bkbj")[r], size(k, bk), size(m, bj))
                i, j = np.indices(product.shape)
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel() + bi * block + 1), pa.array(j.ravel() + bj * block + 1), pa.array(product.ravel())], names=["i1", "i2", "v"])

    cells = pairs.select("bi", "bk", "bj", "c_bibk", "c_bkbj").mapInArrow(multiply, "i1 long, i2 long, v double").groupBy("i1", "i2").agg(F.sum("v").alias("v"))
    return Tensor(cells, (n, m), promoted(x.dtype, y.dtype), _product_labels(x, y), {"matrix_multiply": prov.stage(backend="block")})



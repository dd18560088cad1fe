"""Sparse matrices as unique triplets (i, j, v) with indices from 1, in COO or CSR form."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.operators.tensor import Tensor, _check_labels, _check_product, _product_labels, tensor
from vecloom.plans import provenance as prov
from vecloom.sources.tables import fetched

#: Cells of a batch that a row is filled into.
CELLS = 1 << 18


@dataclass
class Sparse:
    entries: DataFrame
    shape: tuple[int, int]
    dimnames: tuple | None = None
    format: str = "coo"
    stages: dict[str, prov.Stage] = field(default_factory=lambda: {"sparse_materialization": prov.stage(backend="sql")})
    provenance_schema: str = prov.SCHEMA

    @property
    def compute_device(self) -> str:
        return prov.compute_device(self.stages)

    def __repr__(self) -> str:
        return f"<Sparse {self.shape[0]} x {self.shape[1]}, {self.format}>"

    def _with(self, entries: DataFrame, stage: str, shape=None, dimnames=None) -> Sparse:
        return Sparse(entries, shape or self.shape, dimnames, self.format, {stage: prov.stage(backend="sql", reason="resident", requested="inherited")})

    def info(self) -> dict:
        """Shape, stored entries and their share of all cells."""
        n = self.entries.count()
        return {"shape": self.shape, "nnz": n, "density": n / (self.shape[0] * self.shape[1]), "format": self.format, "device": "executors"}

    def as_coo(self) -> Sparse:
        return self if self.format == "coo" else Sparse(self.entries, self.shape, self.dimnames, "coo", self.stages)

    def as_csr(self) -> Sparse:
        return self if self.format == "csr" else Sparse(self.entries, self.shape, self.dimnames, "csr", self.stages)

    def csr_rows(self) -> DataFrame:
        """i, cols, vals: each row that has entries, by column."""
        rows = self.entries.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("e"))
        return rows.select("i", F.col("e.j").alias("cols"), F.col("e.v").alias("vals"))

    def row_pointers(self) -> DataFrame:
        """i, start, end: zero-based CSR pointers of every row."""
        counts = self._counted("i", self.shape[0], F.count(F.lit(1)))
        # Rows are put into blocks so that the running sum is not one task's.
        size = 1 << 16
        placed = counts.withColumn("b", F.floor((F.col("i") - 1) / size))
        before = placed.groupBy("b").agg(F.sum("v").alias("n"))
        lead = before.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("b", "base")
        upto = F.sum("v").over(Window.partitionBy("b").orderBy("i"))
        return placed.withColumn("end", upto).join(lead, "b").select("i", (F.col("base") + F.col("end") - F.col("v")).cast("long").alias("start"), (F.col("base") + F.col("end")).cast("long").alias("end"))

    def to_csc(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, zero-based row indices and column pointers on the driver."""
        n, at = self.entries.count(), 0
        values, rows = np.empty(n), np.empty(n, np.int32 if self.shape[0] < 2**31 else np.int64)
        pointers = np.zeros(self.shape[1] + 1, np.int64)
        for j, i, v in fetched(self.entries.orderBy("j", "i").select("j", "i", "v")):
            values[at : at + len(v)], rows[at : at + len(v)] = v, i - 1
            found, counts = np.unique(j, return_counts=True)
            pointers[found] += counts
            at += len(v)
        return values, rows, np.cumsum(pointers, out=pointers)

    def to_numpy(self) -> np.ndarray:
        out = np.zeros(self.shape)
        v, i, p = self.to_csc()
        out[i, np.repeat(np.arange(self.shape[1]), np.diff(p))] = v
        return out

    def to_tensor(self) -> Tensor:
        """All cells, zeros too. Only entries are shuffled; each row's cells are filled in where the row is."""
        p = self.shape[1]
        every = self.entries.sparkSession.range(1, self.shape[0] + 1).withColumnRenamed("id", "i").join(self.csr_rows(), "i", "left")

        def fill(batches):
            for whole in batches:
                step = max(1, CELLS // p)
                for a in range(0, whole.num_rows, step):
                    batch = whole.slice(a, step)
                    n, cols = batch.num_rows, batch.column("cols")
                    i, out = batch.column("i").to_numpy(), np.zeros(batch.num_rows * p)
                    sizes = np.nan_to_num(cols.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
                    out[np.repeat(np.arange(n) * p, sizes) + cols.flatten().to_numpy(zero_copy_only=False) - 1] = batch.column("vals").flatten().to_numpy(zero_copy_only=False)
                    for b in range(0, n * p, CELLS):
                        at = np.arange(b, min(b + CELLS, n * p))
                        yield pa.RecordBatch.from_arrays([pa.array(i[at // p]), pa.array(at % p + 1), pa.array(out[b : b + CELLS])], names=["i1", "i2", "v"])

        return Tensor(every.mapInArrow(fill, "i1 long, i2 long, v double"), self.shape, "float64", self.dimnames, {"sparse_to_dense": prov.stage(backend="sql")})

    def t(self) -> Sparse:
        labels = tuple(reversed(self.dimnames)) if self.dimnames else None
        return self._with(self.entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), "sparse_transpose", self.shape[::-1], labels)

    def matmul(self, y) -> Tensor:
        """Product with a dense matrix; rows without entries give zeros."""
        spark = self.entries.sparkSession
        y = y if isinstance(y, Tensor) else tensor(spark, np.asarray(y, float))
        _check_product(self, y)
        if not y.cells.where(F.isnan("v") | (F.abs("v") == float("inf"))).isEmpty():
            raise ValueError("The dense operand must hold finite, non-missing values.")
        right = y.cells.select(F.col("i1").alias("j"), F.col("i2").alias("c"), F.col("v").alias("w"))
        got = self.entries.join(right, "j").groupBy("i", "c").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
        rows = spark.range(1, self.shape[0] + 1).withColumnRenamed("id", "i")
        every = rows.withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(y.shape[1]).cast("long"))))
        cells = every.join(got, ["i", "c"], "left").select(F.col("i").alias("i1"), F.col("c").alias("i2"), F.coalesce("s", F.lit(0.0)).alias("v"))
        return Tensor(cells, (self.shape[0], y.shape[1]), "float64", _product_labels(self, y), {"sparse_multiply": prov.stage(backend="sql")})

    def matvec(self, y) -> Tensor:
        y = y.to_numpy() if isinstance(y, Tensor) else np.asarray(y, float)
        if y.ndim != 1 or len(y) != self.shape[1]:
            raise ValueError("`y` must hold one value per column of the sparse matrix.")
        out = self.matmul(y[:, None])
        labels = (self.dimnames[0],) if self.dimnames and self.dimnames[0] else None
        return Tensor(out.cells.select("i1", "v"), (self.shape[0],), "float64", labels, out.stages)

    def _counted(self, axis: str, n: int, value) -> DataFrame:
        got = self.entries.groupBy(axis).agg(value.cast("double").alias("s"))
        return self.entries.sparkSession.range(1, n + 1).withColumnRenamed("id", axis).join(got, axis, "left").select(axis, F.coalesce("s", F.lit(0.0)).alias("v"))

    def row_sums(self) -> Tensor:
        return Tensor(self._counted("i", self.shape[0], F.sum("v")).withColumnRenamed("i", "i1"), (self.shape[0],), "float64", (self.dimnames[0],) if self.dimnames and self.dimnames[0] else None, {"row_reduction": prov.stage(backend="sql")})

    def col_sums(self) -> Tensor:
        return Tensor(self._counted("j", self.shape[1], F.sum("v")).withColumnRenamed("j", "i1"), (self.shape[1],), "float64", (self.dimnames[1],) if self.dimnames and self.dimnames[1] else None, {"column_reduction": prov.stage(backend="sql")})

    def normalize(self, margin: str = "rows", scale_factor: float = 1.0, log1p: bool = False) -> Sparse:
        """Each entry over its row's (or column's) sum, times scale_factor, and on request log(1 + x)."""
        if margin not in ("rows", "columns"):
            raise ValueError("`margin` must be rows or columns.")
        if isinstance(scale_factor, bool) or not np.isscalar(scale_factor) or not np.isfinite(scale_factor) or scale_factor <= 0:
            raise ValueError("The scale factor is a finite number above 0.")
        if not isinstance(log1p, bool):
            raise ValueError("`log1p` is True or False.")
        axis, n = ("i", self.shape[0]) if margin == "rows" else ("j", self.shape[1])
        sums = self.entries.groupBy(axis).agg(F.sum("v").alias("total"), F.min("v").alias("least"))
        bad = sums.agg(F.count("*").alias("n"), F.min("least").alias("least"), F.min("total").alias("total"), F.max("total").alias("most")).head()
        if bad["least"] is not None and bad["least"] < 0:
            raise ValueError("Normalisation needs non-negative values.")
        if bad["n"] < n or bad["total"] <= 0 or bad["most"] == float("inf"):
            raise ValueError("Every row or column to normalise must have a positive finite sum.")
        v = F.col("v") * F.lit(float(scale_factor)) / F.col("total")
        entries = self.entries.join(sums.select(axis, "total"), axis).select("i", "j", (F.log1p(v) if log1p else v).alias("v"))
        return self._with(entries, "normalization", dimnames=self.dimnames)

    def constant_columns(self) -> DataFrame:
        """j: columns whose sum of squares about the mean, zeros counted, vanishes within rounding."""
        eps, n = float(np.finfo(float).eps), self.shape[0]
        sums = self.entries.groupBy("j").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
        every = self.entries.sparkSession.range(1, self.shape[1] + 1).withColumnRenamed("id", "j").join(sums, "j", "left").fillna(0.0)
        return every.where(F.col("q") - F.col("s") * F.col("s") / n <= eps * F.greatest("q", F.lit(1.0))).select("j")


def sparse(spark: SparkSession, x, shape=None, format: str = "coo", drop_zeros: bool = True, dimnames=None) -> Sparse:
    """From a dense array, or from a DataFrame of triplets (i, j, v), of which equal places are summed."""
    if isinstance(x, Sparse):
        return x.as_csr() if format == "csr" else x.as_coo()
    if format not in ("coo", "csr"):
        raise ValueError("`format` must be coo or csr.")
    if not isinstance(drop_zeros, bool):
        raise ValueError("`drop_zeros` is True or False.")
    if not isinstance(x, DataFrame):
        x = np.asarray(x)
        if x.dtype.kind not in "iuf" or x.ndim != 2:
            raise ValueError("A sparse matrix must contain numeric values in two dimensions.")
        if not np.isfinite(x).all():
            raise ValueError("A sparse matrix must hold finite, non-missing values.")
        shape = x.shape
        i, j = np.nonzero(x) if drop_zeros else np.indices(x.shape).reshape(2, -1)
        rows = [(int(a) + 1, int(b) + 1, float(x[a, b])) for a, b in zip(i, j)]
        entries = spark.createDataFrame(rows, "i long, j long, v double")
    else:
        given = x.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double"))
        # A sum leaves nulls out, so missing parts of a triplet are told from the triplets and not from the sums.
        missing = F.greatest(*[F.col(c).isNull().cast("int") for c in ("i", "j", "v")])
        entries = given.groupBy("i", "j").agg(F.sum("v").alias("v"), F.max(missing).alias("missing"))
        entries = entries.persist()  # the check reads all of them, and every operator does again
        odd = (F.col("missing") == 1) | F.isnan("v") | (F.abs("v") == float("inf"))
        told = entries.agg(F.max("i").alias("i"), F.max("j").alias("j"), F.max(odd.cast("int")).alias("odd"), F.min(F.least("i", "j")).alias("low")).head()
        if told["odd"]:
            entries.unpersist()
            raise ValueError("Triplets need an index, another index and a finite value each.")
        entries = entries.where("v <> 0").drop("missing") if drop_zeros else entries.drop("missing")
        shape = shape or (told["i"] or 1, told["j"] or 1)
        if told["i"] is not None and (told["low"] < 1 or told["i"] > shape[0] or told["j"] > shape[1]):
            raise ValueError("Sparse indices must lie within the shape.")
    return Sparse(entries, tuple(shape), _check_labels(dimnames, shape), format)

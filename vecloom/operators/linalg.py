"""Singular values and principal components by tall-skinny QR over the partitions of a matrix."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.neighbors import _vectors, as_rows, check_matrix
from vecloom.operators.sparse import Sparse
from vecloom.plans import provenance as prov

#: Partitions' triangles are merged into so many before they come to the driver.
FAN_IN = 32


@dataclass
class Svd:
    d: np.ndarray
    u: DataFrame
    v: np.ndarray
    names: list[str]
    stages: dict[str, prov.Stage] = field(default_factory=lambda: {"decomposition": prov.stage(backend="tsqr")})
    provenance_schema: str = prov.SCHEMA

    def __repr__(self) -> str:
        return f"<Svd: {len(self.d)} singular values>"


@dataclass
class Pca:
    sdev: np.ndarray
    rotation: np.ndarray
    scores: DataFrame
    center: np.ndarray | None
    scale: np.ndarray | None
    feature_names: list[str] | None = None
    stages: dict[str, prov.Stage] = field(default_factory=dict)
    provenance_schema: str = prov.SCHEMA

    def __repr__(self) -> str:
        return f"<Pca: {len(self.sdev)} components, sdev {np.array2string(self.sdev, precision=4)}>\n{np.array2string(self.rotation, precision=4)}"


def triangle(rows: DataFrame, cols: int, center=None, scale=None) -> np.ndarray:
    """R of the QR decomposition of the (centred, scaled) matrix: each partition keeps a p x p triangle, and these merge."""
    center = np.zeros(cols) if center is None else center
    scale = np.ones(cols) if scale is None else scale

    def local(batches):
        r = None
        for batch in batches:
            if batch.num_rows:
                x = (_vectors(batch.column("features")) - center) / scale
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()])], names=["r"])

    def merge(batches):
        r = None
        for batch in batches:
            for flat in batch.column("r").to_pylist():
                one = np.array(flat).reshape(-1, cols)
                r = one if r is None else np.linalg.qr(np.vstack([r, one]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()])], names=["r"])

    found = rows.select("features").mapInArrow(local, "r array<double>").repartition(FAN_IN).mapInArrow(merge, "r array<double>")
    got = [np.array(r["r"]).reshape(-1, cols) for r in found.collect()]
    return np.linalg.qr(np.vstack(got), mode="r")


def project(rows: DataFrame, matrix: np.ndarray, center=None, scale=None, out: str = "features") -> DataFrame:
    """row_id and the (centred, scaled) row times a small matrix."""
    center = np.zeros(len(matrix)) if center is None else center
    scale = np.ones(len(matrix)) if scale is None else scale

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y = ((_vectors(batch.column("features")) - center) / scale) @ matrix
                values = pa.ListArray.from_arrays(np.arange(0, y.size + 1, max(y.shape[1], 1), dtype=np.int32) if y.shape[1] else np.zeros(len(y) + 1, np.int32), y.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), values], names=["row_id", out])

    return rows.select("row_id", "features").mapInArrow(run, f"row_id long, {out} array<double>")


def svd(spark: SparkSession, x, nu: int | None = None, nv: int | None = None) -> Svd:
    """Thin singular value decomposition; all min(n, p) values, and so many left and right vectors."""
    rows = as_rows(x)
    n, p = check_matrix(rows)
    rank = min(n, p)
    nu, nv = rank if nu is None else nu, rank if nv is None else nv
    if any(isinstance(k, bool) or int(k) != k or not 0 <= k <= rank for k in (nu, nv)):
        raise ValueError(f"`nu` and `nv` count vectors: 0 to {rank}.")
    _, d, vt = np.linalg.svd(triangle(rows, p), full_matrices=False)
    d, v = d[:rank], vt[:rank].T
    left = np.zeros((p, nu))
    ok = d[:nu] > d[0] * np.finfo(float).eps * max(n, p) if rank and d[0] > 0 else np.zeros(nu, bool)
    left[:, ok] = v[:, :nu][:, ok] / d[:nu][ok]
    return Svd(d, project(rows, left), v[:, :nv], [f"SVD{k + 1}" for k in range(rank)])


def column_stats(rows: DataFrame, cols: int) -> DataFrame:
    """col (from 1), mean, sd, low, high, rms of each column: every partition folds its rows into one row a column, and these merge."""

    def fold(batches):
        n, mean, square, low, high, raw = 0, np.zeros(cols), np.zeros(cols), np.full(cols, np.inf), np.full(cols, -np.inf), np.zeros(cols)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column("features"))
                own, m = x.mean(axis=0), len(x)
                square += ((x - own) ** 2).sum(axis=0) + (own - mean) ** 2 * (n * m / (n + m))
                mean, n = mean + (own - mean) * (m / (n + m)), n + m
                raw += (x**2).sum(axis=0)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, cols + 1, dtype=np.int32)), pa.array(np.full(cols, n)), *map(pa.array, (mean, square, low, high, raw))], names=["col", "n", "m", "q", "low", "high", "raw"])

    parts = rows.select("features").mapInArrow(fold, "col int, n long, m double, q double, low double, high double, raw double")
    sums = parts.groupBy("col").agg(F.collect_list(F.struct("n", "m", "q")).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("raw").alias("raw"))  # one entry a partition
    total = lambda of: F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + of(x))
    sums = sums.withColumn("n", total(lambda x: x["n"].cast("double"))).withColumn("mean", total(lambda x: x["n"] * x["m"]) / F.col("n"))
    spread = total(lambda x: x["q"] + x["n"] * (x["m"] - F.col("mean")) * (x["m"] - F.col("mean")))
    over = F.when(F.col("n") > 1, F.col("n") - 1)
    return sums.select("col", "mean", F.sqrt(spread / over).alias("sd"), "low", "high", F.sqrt(F.col("raw") / over).alias("rms"))


def pca(spark: SparkSession, x, n_components: int = 2, center: bool = True, scale: bool = False, feature_names: list[str] | None = None) -> Pca:
    """Principal components: standard deviations, rotation, scores. The signs of components are arbitrary."""
    for name, flag in (("center", center), ("scale", scale)):
        if not isinstance(flag, bool):
            raise ValueError(f"`{name}` is True or False.")
    rows = as_rows(x)
    n, p = check_matrix(rows, 2)
    most = min(n - 1, p)
    if isinstance(n_components, bool) or int(n_components) != n_components or not 1 <= n_components <= most:
        raise ValueError(f"Ask for 1 to {most} components.")
    stages = {"sparse_to_dense": prov.stage(backend="sql")} if isinstance(x, Sparse) else {}
    mean = sd = None
    if center or scale:
        stats = column_stats(rows, p).orderBy("col").toPandas()
        mean = stats["mean"].to_numpy() if center else None
        if scale:
            constant = not isinstance(x, Sparse) and (stats["low"] == stats["high"]).any() or isinstance(x, Sparse) and not x.constant_columns().isEmpty()
            if constant:
                raise ValueError("A constant column has no scale.")
            sd = stats["sd" if center else "rms"].to_numpy()
    _, d, vt = np.linalg.svd(triangle(rows, p, mean, sd), full_matrices=False)
    rotation = vt[:n_components].T
    stages |= {"preprocessing": prov.stage(backend="sql"), "decomposition": prov.stage(backend="tsqr")}
    return Pca(d[:n_components] / np.sqrt(n - 1), rotation, project(rows, rotation, mean, sd), mean, sd, feature_names, stages)


def sparse_covariance(x: Sparse) -> DataFrame:
    """i, j, v: the covariance of a sparse matrix's columns from its entries alone."""
    n = x.shape[0]
    a, b = x.entries.toDF("r", "i", "a"), x.entries.toDF("r", "j", "b")
    gram = a.join(b, "r").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))
    means = x.col_sums().cells.select(F.col("i1").alias("c"), (F.col("v") / n).alias("m"))
    every = means.toDF("i", "m_i").crossJoin(means.toDF("j", "m_j"))
    return every.join(gram, ["i", "j"], "left").select("i", "j", ((F.coalesce("g", F.lit(0.0)) - n * F.col("m_i") * F.col("m_j")) / (n - 1)).alias("v"))


def aligned_features(columns: list[str] | None, model_names: list[str] | None, n_features: int) -> list[int]:
    """Where each feature of the model stands among the columns of new data: by name if the model has names, else by place."""
    if model_names is None:
        if columns is not None and len(columns) != n_features:
            raise ValueError(f"The model has {n_features} features and no names; the new data names {len(columns)} columns.")
        return list(range(n_features))
    if columns is None:
        raise ValueError("The model's features have names, so the new data must name its columns.")
    places: dict[str, list[int]] = {}
    for place, name in enumerate(columns):
        places.setdefault(name, []).append(place)
    if list(columns) == list(model_names):  # also with names that repeat
        return list(range(n_features))
    faults = {
        "lacking": [name for name in model_names if name not in places],
        "unknown": [name for name in places if name not in model_names],
        "repeated": sorted({name for name in model_names if model_names.count(name) > 1} | {name for name, at in places.items() if len(at) > 1}),
    }
    if any(faults.values()):
        raise ValueError("The new data's columns aren't the model's features: " + ", ".join(f"{fault} {names}" for fault, names in faults.items() if names))
    return [places[name][0] for name in model_names]


def predict_pca(model: Pca, newdata: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """row_id and scores of new rows; works on streams as well. columns name the entries of `features`."""
    p = len(model.rotation)
    for name, part in (("rotation", model.rotation), ("center", model.center), ("scale", model.scale)):
        if part is not None and (len(part) != p or not np.isfinite(part).all()):
            raise ValueError(f"The model's {name} is of the wrong length or not finite.")
    if not newdata.isStreaming:
        _, found = check_matrix(newdata)
        if found != p:
            raise ValueError(f"The model has {p} features, the new rows have {found}.")
    order = aligned_features(columns, model.feature_names, p)
    rows = newdata if order == list(range(p)) else newdata.select("row_id", F.array(*[F.col("features")[k] for k in order]).alias("features"))
    return project(rows, model.rotation, model.center, model.scale)

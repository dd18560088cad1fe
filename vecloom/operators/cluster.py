"""k-means by Lloyd's rounds: centres travel to the rows, sums travel back."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.neighbors import _batch, _vectors, as_rows, check_matrix
from vecloom.plans import provenance as prov


@dataclass
class KMeans:
    assignments: DataFrame
    centers: np.ndarray
    withinss: np.ndarray
    tot_withinss: float
    iterations: int
    converged: bool
    stages: dict[str, prov.Stage] = field(default_factory=lambda: {k: prov.stage(backend="block") for k in ("initialization", "distance", "assignment", "center_update")})
    provenance_schema: str = prov.SCHEMA

    def __repr__(self) -> str:
        return f"<KMeans: {len(self.centers)} clusters, {self.iterations} iterations, converged {self.converged}>\n{np.array2string(self.centers, precision=4)}"


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances from direct differences."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def _assigned(rows: DataFrame, centers: np.ndarray, batch: int, distances: bool = False) -> DataFrame:
    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, max(batch, 1024)):
                part = whole.slice(a, max(batch, 1024))
                d = _squares(_vectors(part.column("features")), centers)
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("row_id"), pa.array((at + 1).astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(at)), at]))], names=["row_id", "cluster", "distance"])

    out = rows.select("row_id", "features").mapInArrow(run, "row_id long, cluster int, distance double")
    return out if distances else out.select("row_id", "cluster")


def _sums(rows: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, mean offset from the centre, and squared distances of each cluster: one row a cluster and partition comes back, combined by groups."""
    k, p = centers.shape

    def run(batches):
        n, s, w = np.zeros(k), np.zeros((k, p)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column("features"))
                d = _squares(x, centers)
                at = d.argmin(axis=1)
                n += np.bincount(at, minlength=k)
                w += np.bincount(at, d[np.arange(len(at)), at], k)
                np.add.at(s, at, x - centers[at])  # offsets keep their digits far from the origin
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), pa.array(w), pa.ListArray.from_arrays(np.arange(0, k * p + 1, p, dtype=np.int32), s.ravel())], names=["c", "n", "w", "s"])

    parts = rows.select("features").mapInArrow(run, "c long, n double, w double, s array<double>")
    sums = parts.select("c", "n", "w", F.posexplode("s").alias("p", "v")).groupBy("c", "p").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("v").alias("v")).collect()
    n, w, s = np.zeros(k), np.zeros(k), np.zeros((k, p))
    for r in sums:
        n[r["c"]], w[r["c"]], s[r["c"], r["p"]] = r["n"], r["w"], r["v"]
    return n, s / np.maximum(n, 1)[:, None], w


def _seed(seed) -> int:
    if seed is None:
        return 0
    if isinstance(seed, bool) or not np.isscalar(seed) or not np.isfinite(seed) or int(seed) != seed:
        raise ValueError("A seed is a whole number, or None.")
    return int(seed)


def kmeans(spark: SparkSession, x, centers, iter_max: int = 100, tolerance: float = 1e-6, seed: int | None = None, batch_size: int = 256) -> KMeans:
    """Lloyd's algorithm from given centres or from so many rows picked by a hash of (row_id, seed).

    Means, then reassignment, until no centre moves by more than the tolerance; an empty cluster
    keeps its centre and equal distances go to the lowest cluster.
    """
    rows, batch = as_rows(x), _batch(batch_size)
    n, p = check_matrix(rows)
    if isinstance(iter_max, bool) or int(iter_max) != iter_max or iter_max < 1:
        raise ValueError("At least one round is needed: give `iter_max` as a whole number.")
    if not np.isscalar(tolerance) or not np.isfinite(tolerance) or tolerance < 0:
        raise ValueError("The tolerance is a finite number of 0 or more.")
    if np.isscalar(centers):
        if isinstance(centers, bool) or int(centers) != centers or not 1 <= centers <= n - 1:
            raise ValueError("The number of clusters lies between 1 and one less than the rows.")
        picked = rows.orderBy(F.xxhash64("row_id", F.lit(_seed(seed))), "row_id").limit(int(centers)).select("features").collect()
        centers = np.array([r["features"] for r in picked])
    centers = np.array(centers, float)
    if centers.ndim != 2 or centers.shape[1] != p or not np.isfinite(centers).all():
        raise ValueError("Centres are finite and have as many columns as the rows.")
    rows = rows.persist()
    try:
        converged, t = False, 0
        for t in range(1, int(iter_max) + 1):
            count, offset, _ = _sums(rows, centers)
            new = np.where(count[:, None] > 0, centers + offset, centers)
            moved = float(np.abs(new - centers).max())
            centers = new
            if moved <= tolerance:
                converged = True
                break
        _, _, within = _sums(rows, centers)
    finally:
        rows.unpersist()
    return KMeans(_assigned(rows, centers, batch), centers, within, float(within.sum()), t, converged)


def check_kmeans(model: KMeans) -> None:
    """Whether a model can assign rows: centres are a finite matrix, and the sums belong to them."""
    centers = np.asarray(model.centers, float) if np.ndim(model.centers) == 2 else np.zeros((0, 0))
    if not centers.size or not np.isfinite(centers).all():
        raise ValueError("The model's centres are no finite matrix with rows and columns.")
    within = np.asarray(model.withinss, float)
    if within.shape != (len(centers),) or not np.isfinite(within).all() or (within < 0).any():
        raise ValueError(f"The model needs a sum of squares of 0 or more for each of its {len(centers)} clusters.")
    if not np.isclose(model.tot_withinss, within.sum(), rtol=1e-8, atol=1e-10):
        raise ValueError("The model's total isn't the sum of its clusters.")
    if isinstance(model.iterations, bool) or model.iterations < 0 or int(model.iterations) != model.iterations or not isinstance(model.converged, (bool, np.bool_)):
        raise ValueError("The model's count of rounds or its mark of convergence is invalid.")


def predict_kmeans(model: KMeans, newdata: DataFrame | None = None, kind: str = "cluster", batch_size: int = 256) -> DataFrame:
    """row_id, cluster of new rows (or of the fitted ones), or row_id, cluster, distance for all centres; clusters work on streams as well."""
    if kind not in ("cluster", "distance"):
        raise ValueError("`kind` is cluster or distance.")
    if newdata is None:
        if kind == "distance":
            raise ValueError("Distances need new rows.")
        return model.assignments
    check_kmeans(model)
    p = model.centers.shape[1]
    if not newdata.isStreaming and check_matrix(newdata)[1] != p:
        raise ValueError(f"The model has {p} columns, the new rows another number.")
    if kind == "cluster":
        return _assigned(newdata, model.centers, _batch(batch_size))
    centers = model.centers

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = np.sqrt(_squares(_vectors(batch.column("features")), centers))
                k = d.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(np.repeat(np.arange(len(d)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(d))), pa.array(d.ravel())], names=["row_id", "cluster", "distance"])

    return newdata.select("row_id", "features").mapInArrow(run, "row_id long, cluster int, distance double")

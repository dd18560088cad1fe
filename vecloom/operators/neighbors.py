"""Pairwise distances and exact, deterministic nearest neighbours of matrices in row form (row_id, features).

Two strategies: `sql` keeps everything in expressions (checkable, for small inputs); `block` deals
rows into blocks and compares a block of queries with a block of references in NumPy. A block's
matrix product only selects candidates, within an error bound; distances come from direct
differences, so ties and any scale are exact in both. Equal distances go to the smaller row_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.functions.vector import cosine_distance, euclidean, unit
from vecloom.operators.sparse import Sparse
from vecloom.plans import provenance as prov
from vecloom.plans.strategy import Strategy, register, select

METRICS = ("euclidean", "cosine")
#: Cells (pairs x columns) up to which "auto" stays in SQL.
SQL_CELLS = 20_000_000
#: Rows of a reference block.
BLOCK_ROWS = 8192
#: Bytes of a block of pairs, and pairs that are put out at once.
BLOCK_BYTES, PAIRS = 32 << 20, 1 << 18
#: Columns up to which sparse rows are filled in.
WIDE = 4096


@dataclass
class Knn:
    """row_id, rank, neighbor_id, distance."""

    rows: DataFrame
    k: int
    metric: str
    stages: dict[str, prov.Stage] = field(default_factory=dict)
    provenance_schema: str = prov.SCHEMA

    @property
    def compute_device(self) -> str:
        return prov.compute_device(self.stages)

    def __repr__(self) -> str:
        return f"<Knn: {self.k} neighbours, {self.metric}>"


def check_matrix(rows: DataFrame, least_rows: int = 1, least_cols: int = 1) -> tuple[int, int]:
    """Rows and columns of a finite numeric matrix, by one aggregate."""
    odd = F.col("features").isNull() | F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    got = rows.agg(F.count("*").alias("n"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high"), F.max(odd.cast("int")).alias("odd")).head()
    if got["n"] < least_rows or (got["low"] or 0) < least_cols or got["low"] != got["high"] or got["odd"]:
        raise ValueError(f"Rows must be finite and of one length: {least_rows} rows and {least_cols} columns at least.")
    return got["n"], got["low"]


def dense_rows(x: Sparse) -> DataFrame:
    """row_id, features of a sparse matrix, filled row by row; rows without entries too."""
    p = x.shape[1]
    every = x.entries.sparkSession.range(1, x.shape[0] + 1).withColumnRenamed("id", "i").join(x.csr_rows(), "i", "left")

    def fill(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, max(1, 4_000_000 // p)):
                batch = whole.slice(a, max(1, 4_000_000 // p))
                cols, vals = batch.column("cols"), batch.column("vals")
                out = np.zeros((batch.num_rows, p))
                sizes = np.nan_to_num(cols.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
                out[np.repeat(np.arange(batch.num_rows), sizes), cols.flatten().to_numpy(zero_copy_only=False) - 1] = vals.flatten().to_numpy(zero_copy_only=False)
                offsets = np.arange(0, out.size + 1, p)
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.ListArray.from_arrays(offsets.astype(np.int32), out.ravel())], names=["row_id", "features"])

    return every.mapInArrow(fill, "row_id long, features array<double>")


def as_rows(x) -> DataFrame:
    """row_id, features of a matrix, a tensor or a sparse matrix."""
    if isinstance(x, Sparse):
        return dense_rows(x)
    return x if isinstance(x, DataFrame) else x.rows()


def _metric(rows: DataFrame, metric: str) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"`metric` must be one of {', '.join(METRICS)}.")
    if metric == "cosine" and not rows.where(F.forall("features", lambda x: x == 0)).isEmpty():
        raise ValueError("A row of zeros has no direction, and so no cosine.")
    return rows.select("row_id", unit(F.col("features")).alias("features")) if metric == "cosine" else rows.select("row_id", "features")


def _batch(batch_size) -> int:
    if isinstance(batch_size, bool) or not isinstance(batch_size, (int, np.integer)) or batch_size < 1:
        raise ValueError("A batch holds one row or more.")
    return int(batch_size)


# The sql strategy


def _sql_pairs(x: DataFrame, y: DataFrame, metric: str) -> DataFrame:
    a, b = x.toDF("row_id", "a"), y.toDF("col_id", "b")
    d = euclidean(F.col("a"), F.col("b")) if metric == "euclidean" else cosine_distance(F.col("a"), F.col("b"))
    return a.crossJoin(b).select("row_id", "col_id", d.alias("distance"))


def _sql_distance(spark, x, y, metric, batch, own, digits=None):
    d = _sql_pairs(x, y, metric)
    d = d.withColumn("distance", F.when(F.col("row_id") == F.col("col_id"), 0.0).otherwise(F.col("distance"))) if own else d
    return d if digits is None else d.withColumn("distance", F.round("distance", digits))


def _sql_knn(spark, x, k, metric, batch, digits=None):
    d = _sql_pairs(x, x, metric).where("row_id <> col_id")
    if digits is not None:
        d = d.withColumn("distance", F.round("distance", digits))
    rank = F.row_number().over(Window.partitionBy("row_id").orderBy("distance", "col_id"))
    return d.withColumn("rank", rank).where(F.col("rank") <= k).select("row_id", "rank", F.col("col_id").alias("neighbor_id"), "distance")


# The block strategy


def direct(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Distances of paired rows from direct differences, scaled by the largest."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.abs(q - r)
        most = d.max(axis=-1, initial=0.0)
        safe = np.where((most > 0) & np.isfinite(most), most, 1.0)
        out = most * np.sqrt(((d / safe[..., None]) ** 2).sum(axis=-1))
    return np.where(np.isinf(most), np.inf, np.where(most == 0, 0.0, out))


def cosine_direct(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.clip(1 - (q * r).sum(axis=-1), 0, 2)


def top_k(distance: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of distances, the k smallest by (distance, id) but for its own id; infinite distances count, NaN is refused."""
    if np.isnan(distance).any():
        raise ValueError("Distances must not be NaN.")
    out_d, out_i = [], []
    for row, me in zip(distance, own):
        order = np.lexsort((ids, row))
        order = order[ids[order] != me][:k]
        out_d.append(row[order])
        out_i.append(ids[order])
    return np.array(out_d), np.array(out_i)


def rounded_as_sql(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded half up on its decimal digits, as Spark's round; only values next to a half are looked at one by one."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    with np.errstate(invalid="ignore"):
        near = np.isfinite(x) & (np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-6 + 1e-14 * np.abs(scaled))
    for i in np.flatnonzero(near):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _nearest_in_block(q: np.ndarray, q_ids: np.ndarray, r: np.ndarray, r_ids: np.ndarray, k: int, metric: str, digits: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query, the exact k nearest rows of the block, by (distance, id); with digits, by the distance rounded so."""
    pair = direct if metric == "euclidean" else cosine_direct
    centre = r.mean(axis=0) if np.isfinite(r.sum()) else np.zeros(r.shape[1])
    scale = max(float(np.abs(r - centre).max(initial=0)), float(np.abs(q - centre).max(initial=0)), np.finfo(float).tiny)
    usable = np.isfinite(scale)
    qs, rs = ((q - centre) / scale, (r - centre) / scale) if usable else (q, r)
    r2 = (rs**2).sum(axis=1)
    slack = 64 * np.finfo(float).eps * (r.shape[1] + 4)
    for a in range(0, len(q), 512):
        part, ids = qs[a : a + 512], q_ids[a : a + 512]
        q2 = (part**2).sum(axis=1)
        if usable and len(r) > 4 * k:
            rough = q2[:, None] + r2[None] - 2 * part @ rs.T
            rough[ids[:, None] == r_ids[None]] = np.inf
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
            reach = kth + slack * (q2 + r2.max()) * 2
            if digits is not None:  # whatever may round to the same
                apart = 10.0**-digits if metric == "euclidean" else np.sqrt(2 * 10.0**-digits)
                reach = (np.sqrt(np.maximum(reach, 0)) + apart / scale) ** 2 + slack * (q2 + r2.max()) * 2
            row, col = np.nonzero(rough <= reach[:, None])
        else:
            row, col = np.nonzero(ids[:, None] != r_ids[None])
        d = pair(q[a : a + 512][row], r[col])
        if digits is not None:
            d = rounded_as_sql(d, digits)
        order = np.lexsort((r_ids[col], d, row))
        row, col, d = row[order], col[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        yield ids[row[keep]], r_ids[col[keep]], d[keep]


def _vectors(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _cells(x: DataFrame, y: DataFrame, rows: int) -> DataFrame:
    """References dealt into blocks; every block's rows come first, then all queries. One cell is one block."""
    blocks = max(1, -(-rows // BLOCK_ROWS))
    held = y.select(F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "row_id", "features", F.lit(0).alias("part"))
    parts = max(1, -(-16 // blocks))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = x.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "row_id", "features", F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
    return held.unionByName(asked).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "asks", "row_id")


def _by_block(batches: Iterator[pa.RecordBatch], each) -> Iterator[pa.RecordBatch]:
    cell, ids, rows = None, [], []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key = (batch.column("block").to_numpy().astype(np.int64) << 32) + (batch.column("part").to_numpy().astype(np.int64) << 1) + batch.column("asks").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
        for a, b in zip(edges[:-1], edges[1:]):
            part = batch.slice(a, b - a)
            if int(key[a]) >> 1 != cell:
                cell, ids, rows = int(key[a]) >> 1, [], []
            if not key[a] & 1:
                ids.append(part.column("row_id").to_numpy())
                rows.append(_vectors(part.column("features")))
            elif ids:
                ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                yield from each(part.column("row_id").to_numpy(), _vectors(part.column("features")), ids[0], rows[0])


def _block_knn(spark, x, k, metric, batch, digits=None):
    n = x.count()

    def each(q_ids, q, r_ids, r):
        for a, b, d in _nearest_in_block(q, q_ids, r, r_ids, k, metric, digits):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["row_id", "neighbor_id", "distance"])

    found = _cells(x, x, n).mapInArrow(lambda it: _by_block(it, each), "row_id long, neighbor_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("row_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("row_id", "rank", "neighbor_id", "distance")


def _packed(x: DataFrame, blocks: int) -> DataFrame:
    """The rows dealt evenly into blocks, one to a partition and each a single row of bytes."""

    def pack(batches):
        ids, rows = [], []
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("row_id").to_numpy().tobytes())
                rows.append(_vectors(batch.column("features")).tobytes())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(c)], pa.binary()) for c in (ids, rows)], names=["ids", "features"])

    return x.repartition(blocks).mapInArrow(pack, "ids binary, features binary")


def _block_pairs(x: DataFrame, y: DataFrame, rows: int, p: int) -> DataFrame:
    """Each block of x beside each block of y. Tasks read the two blocks from the shuffle, which holds a row once and not once a block."""
    blocks = max(1, -(-rows // max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * p)))))
    held = _packed(y, blocks).toDF("r_ids", "r")
    return _packed(x, max(blocks, -(-16 // blocks))).toDF("q_ids", "q").crossJoin(held.hint("shuffle_replicate_nl"))


def _unpacked_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            q_ids, q, r_ids, r = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("q_ids", np.int64), ("q", np.float64), ("r_ids", np.int64), ("r", np.float64)))
            yield q_ids, q.reshape(len(q_ids), -1), r_ids, r.reshape(len(r_ids), -1)


def _rounded_cosine(q: np.ndarray, r: np.ndarray, digits: int) -> np.ndarray:
    """cosine_direct of all pairs, rounded, by a matrix product; where its last bits could turn the rounding, the direct sum decides."""
    d = q @ r.T
    np.subtract(1, d, out=d)
    np.clip(d, 0, 2, out=d)
    d *= 10.0**digits
    whole = np.floor(d + 0.5)
    d -= whole
    np.abs(d, out=d)
    i, j = np.nonzero(d >= 0.5 - 1e-6 - 10.0**digits * 64 * np.finfo(float).eps * (q.shape[1] + 4))
    whole /= 10.0**digits
    for a in range(0, len(i), 1 << 16):
        at = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        whole[at] = rounded_as_sql(cosine_direct(q[at[0]], r[at[1]]), digits)
    return whole


def _block_distance(spark, x, y, metric, batch, own, digits=None):
    pair = direct if metric == "euclidean" else cosine_direct
    n, p = y.agg(F.count("*"), F.max(F.size("features"))).head()

    def each(batches):
        for q_ids, q, r_ids, r in _unpacked_pairs(batches):
            product = metric == "cosine" and digits is not None
            step = max(1, min(batch, PAIRS // len(r) if product else 4_000_000 // r.size))
            for a in range(0, len(q), step):
                part = q[a : a + step]
                if product:
                    d = _rounded_cosine(part, r, digits).ravel()
                else:
                    d = pair(part[:, None, :], r[None]).ravel()
                    d = d if digits is None else rounded_as_sql(d, digits)
                i, j = np.repeat(q_ids[a : a + step], len(r_ids)), np.tile(r_ids, len(part))
                if own:
                    d[i == j] = 0.0
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(d)], names=["row_id", "col_id", "distance"])

    return _block_pairs(x, y, n, p or 1).mapInArrow(each, "row_id long, col_id long, distance double")


register(Strategy("sql", "executors", {"distance": _sql_distance, "knn": _sql_knn}, SQL_CELLS), replace=True)
register(Strategy("block", "executors", {"distance": _block_distance, "knn": _block_knn}), replace=True)


def distance(spark: SparkSession, x, y=None, metric: str = "euclidean", batch_size: int = 256, strategy: str = "auto", digits: int | None = None) -> DataFrame:
    """row_id, col_id, distance of all pairs, with digits rounded; a row's distance to itself is 0 when y is left out."""
    batch, rows = _batch(batch_size), as_rows(x)
    n, p = check_matrix(rows)
    other = rows if y is None else as_rows(y)
    m, cols = check_matrix(other) if y is not None else (n, p)
    if p != cols:
        raise ValueError("Both matrices need equally many columns.")
    chosen = select(strategy, "distance", n * m * p)
    from vecloom.plans.strategy import call

    return call(chosen.strategy, "distance", spark, _metric(rows, metric), _metric(other, metric), metric, batch, y is None, **({} if digits is None else {"digits": digits}))


def knn(spark: SparkSession, x, k: int = 15, metric: str = "euclidean", batch_size: int = 256, strategy: str = "auto", digits: int | None = None) -> Knn:
    """The exact k nearest other rows of each row, by (distance, row_id); with digits, distances are rounded before they are compared."""
    batch, rows = _batch(batch_size), as_rows(x)
    n, p = check_matrix(rows, 2)
    if isinstance(k, bool) or not isinstance(k, (int, np.integer)) or not 1 <= k <= n - 1:
        raise ValueError("A row has from 1 to (rows - 1) neighbours; `k` is such a whole number.")
    chosen = select(strategy, "knn", n * n * p)
    from vecloom.plans.strategy import call

    found = call(chosen.strategy, "knn", spark, _metric(rows, metric), int(k), metric, batch, **({} if digits is None else {"digits": digits}))
    stages = ({"sparse_to_dense": prov.stage(backend="sql")} if isinstance(x, Sparse) else {}) | {"distance": chosen.stage, "neighbor_selection": chosen.stage}
    return Knn(found, int(k), metric, stages)


def sparse_knn(spark: SparkSession, x: Sparse, k: int = 15) -> Knn:
    """Exact Euclidean neighbours of sparse rows.

    Up to WIDE columns the rows are filled in and compared in blocks. Wider rows are not filled in:
    pairs that share columns are formed by a join on columns, and all others follow from the rows' norms.
    """
    n = x.shape[0]
    if not 1 <= k <= n - 1:
        raise ValueError("A row has from 1 to (rows - 1) neighbours; `k` is such a whole number.")
    if x.shape[1] <= WIDE:
        return knn(spark, x, k, strategy="block")
    rows = x.entries.sparkSession.range(1, n + 1).withColumnRenamed("id", "i")
    norms = rows.join(x.entries.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("q")), "i", "left").fillna(0.0)
    a, b = x.entries.toDF("r", "j", "a"), x.entries.toDF("c", "j", "b")
    dots = a.join(b, "j").where("r <> c").groupBy("r", "c").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    shared = dots.join(norms.toDF("r", "q_r"), "r").join(norms.toDF("c", "q_c"), "c").select("r", "c", F.sqrt(F.greatest(F.col("q_r") + F.col("q_c") - 2 * F.col("dot"), F.lit(0.0))).alias("d"))
    apart = norms.toDF("r", "q_r").crossJoin(norms.toDF("c", "q_c")).where("r <> c").join(dots.select("r", "c"), ["r", "c"], "left_anti").select("r", "c", F.sqrt(F.col("q_r") + F.col("q_c")).alias("d"))
    rank = F.row_number().over(Window.partitionBy("r").orderBy("d", "c"))
    out = shared.union(apart).withColumn("rank", rank).where(F.col("rank") <= k)
    return Knn(out.select(F.col("r").alias("row_id"), "rank", F.col("c").alias("neighbor_id"), F.col("d").alias("distance")), k, "euclidean", {"distance": prov.stage(backend="sql"), "neighbor_selection": prov.stage(backend="sql")})

"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on the driver from at most
`sample` vectors (those with the least hash of their id); every row is assigned and coded. How
many lists a query visits is measured on the same sample: as many as hold COVERAGE of its exact
neighbours there. Lists are gathered into cells of about CELL_ROWS rows, and a longer list is
dealt over several, so no task holds a hot list and a query travels once to a cell. In a cell a
query's asymmetric distance table ranks the codes of the lists that it visits; only the best
k * RERANK are compared on the vectors themselves, and the nearest k leave the cell. An exact check
follows: how well codes and lists tell rows apart depends on the rows (many near copies of a few
vectors share their codes, groups of other scales or outside the sample have no list of their own),
so each query goes once more to every list that, by its centre and its largest radius, may hold a row
as near as the k-th found, and all such rows are compared. Queries that found fewer than k rows go to
all lists. The answers are thus the nearest of all rows. Where radii rule out no list, the check
multiplies each query with all rows.

Distances of codes come apart into |q - c|^2, a number kept with each code and the products of q
with the codewords, so one table a query serves all lists.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows without an id; vectors of different lengths are no candidates of each other, and each
length has an index of its own; equal distances go to the smaller id; of one vector's copies a
cell ranks the k + 1 smallest ids, as no more can be among the nearest k; rows that share an id
are candidates like others; with fewer candidates than k all are returned; tables without rows
give none; very long vectors cost their length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.llm.common import written

SAMPLE = 20_000
PARTS, CODES = 16, 256
#: Codes whose vectors are compared in each cell, for each neighbour wanted.
RERANK = 20
CELL_ROWS = 16_384
#: Share of the exact neighbours that the visited lists hold, in the sample, and how many of its rows ask.
COVERAGE, ASKING = 0.96, 400
SCHEMA = "query_id long, rank int, vec_id long, score double"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: rows that take part; single precision stays as it is, everything else becomes double."""
    single = dict(rows.dtypes)[vector_col] == "array<float>"
    v = F.col(vector_col) if single else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k means from distinct starting rows; an empty one keeps its place."""
    rng = np.random.default_rng(seed)
    start = np.unique(x, axis=0)
    centres = start[rng.permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, column, len(centres)) for column in x.T], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1), 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(distances(x[a : a + 4096], centres), axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


@dataclass
class Index:
    """What is fitted: coarse centroids, one codebook for each part of the residuals, and how many lists a query visits."""

    centres: np.ndarray
    books: list[np.ndarray]
    splits: np.ndarray
    visits: int

    def _parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        return zip(self.splits[:-1].tolist(), self.splits[1:].tolist(), self.books)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and the number beside the codes: the coded residual r gives 2 c r + |r|^2."""
        at = nearest(x, self.centres)
        rest = x - self.centres[at]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in self._parts()], axis=1).astype(np.uint8)
        back = np.concatenate([book[codes[:, m]] for m, (_, _, book) in enumerate(self._parts())], axis=1)
        return at, codes, (2 * self.centres[at] * back).sum(axis=1) + (back**2).sum(axis=1)

    def table(self, q: np.ndarray) -> np.ndarray:
        """-2 q r for every codeword: parts x codes."""
        out = np.zeros((len(self.books), CODES))
        for m, (a, b, book) in enumerate(self._parts()):
            out[m, : len(book)] = -2 * (book @ q[a:b])
        return out


def fit_index(vectors: DataFrame, rows: int, k: int, sample: int = SAMPLE, lists: int | None = None, coverage: float = COVERAGE) -> Index:
    """The index over `rows` vectors: by default sqrt(rows) lists, but no more than a fifth of the sample."""
    x = np.array([r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], float)
    centres = lloyd(x, lists or int(np.clip(np.sqrt(rows), 1, max(1, min(sample, len(x)) // 5))))
    at = nearest(x, centres)
    rest = x - centres[at]
    splits = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
    books = [lloyd(rest[:, a:b], CODES) for a, b in zip(splits[:-1], splits[1:])]
    return Index(centres, books, splits, _visits(x, at, centres, k, coverage))


def _visits(x: np.ndarray, at: np.ndarray, centres: np.ndarray, k: int, coverage: float) -> int:
    """The least number of nearest lists that hold `coverage` of the k nearest of the sample's first rows."""
    asking = np.arange(min(ASKING, len(x)))
    d = distances(x[asking], x)
    d[asking, asking] = np.inf
    k = min(k, len(x) - 1)
    if k == 0:
        return 1
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(distances(x[asking], centres), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, at[near], axis=1).ravel())
    return int(needed[int(np.ceil(coverage * len(needed))) - 1]) + 1


def neighbours(spark: SparkSession, rows: DataFrame, is_query, k: int = 10, visits: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest k of the other rows by Euclidean distance.

    visits is the number of lists a query goes to; by default it is measured.
    """
    vectors = usable(rows, id_col, vector_col)
    lengths = vectors.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()
    out = spark.createDataFrame([], SCHEMA)
    for n, total in lengths:
        out = out.union(_of_length(spark, vectors.where(F.size("v") == n), n, total, is_query, k, visits, sample))
    return out


def _of_length(spark: SparkSession, vectors: DataFrame, dim: int, total: int, is_query, k: int, visits: int | None, sample: int) -> DataFrame:
    index = fit_index(vectors, total, k, sample)
    kind = np.float32 if dict(vectors.dtypes)["v"] == "array<float>" else np.float64
    lists = len(index.centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), dim)
                at, codes, beside = index.encode(x.astype(float))
                away = np.sqrt(((x - index.centres[at]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), _packed(x), pa.array(at.astype(np.int32)), _packed(codes), pa.array(beside), batch.column("same"), pa.array(away)], names=["id", "v", "list", "code", "beside", "same", "away"])

    same = vectors.withColumn("same", F.xxhash64("v"))
    coded = written(same.mapInArrow(assign, "id long, v binary, list int, code binary, beside double, same long, away double"), spark, "ann-coded")
    sizes = np.ones(lists, int)
    for r in coded.groupBy("list").count().collect():  # one row for each list
        sizes[r["list"]] = max(1, -(-r["count"] // CELL_ROWS))
    cells = int(np.clip(total // CELL_ROWS, 1, lists))
    salts = F.element_at(F.array(*[F.lit(int(s)) for s in sizes]), F.col("list") + 1) if sizes.max() > 1 else F.lit(1)
    place = [F.pmod("list", F.lit(cells)).alias("cell"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt")]
    held = coded.select(*place, F.lit(0).alias("asks"), "id", "v", "list", "code", "beside", "same")
    queries = coded.where(is_query(F.col("id"))).select("id", "v")

    def searched(asking: DataFrame, visits: int) -> DataFrame:
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each query once for every cell that holds a part of a list that it visits."""
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    q = _unpacked(part.column("v"), kind).astype(float)
                    near = np.argpartition(distances(q, index.centres), visits - 1, axis=1)[:, :visits]
                    row, cell, salt, wanted = [], [], [], []
                    for i, own in enumerate(near):
                        own = np.sort(own)
                        for s in range(int(sizes[own].max())):
                            there = own[sizes[own] > s]
                            for c in np.unique(there % cells).tolist():
                                row.append(i)
                                cell.append(c)
                                salt.append(s)
                                wanted.append(there[there % cells == c].astype(np.int32).tobytes())
                    take = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(salt, pa.int32()), part.column("id").take(take), part.column("v").take(take), pa.array(wanted, pa.binary())], names=["cell", "salt", "id", "v", "code"])

        none = F.lit(None)
        asked = asking.mapInArrow(route, "cell int, salt int, id long, v binary, code binary").select("cell", "salt", F.lit(1).alias("asks"), "id", "v", none.cast("int").alias("list"), "code", none.cast("double").alias("beside"), none.cast("long").alias("same"))
        dealt = held.union(asked).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "asks", "id")
        best = dealt.mapInArrow(lambda batches: _search(index, batches, kind, k), "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return written(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), spark, "ann-found")

    reach = np.full(lists, -np.inf)  # of lists without rows
    for r in coded.groupBy("list").agg(F.max("away").alias("away")).collect():
        reach[r["list"]] = r["away"]

    def checked(found: DataFrame) -> DataFrame:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each query once for every cell that holds a part of a list which its k-th distance reaches."""
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    q, upto = _unpacked(part.column("v"), kind).astype(float), part.column("beside").to_numpy()
                    with np.errstate(invalid="ignore", over="ignore"):
                        away = np.sqrt(np.stack([((index.centres - own) ** 2).sum(axis=1) for own in q]))
                        asks = ~(away - reach > upto[:, None] + 1e-9 * (away + np.where(np.isfinite(reach), reach, 0)))
                    asks[:, reach == -np.inf] = False
                    row, cell, salt = [], [], []
                    for s in range(int(sizes.max())):
                        for c in range(cells):
                            there = np.flatnonzero((np.arange(lists) % cells == c) & (sizes > s))
                            to = np.flatnonzero(asks[:, there].any(axis=1))
                            row.append(to)
                            cell.append(np.full(len(to), c, np.int32))
                            salt.append(np.full(len(to), s, np.int32))
                    take = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell)), pa.array(np.concatenate(salt)), part.column("id").take(take), part.column("v").take(take), part.column("beside").take(take)], names=["cell", "salt", "id", "v", "beside"])

        kth = found.where(F.col("rank") == min(k, total - 1)).select(F.col("query_id").alias("id"), "score")
        bounded = queries.join(kth, "id", "left").select("id", "v", F.coalesce("score", F.lit(float("inf"))).alias("beside"))
        none = F.lit(None)
        asked = bounded.mapInArrow(send, "cell int, salt int, id long, v binary, beside double").select("cell", "salt", F.lit(1).alias("asks"), "id", "v", none.cast("int").alias("list"), none.cast("binary").alias("code"), "beside", none.cast("long").alias("same"))
        dealt = held.withColumn("code", none.cast("binary")).union(asked).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "asks", "id")
        best = dealt.mapInArrow(lambda batches: _search(index, batches, kind, k, True), "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return written(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), spark, "ann-checked")

    return checked(searched(queries, min(lists, visits or index.visits)))


def _search(index: Index, batches: Iterator[pa.RecordBatch], kind: type, k: int, check: bool = False) -> Iterator[pa.RecordBatch]:
    """Cells come sorted, their rows before their queries: a cell's rows are held while its queries pass."""
    at, held, cell = None, [], None
    for batch in batches:
        key = batch.column("cell").to_numpy().astype(np.int64) << 33 | batch.column("salt").to_numpy().astype(np.int64) << 1 | batch.column("asks").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if int(key[a]) >> 1 != at:
                at, held, cell = int(key[a]) >> 1, [], None
            if not key[a] & 1:
                held.append(batch.slice(a, b - a))
            elif held:
                cell = cell or _Cell(index, pa.Table.from_batches(held).combine_chunks(), kind, k)
                yield from (cell.within if check else cell.answers)(batch.slice(a, b - a))


class _Cell:
    """One cell's rows by list, and what its queries find in it."""

    def __init__(self, index: Index, rows: pa.Table, kind: type, k: int):
        self.index, self.kind, self.k = index, kind, k
        ids, same, at = (rows.column(c).to_numpy() for c in ("id", "same", "list"))
        order = np.lexsort((ids, same))
        first = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        copy = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        order = order[copy <= k]  # more copies of one vector can't be among the nearest k
        order = order[np.argsort(at[order], kind="stable")]
        take = pa.array(order)
        self.ids, self.at, self.beside = ids[order], at[order], rows.column("beside").to_numpy()[order]
        codes = rows.column("code")
        self.codes = None if codes.null_count else np.ascontiguousarray(_unpacked(codes.take(take).combine_chunks(), np.uint8).T)
        self.x = _unpacked(rows.column("v").take(take).combine_chunks(), kind)

    def answers(self, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out_q, out_v, out_s = [], [], []
        for me, v, wanted in zip(asked.column("id").to_pylist(), asked.column("v").to_pylist(), asked.column("code").to_pylist()):
            q, lists = np.frombuffer(v, self.kind).astype(float), np.frombuffer(wanted, np.int32)
            low, high = np.searchsorted(self.at, lists), np.searchsorted(self.at, lists, "right")
            rows = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
            rows = rows[self.ids[rows] != me]
            if not len(rows):
                continue
            near = ((self.index.centres[lists] - q) ** 2).sum(axis=1)
            rough = near[np.searchsorted(lists, self.at[rows])] + self.beside[rows]
            table = self.index.table(q)
            for m, codes in enumerate(self.codes):
                rough += table[m][codes[rows]]
            most = self.k * RERANK
            if most < len(rows):
                rows = rows[np.argpartition(rough, most - 1)[:most]]
            exact = np.sqrt(((self.x[rows].astype(float) - q) ** 2).sum(axis=1))
            best = np.lexsort((self.ids[rows], exact))[: self.k]
            out_q.append(np.full(len(best), me))
            out_v.append(self.ids[rows][best])
            out_s.append(exact[best])
        if out_q:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])


    def within(self, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of each query the nearest k rows that are as near as its k-th so far; a product rules rows out, direct differences decide."""
        ids, upto = asked.column("id").to_numpy(), asked.column("beside").to_numpy()
        q = _unpacked(asked.column("v"), self.kind).astype(float)
        x = self.x.astype(float)
        with np.errstate(invalid="ignore", over="ignore"):
            middle = x.mean(axis=0)
            x -= middle
            x2, slack = (x**2).sum(axis=1), 64 * np.finfo(float).eps * (x.shape[1] + 4)
            out_q, out_v, out_s = [], [], []
            step = max(1, (1 << 21) // len(x))
            for a in range(0, len(q), step):
                part = q[a : a + step] - middle
                q2 = (part**2).sum(axis=1)
                rough = q2[:, None] + x2 - 2 * part @ x.T
                allowed = slack * (q2 + x2.max())
                rough[ids[a : a + step, None] == self.ids] = np.inf
                if self.k < len(x):  # with no k-th so far, or a far one, that of this cell
                    near = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + 2 * allowed
                    limit = np.fmin(upto[a : a + step] ** 2 * (1 + 1e-9) + allowed, near)
                else:
                    limit = upto[a : a + step] ** 2 * (1 + 1e-9) + allowed
                for i, own in enumerate(~(rough > limit[:, None])):
                    rows = np.flatnonzero(own & (self.ids != ids[a + i]))
                    exact = np.sqrt(((self.x[rows].astype(float) - q[a + i]) ** 2).sum(axis=1))
                    best = np.lexsort((self.ids[rows], exact))[: self.k]
                    out_q.append(np.full(len(best), ids[a + i]))
                    out_v.append(self.ids[rows][best])
                    out_s.append(exact[best])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)

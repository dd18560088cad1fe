"""The registered queries of the engine's operators and the SQL that gives the same rows.

Floating-point results are rounded on both sides: sums come in another order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.operators import cluster, embed, graph, linalg, neighbors
from vecloom.operators.sparse import Sparse, sparse
from vecloom.operators.tensor import Tensor, block_matmul, tensor_of_rows
from vecloom.plans import provenance as prov
from vecloom.sources.tables import CHUNK_ROWS, rows_from_columns, rows_from_vectors, sent, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIM = 64

# Shared pieces of SQL: embeddings as rows and as cells, lineitem as triplets, the 5 nearest neighbours.
M = "m AS (SELECT vec_id + 1 AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
X = M + ", x AS (SELECT id, generate_subscripts(e, 1)::BIGINT AS c, unnest(e) AS v FROM m)"
S = "s AS (SELECT l_suppkey + 1 AS i, l_partkey + 1 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0)"
P = M + ", p AS (SELECT a.id AS q, b.id AS r, list_distance(a.e, b.e) AS d FROM m a, m b WHERE a.id <> b.id)"
K = P + ", k AS (SELECT q, r, d, rk FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, r) AS rk FROM p) WHERE rk <= 5)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(c: str | Column, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def rows(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as a matrix with row_id from 1."""
    return rows_from_vectors(table(spark, d, "embeddings").withColumn("vec_id", F.col("vec_id") + 1), "vec_id", "embedding")


def matrix(spark: SparkSession, d: str) -> Tensor:
    got = rows(spark, d)
    return tensor_of_rows(got, got.count(), DIM)


def triplets(spark: SparkSession, d: str) -> Sparse:
    """Quantities by supplier and part."""
    t = table(spark, d, "lineitem").select((F.col("l_suppkey") + 1).alias("i"), (F.col("l_partkey") + 1).alias("j"), F.col("l_quantity").alias("v"))
    return sparse(spark, t)


def cells(t: Tensor, n: int = 6) -> DataFrame:
    return t.cells.select(*[c for c in t.cells.columns if c != "v"], rounded("v", n).alias("v"))


# Neighbours and distances

KNN_SQL = f"WITH {K} SELECT q AS row_id, rk::INT AS rank, r AS neighbor_id, round(d, 6) AS distance FROM k"


def _knn(found: DataFrame) -> DataFrame:
    return found.select("row_id", "rank", "neighbor_id", rounded("distance").alias("distance"))


@query("knn_euclid", KNN_SQL)
def knn_euclid(spark, d):
    return _knn(neighbors.knn(spark, rows(spark, d), 5).rows)


@query("knn_euclid_block", KNN_SQL)
def knn_euclid_block(spark, d):
    return _knn(neighbors.knn(spark, rows(spark, d), 5, strategy="block").rows)


COSINE = "m AS (SELECT vec_id + 1 AS id, list_transform(embedding::DOUBLE[], lambda y: y * (vec_id % 7 + 1)) AS e FROM embeddings)"
COSINE_SQL = f"""WITH {COSINE}, p AS (SELECT a.id AS q, b.id AS r, 1 - list_cosine_similarity(a.e, b.e) AS d FROM m a, m b WHERE a.id <> b.id)
SELECT q AS row_id, rk::INT AS rank, r AS neighbor_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, r) AS rk FROM p) WHERE rk <= 5"""


def _rescaled(spark, d):
    return rows(spark, d).select("row_id", F.transform("features", lambda x: x * ((F.col("row_id") - 1) % 7 + 1)).alias("features"))


@query("knn_cosine", COSINE_SQL)
def knn_cosine(spark, d):
    return _knn(neighbors.knn(spark, _rescaled(spark, d), 5, "cosine").rows)


@query("knn_cosine_block", COSINE_SQL)
def knn_cosine_block(spark, d):
    return _knn(neighbors.knn(spark, _rescaled(spark, d), 5, "cosine", strategy="block").rows)


def _labelled(spark, d, label):
    e = table(spark, d, "embeddings").where(F.col("label") == label)
    return rows_from_vectors(e.withColumn("vec_id", F.col("vec_id") + 1), "vec_id", "embedding")


CROSS_SQL = f"WITH {M} SELECT a.id AS row_id, b.id AS col_id, round(list_distance(a.e, b.e), 6) AS distance FROM m a, m b WHERE a.label = 0 AND b.label = 1"


@query("distance_cross", CROSS_SQL)
def distance_cross(spark, d):
    return neighbors.distance(spark, _labelled(spark, d, 0), _labelled(spark, d, 1)).withColumn("distance", rounded("distance"))


@query("distance_cross_block", CROSS_SQL)
def distance_cross_block(spark, d):
    return neighbors.distance(spark, _labelled(spark, d, 0), _labelled(spark, d, 1), strategy="block").withColumn("distance", rounded("distance"))


@query("distance_self_cosine", f"WITH {COSINE} SELECT a.id AS row_id, b.id AS col_id, CASE WHEN a.id = b.id THEN 0 ELSE round(1 - list_cosine_similarity(a.e, b.e), 6) END::DOUBLE AS distance FROM m a, m b")
def distance_self_cosine(spark, d):
    return neighbors.distance(spark, _rescaled(spark, d), metric="cosine", digits=6)


@query("topk_stable_ties", f"WITH {P} SELECT q AS row_id, rk::INT AS rank, r AS neighbor_id, d AS distance FROM (SELECT q, r, round(d, 2) AS d, row_number() OVER (PARTITION BY q ORDER BY round(d, 2), r) AS rk FROM p) WHERE rk <= 7")
def topk_stable_ties(spark, d):
    given = rows(spark, d)
    n = given.count()
    if n < 2:
        return spark.createDataFrame([], "row_id long, rank int, neighbor_id long, distance double")
    return neighbors.knn(spark, given, min(7, n - 1), digits=2).rows


@query("unit_rows", f"WITH {COSINE} SELECT id AS row_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM m")
def unit_rows(spark, d):
    from vecloom.functions.vector import norm, unit

    return _rescaled(spark, d).select("row_id", rounded(norm(F.col("features"))).alias("norm"), rounded(unit(F.col("features"))[0]).alias("first"))


@query("matrix_check", f"WITH {X} SELECT c AS col, min(v) = max(v) AS constant, count(*) FILTER (isnan(v) OR isinf(v)) AS nonfinite FROM x GROUP BY c")
def matrix_check(spark, d):
    v = F.posexplode("features").alias("p", "v")
    odd = F.count_if(F.isnan("v") | (F.abs("v") == float("inf")))
    return rows(spark, d).select(v).groupBy((F.col("p") + 1).cast("long").alias("col")).agg((F.min("v") == F.max("v")).alias("constant"), odd.alias("nonfinite"))


# Tensors


@query("tensor_create", f"WITH {X} SELECT id AS i1, c AS i2, v FROM x")
def tensor_create(spark, d):
    return matrix(spark, d).cells


@query("tensor_metadata", "SELECT 'shape' AS key, count(*) || ' x 64' AS value FROM embeddings UNION ALL SELECT 'length', (count(*) * 64)::VARCHAR FROM embeddings UNION ALL SELECT 'dtype', 'float64'")
def tensor_metadata(spark, d):
    t = matrix(spark, d)
    return spark.createDataFrame([("shape", " x ".join(map(str, t.shape))), ("length", str(len(t))), ("dtype", t.dtype)], "key string, value string")


@query("tensor_to_host", f"WITH {X} SELECT id AS row_id, round(sum(v * c), 6) AS s FROM x GROUP BY id")
def tensor_to_host(spark, d):
    host = matrix(spark, d).to_numpy()
    s = host @ np.arange(1.0, DIM + 1)
    parts = (pa.table({"row_id": np.arange(a + 1, min(a + CHUNK_ROWS, len(s)) + 1), "s": s[a : a + CHUNK_ROWS]}) for a in range(0, len(s), CHUNK_ROWS))
    return sent(spark, parts).withColumn("s", rounded("s"))


@query("tensor_transfer", f"WITH {X} SELECT id AS i1, c AS i2, v FROM x")
def tensor_transfer(spark, d):
    return matrix(spark, d).to_device("executors").cells


@query("tensor_cast_float32", "SELECT l_orderkey AS i1, l_linenumber::BIGINT AS i2, round(sum(l_extendedprice::FLOAT::DOUBLE), 4) AS v FROM lineitem GROUP BY 1, 2")
def tensor_cast_float32(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i1"), F.col("l_linenumber").cast("long").alias("i2"), F.col("l_extendedprice").alias("v"))
    got = Tensor(t, (10**9, 10)).cast("float32").cells
    return got.groupBy("i1", "i2").agg(rounded(F.sum("v"), 4).alias("v"))


@query("tensor_cast_integer", "SELECT p_partkey AS i1, p_size::INT AS v FROM part")
def tensor_cast_integer(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("i1"), F.col("p_size").cast("double").alias("v"))
    return Tensor(t, (10**9,)).cast("integer").cells.select("i1", F.col("v").cast("int").alias("v"))


for _name, _how, _dim, _keep in (("sum_dim1", "sum", 1, False), ("sum_dim2", "sum", 2, False), ("sum_all", "sum", None, False), ("mean_dim1", "mean", 1, False), ("mean_dim2", "mean", 2, False), ("mean_all", "mean", None, False), ("sum_dim2_keepdim", "sum", 2, True)):
    _kept = {1: "c", 2: "id", None: "1::BIGINT"}[_dim]
    _value = "round(sum(v), 6)" if _how == "sum" else "round(avg(v), 6)"
    _sql = f"WITH {X} SELECT {_kept} AS i1{', 1::BIGINT AS i2' if _keep else ''}, {_value} AS v FROM x" + (f" GROUP BY {_kept}" if _dim else "")
    query(f"tensor_{_name}", _sql)(lambda spark, d, how=_how, dim=_dim, keep=_keep: cells(getattr(matrix(spark, d), how)(dim, keep)))


@query("tensor_sum_identity", f"WITH {X} SELECT id AS i1, c AS i2, v FROM x")
def tensor_sum_identity(spark, d):
    return matrix(spark, d).sum([]).cells


@query("tensor_broadcast_to", "SELECT r::BIGINT AS i1, p_partkey + 1 AS i2, p_retailprice AS v FROM part, range(1, 4) t(r)")
def tensor_broadcast_to(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("i1"), F.col("p_retailprice").alias("v"))
    n = p.count()
    return Tensor(p, (n,)).broadcast_to((3, n)).cells


@query("tensor_broadcast_sub", f"WITH {X}, mu AS (SELECT c, avg(v) AS m FROM x GROUP BY c) SELECT id AS i1, c AS i2, round(v - m, 6) AS v FROM x JOIN mu USING (c)")
def tensor_broadcast_sub(spark, d):
    t = matrix(spark, d)
    return cells(t - t.mean(1, keepdim=True))


@query("tensor_chain", f"WITH {X} SELECT id AS i1, c AS i2, round((v * 2 + 0.5) * (v * 2 + 0.5), 6) AS v FROM x")
def tensor_chain(spark, d):
    return cells((matrix(spark, d) * 2 + 0.5) ** 2)


@query("tensor_pow", f"WITH {X} SELECT id AS i1, c AS i2, round(pow(2.0, v), 6) AS v FROM x")
def tensor_pow(spark, d):
    return cells(2 ** matrix(spark, d))


@query("tensor_add_tensors", f"WITH {X} SELECT a.id AS i1, a.c AS i2, round(a.v + b.v * b.v, 6) AS v FROM x a JOIN x b USING (id, c)")
def tensor_add_tensors(spark, d):
    t = matrix(spark, d)
    return cells(t + t * t)


@query("tensor_neg", f"WITH {X} SELECT id AS i1, c AS i2, 0.0::DOUBLE - v AS v FROM x")
def tensor_neg(spark, d):
    return (-matrix(spark, d)).cells


IEEE_SQL = "CASE WHEN {y} <> 0 THEN CASE WHEN {x} = 0 THEN 'zero' ELSE 'finite' END WHEN {x} > 0 THEN 'inf' WHEN {x} < 0 THEN '-inf' ELSE 'nan' END"


@query("tensor_div_ieee", "SELECT kind, count(*) AS n FROM (SELECT " + IEEE_SQL.format(x="(l_linenumber - 3)", y="(l_quantity % 3)") + " AS kind FROM lineitem) GROUP BY kind")
def tensor_div_ieee(spark, d):
    t = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("i1"), (F.col("l_linenumber") - 3).cast("double").alias("a"), (F.col("l_quantity") % 3).alias("b"))
    from vecloom.functions.vector import ieee_divide

    v = t.select(ieee_divide(F.col("a"), F.col("b")).alias("v"))
    kind = F.when(F.isnan("v"), "nan").when(F.col("v") == float("inf"), "inf").when(F.col("v") == float("-inf"), "-inf").when(F.col("v") == 0, "zero").otherwise("finite")
    return v.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("tensor_reshape", f"WITH {X}, n AS (SELECT count(*) AS n FROM m), p AS (SELECT (id - 1) + (c - 1) * n AS p, v FROM x, n) SELECT p % 32 + 1 AS i1, (p // 32) % 2 + 1 AS i2, p // 64 + 1 AS i3, v FROM p")
def tensor_reshape(spark, d):
    t = matrix(spark, d)
    return t.reshape((32, 2, len(t) // 64)).cells


@query("tensor_transpose", f"WITH {X} SELECT c AS i1, id AS i2, v FROM x")
def tensor_transpose(spark, d):
    return matrix(spark, d).t().cells


@query("tensor_subset", f"WITH {X}, r AS (SELECT unnest([3, 1, 3]) AS id, unnest([1, 2, 3])::BIGINT AS i1) SELECT i1, c - 1 AS i2, v FROM x JOIN r USING (id) WHERE c BETWEEN 2 AND 4")
def tensor_subset(spark, d):
    return matrix(spark, d).subset([3, 1, 3], [2, 3, 4]).cells


@query("tensor_subset_negative", f"WITH {X} SELECT id - 2 AS i1, (c + 1) // 2 AS i2, v FROM x WHERE id > 2 AND c % 2 = 1")
def tensor_subset_negative(spark, d):
    return matrix(spark, d).subset([-1, -2], [True, False]).cells


@query("tensor_subset_drop", f"WITH {X} SELECT id AS i1, v FROM x WHERE c = 2")
def tensor_subset_drop(spark, d):
    return matrix(spark, d)[None, 2].cells


@query("tensor_replace_lastwins", f"WITH {X} SELECT id AS i1, c AS i2, CASE WHEN id = 1 AND c = 2 THEN 20 WHEN id = 3 AND c = 2 THEN 30 ELSE v END::DOUBLE AS v FROM x")
def tensor_replace_lastwins(spark, d):
    return matrix(spark, d).replace(([1, 1, 3], 2), [10, 20, 30]).cells


GRAM_SQL = f"WITH {X} SELECT a.c AS i1, b.c AS i2, round(sum(a.v * b.v), 6) AS v FROM x a JOIN x b USING (id) GROUP BY 1, 2"


@query("gram_matmul", GRAM_SQL)
def gram_matmul(spark, d):
    t = matrix(spark, d)
    return cells(t.t() @ t)


@query("matmul_block", GRAM_SQL)
def matmul_block(spark, d):
    t = matrix(spark, d)
    return cells(block_matmul(spark, t.t(), t, 256))


# Sparse matrices


@query("sparse_from_triplets", f"WITH {S} SELECT i, j, v FROM s")
def sparse_from_triplets(spark, d):
    return triplets(spark, d).entries


@query("sparse_info", f"WITH {S} SELECT max(i) AS n_rows, max(j) AS n_cols, count(*) AS nnz, round(count(*) / (max(i) * max(j)), 6) AS density FROM s")
def sparse_info(spark, d):
    told = triplets(spark, d).info()
    return spark.createDataFrame([(*told["shape"], told["nnz"], round(told["density"], 6))], "n_rows long, n_cols long, nnz long, density double")


@query("sparse_transpose", f"WITH {S} SELECT j AS i, i AS j, v FROM s")
def sparse_transpose(spark, d):
    return triplets(spark, d).t().entries


@query("sparse_csr_rows", f"WITH {S} SELECT i, string_agg(j::VARCHAR, ',' ORDER BY j) AS cols, round(sum(v), 6) AS total FROM s GROUP BY i")
def sparse_csr_rows(spark, d):
    total = F.aggregate("vals", F.lit(0.0), lambda a, x: a + x)
    return triplets(spark, d).as_csr().csr_rows().select("i", F.array_join(F.transform("cols", lambda c: c.cast("string")), ",").alias("cols"), rounded(total).alias("total"))


@query("sparse_row_pointers", f"WITH {S}, c AS (SELECT r AS i, count(s.j) AS n FROM range(1, (SELECT max(i) + 1 FROM s)) t(r) LEFT JOIN s ON s.i = r GROUP BY r) SELECT i, (sum(n) OVER (ORDER BY i) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY i))::BIGINT AS \"end\" FROM c")
def sparse_row_pointers(spark, d):
    return triplets(spark, d).row_pointers()


@query("sparse_csr_roundtrip", f"WITH {S} SELECT i, j, v FROM s")
def sparse_csr_roundtrip(spark, d):
    return triplets(spark, d).csr_rows().select("i", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("i", F.col("e.cols").alias("j"), F.col("e.vals").alias("v"))


@query("sparse_to_host", f"WITH {S} SELECT j, i, v FROM s")
def sparse_to_host(spark, d):
    """All columns in order on the driver."""
    x = triplets(spark, d)
    v, i, p = x.to_csc()

    def part(a: int) -> pa.Table:
        b = min(a + CHUNK_ROWS, len(v))
        return pa.table({"j": np.searchsorted(p, np.arange(a, b), "right"), "i": i[a:b].astype(np.int64) + 1, "v": v[a:b]})

    return sent(spark, map(part, range(0, max(len(v), 1), CHUNK_ROWS)))


@query("sparse_to_dense", f"WITH {S} SELECT r AS i1, c AS i2, coalesce(v, 0.0) AS v FROM range(1, (SELECT max(i) + 1 FROM s)) a(r) CROSS JOIN range(1, (SELECT max(j) + 1 FROM s)) b(c) LEFT JOIN s ON s.i = r AND s.j = c")
def sparse_to_dense(spark, d):
    return triplets(spark, d).to_tensor().cells


@query("sparse_row_sums", f"WITH {S} SELECT r AS i1, round(coalesce(sum(v), 0), 6) AS v FROM range(1, (SELECT max(i) + 1 FROM s)) t(r) LEFT JOIN s ON s.i = r GROUP BY r")
def sparse_row_sums(spark, d):
    return cells(triplets(spark, d).row_sums())


@query("sparse_col_sums", f"WITH {S} SELECT r AS i1, round(coalesce(sum(v), 0), 6) AS v FROM range(1, (SELECT max(j) + 1 FROM s)) t(r) LEFT JOIN s ON s.j = r GROUP BY r")
def sparse_col_sums(spark, d):
    return cells(triplets(spark, d).col_sums())


@query("sparse_normalize_rows", f"WITH {S} SELECT i, j, round(v * 100 / sum(v) OVER (PARTITION BY i), 6) AS v FROM s")
def sparse_normalize_rows(spark, d):
    return triplets(spark, d).normalize("rows", 100).entries.withColumn("v", rounded("v"))


@query("sparse_normalize_cols_log1p", f"WITH {S} SELECT i, j, round(ln(1 + v * 10 / sum(v) OVER (PARTITION BY j)), 6) AS v FROM s")
def sparse_normalize_cols_log1p(spark, d):
    return triplets(spark, d).normalize("columns", 10, True).entries.withColumn("v", rounded("v"))


@query("sparse_matvec", f"WITH {S} SELECT r AS i1, round(coalesce(sum(v * (j % 5)), 0), 4) AS v FROM range(1, (SELECT max(i) + 1 FROM s)) t(r) LEFT JOIN s ON s.i = r GROUP BY r")
def sparse_matvec(spark, d):
    x = triplets(spark, d)
    return cells(x.matvec(np.arange(1, x.shape[1] + 1) % 5), 4)


@query("sparse_matmul_dense", f"WITH {S} SELECT i AS i1, 1::BIGINT AS i2, round(sum(v * p_retailprice), 3) AS v FROM s JOIN part ON p_partkey + 1 = j GROUP BY i UNION ALL SELECT i, 2, round(sum(v * p_size), 3) FROM s JOIN part ON p_partkey + 1 = j GROUP BY i")
def sparse_matmul_dense(spark, d):
    x = triplets(spark, d)
    p = rows_from_columns(table(spark, d, "part").withColumn("k", F.col("p_partkey") + 1), "k", ["p_retailprice", "p_size"])
    return cells(x.matmul(tensor_of_rows(p, x.shape[1], 2)), 3)


@query("sparse_constant_columns", f"WITH {S} SELECT j FROM s GROUP BY j HAVING sum(v * v) - sum(v) * sum(v) / (SELECT max(i) FROM s) <= 2.220446049250313e-16 * greatest(sum(v * v), 1)")
def sparse_constant_columns(spark, d):
    x = triplets(spark, d)
    return x.constant_columns().join(x.entries.select("j").distinct(), "j")


def _events(spark: SparkSession, d: str) -> Sparse:
    """Values by user and event type."""
    e = table(spark, d, "events")
    order = e.select("event_type").distinct().withColumn("j", F.row_number().over(Window.orderBy("event_type")))  # a handful of types
    users = e.groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return sparse(spark, users.join(F.broadcast(order), "event_type").select((F.col("user_id") + 1).alias("i"), "j", F.round("v", 3).alias("v")))


E_SQL = "o AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS j FROM (SELECT DISTINCT event_type FROM events)), s AS (SELECT user_id + 1 AS i, j, round(sum(value), 3) AS v FROM events JOIN o USING (event_type) GROUP BY 1, 2)"
E_DENSE = E_SQL + ", x AS (SELECT r AS id, c, coalesce(v, 0.0) AS v FROM range(1, (SELECT max(i) + 1 FROM s)) a(r) CROSS JOIN range(1, 6) b(c) LEFT JOIN s ON s.i = r AND s.j = c)"


@query("sparse_knn", f"WITH {E_DENSE}, p AS (SELECT a.id AS q, b.id AS r, sqrt(sum((a.v - b.v) ** 2)) AS d FROM x a JOIN x b USING (c) WHERE a.id <> b.id GROUP BY 1, 2) SELECT q AS row_id, rk::INT AS rank, r AS neighbor_id, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 7), r) AS rk FROM p) WHERE rk <= 3")
def sparse_knn(spark, d):
    return neighbors.sparse_knn(spark, _events(spark, d), 3).rows.select("row_id", "rank", "neighbor_id", rounded("distance", 5).alias("distance"))


@query("sparse_covariance", f"WITH {E_DENSE} SELECT a.c AS i, b.c AS j, round(covar_samp(a.v, b.v), 3) AS v FROM x a JOIN x b USING (id) GROUP BY 1, 2")
def sparse_covariance(spark, d):
    return linalg.sparse_covariance(_events(spark, d)).withColumn("v", rounded("v", 3))


@query("sparse_pca_total_variance", f"WITH {E_DENSE} SELECT round(sum(s), 3) AS total FROM (SELECT var_samp(v) AS s FROM x GROUP BY c)")
def sparse_pca_total_variance(spark, d):
    model = linalg.pca(spark, _events(spark, d), 5)
    return spark.createDataFrame([(float((model.sdev**2).sum()),)], "total double").withColumn("total", rounded("total", 3))


# Linear algebra


@query("column_stats_center_scale", f"WITH {X} SELECT c AS col, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(sqrt(sum(v * v) / (count(*) - 1)), 6) AS rms, min(v) AS low, max(v) AS high FROM x GROUP BY c")
def column_stats_center_scale(spark, d):
    s = linalg.column_stats(rows(spark, d), DIM)
    return s.select(F.col("col").cast("long").alias("col"), rounded("mean").alias("mean"), rounded("sd").alias("sd"), rounded("rms").alias("rms"), "low", "high")


@query("covariance", f"WITH {X} SELECT a.c AS i1, b.c AS i2, round(covar_samp(a.v, b.v), 6) AS v FROM x a JOIN x b USING (id) GROUP BY 1, 2")
def covariance(spark, d):
    t = matrix(spark, d)
    c = t - t.mean(1, keepdim=True)
    return cells((c.t() @ c) / (t.shape[0] - 1))


@query("pca_total_variance", f"WITH {X} SELECT round(sum(s), 6) AS total FROM (SELECT var_samp(v) AS s FROM x GROUP BY c)")
def pca_total_variance(spark, d):
    model = linalg.pca(spark, rows(spark, d), DIM)
    return spark.createDataFrame([(float((model.sdev**2).sum()),)], "total double").withColumn("total", rounded("total"))


@query("svd_frobenius", f"WITH {X} SELECT round(sum(v * v), 6) AS total FROM x")
def svd_frobenius(spark, d):
    found = linalg.svd(spark, rows(spark, d))
    return spark.createDataFrame([(float((found.d**2).sum()),)], "total double").withColumn("total", rounded("total"))


@query("svd_reconstruction", f"WITH {X} SELECT id AS row_id, c AS col, round(v, 6) AS v FROM x")
def svd_reconstruction(spark, d):
    """U diag(d) V' gives the matrix back."""
    found = linalg.svd(spark, rows(spark, d))
    back = linalg.project(found.u, (found.v * found.d).T)
    return back.select("row_id", F.posexplode("features").alias("p", "v")).select("row_id", (F.col("p") + 1).cast("long").alias("col"), rounded("v").alias("v"))


FIXED = np.round(np.sin(np.arange(1, DIM * 2 + 1)), 4).reshape(DIM, 2)


@query("pca_predict_fixed_rotation", f"WITH {X}, r AS (SELECT c::BIGINT AS c, round(sin(2 * c - 1), 4) AS a, round(sin(2 * c), 4) AS b FROM range(1, 65) t(c)) SELECT id AS row_id, round(sum((v - 0.01) / 2 * a), 5) AS a, round(sum((v - 0.01) / 2 * b), 5) AS b FROM x JOIN r USING (c) GROUP BY id")
def pca_predict_fixed_rotation(spark, d):
    model = linalg.Pca(np.ones(2), FIXED, None, np.full(DIM, 0.01), np.full(DIM, 2.0))
    got = linalg.predict_pca(model, rows(spark, d))
    return got.select("row_id", rounded(F.col("features")[0], 5).alias("a"), rounded(F.col("features")[1], 5).alias("b"))


@query("pca_scores")
def pca_scores(spark, d):
    return linalg.pca(spark, rows(spark, d), 5).scores


@query("svd_u")
def svd_u(spark, d):
    return linalg.svd(spark, rows(spark, d), 5, 5).u


# k-means

C0 = "c0 AS (SELECT id AS k, c, v FROM x WHERE id <= 4)"


def _rounds(n: int) -> str:
    """n updates and reassignments from the first four rows, as common table expressions."""
    out = [C0]
    near = "a{n} AS (SELECT id, arg_min(k, (d, k)) AS k FROM (SELECT x.id, c{n}.k, sum((x.v - c{n}.v) ** 2) AS d FROM x JOIN c{n} USING (c) GROUP BY 1, 2) GROUP BY 1)"
    out.append(near.format(n=0))
    for t in range(1, n + 1):
        out.append(f"c{t} AS (SELECT k, c, coalesce(n.v, o.v) AS v FROM c{t - 1} o LEFT JOIN (SELECT k, c, avg(v) AS v FROM x JOIN a{t - 1} USING (id) GROUP BY 1, 2) n USING (k, c))")
        out.append(near.format(n=t))
    return ", ".join(out)


def _start(spark, d) -> np.ndarray:
    return np.array([r["features"] for r in rows(spark, d).where("row_id <= 4").orderBy("row_id").collect()])


@query("kmeans_assign", f"WITH {X}, {_rounds(0)} SELECT id AS row_id, k::INT AS cluster FROM a0")
def kmeans_assign(spark, d):
    model = cluster.KMeans(None, _start(spark, d), np.zeros(4), 0.0, 0, False)
    return cluster.predict_kmeans(model, rows(spark, d))


@query("kmeans_iterations", f"WITH {X}, {_rounds(3)} SELECT id AS row_id, k::INT AS cluster FROM a3")
def kmeans_iterations(spark, d):
    return cluster.kmeans(spark, rows(spark, d), _start(spark, d), iter_max=3, tolerance=0).assignments


@query("kmeans_centers", f"WITH {X}, {_rounds(3)} SELECT k::INT AS cluster, c AS col, round(v, 6) AS v FROM c3")
def kmeans_centers(spark, d):
    model = cluster.kmeans(spark, rows(spark, d), _start(spark, d), iter_max=3, tolerance=0)
    flat = [(k + 1, c + 1, float(v)) for k, row in enumerate(model.centers) for c, v in enumerate(row)]
    return spark.createDataFrame(flat, "cluster int, col long, v double").withColumn("v", rounded("v"))


@query("kmeans_withinss", f"WITH {X}, {_rounds(3)} SELECT k::INT AS cluster, round(sum((x.v - c3.v) ** 2), 5) AS withinss FROM x JOIN a3 USING (id) JOIN c3 USING (k, c) GROUP BY k")
def kmeans_withinss(spark, d):
    model = cluster.kmeans(spark, rows(spark, d), _start(spark, d), iter_max=3, tolerance=0)
    return spark.createDataFrame([(k + 1, float(w)) for k, w in enumerate(model.withinss)], "cluster int, withinss double").withColumn("withinss", rounded("withinss", 5))


@query("kmeans_predict_distance", f"WITH {X}, {C0} SELECT x.id AS row_id, c0.k::INT AS cluster, round(sqrt(sum((x.v - c0.v) ** 2)), 6) AS distance FROM x JOIN c0 USING (c) GROUP BY 1, 2")
def kmeans_predict_distance(spark, d):
    model = cluster.KMeans(None, _start(spark, d), np.zeros(4), 0.0, 0, False)
    return cluster.predict_kmeans(model, rows(spark, d), "distance").withColumn("distance", rounded("distance"))


@query("kmeans_seeded")
def kmeans_seeded(spark, d):
    return cluster.kmeans(spark, rows(spark, d), 6, iter_max=10, seed=7).assignments


# Graphs

W_SQL = {"binary": "1.0::DOUBLE", "distance": "1 / (1 + d)", "gaussian": "exp(-d * d / (2 * sg * sg))"}


def _graph(spark, d, weighting="distance", symmetrize="union"):
    return graph.knn_graph(spark, neighbors.knn(spark, rows(spark, d), 5), weighting, symmetrize)


for _w, _e in W_SQL.items():
    for _s in graph.SYMMETRIES:
        _sql = f"WITH {K}, g AS (SELECT median(d) AS sg FROM k WHERE d > 0), w AS (SELECT least(q, r) AS src, greatest(q, r) AS dst, {_e} AS w, q < r AS f FROM k, g) SELECT src, dst, round(max(w), 6) AS weight FROM w GROUP BY 1, 2" + (" HAVING bool_or(f) AND bool_or(NOT f)" if _s == "mutual" else "")
        query(f"knn_graph_{_s}_{_w}", _sql)(lambda spark, d, w=_w, s=_s: _graph(spark, d, w, s).edges.withColumn("weight", rounded("weight")))

EDGES = f"{K}, e AS (SELECT least(q, r) AS src, greatest(q, r) AS dst, max(1 / (1 + d)) AS w FROM k GROUP BY 1, 2)"


@query("adjacency_symmetric", f"WITH {EDGES} SELECT src, dst, round(w, 6) AS weight FROM e UNION ALL SELECT dst, src, round(w, 6) FROM e")
def adjacency_symmetric(spark, d):
    return _graph(spark, d).adjacency().withColumn("weight", rounded("weight"))


@query("modularity_by_label", f"WITH {EDGES}, l AS (SELECT e.w, a.label AS x, b.label AS y FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst), t AS (SELECT sum(w) AS t FROM l), deg AS (SELECT c, sum(w) AS k FROM (SELECT x AS c, w FROM l UNION ALL SELECT y, w FROM l) GROUP BY c), own AS (SELECT x AS c, sum(w) AS i FROM l WHERE x = y GROUP BY x) SELECT round(sum(coalesce(i, 0) / t - 1.0 * (k / (2 * t)) ** 2), 6) AS modularity FROM deg LEFT JOIN own USING (c), t")
def modularity_by_label(spark, d):
    labels = table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("vertex_id"), F.col("label").alias("community"))
    return graph.modularity(_graph(spark, d).edges, labels).withColumn("modularity", rounded("modularity"))


@query("louvain")
def louvain(spark, d):
    return graph.louvain(spark, _graph(spark, d)).membership


@query("leiden")
def leiden(spark, d):
    return graph.leiden(spark, _graph(spark, d)).membership


# Embeddings

KERNEL = f"{P}, g AS (SELECT median(d) AS sg FROM p WHERE d > 0), w AS (SELECT q, r, exp(-d * d / (2 * sg * sg)) AS w FROM p, g), dg AS (SELECT q, sum(w) AS dg FROM w GROUP BY q)"


@query("diffusion_kernel_degree", f"WITH {KERNEL} SELECT q AS row_id, round(dg, 5) AS degree FROM dg")
def diffusion_kernel_degree(spark, d):
    return embed.diffusion_kernel(spark, rows(spark, d))[1].withColumn("degree", rounded("degree", 5))


@query("diffusion_normalized_kernel", f"WITH {KERNEL} SELECT w.q AS row_id, r AS col_id, round(w / sqrt(a.dg * b.dg), 8) AS w FROM w JOIN dg a ON a.q = w.q JOIN dg b ON b.q = w.r")
def diffusion_normalized_kernel(spark, d):
    """The matrix whose eigenvectors are the map."""
    return embed.diffusion_matrix(spark, rows(spark, d)).withColumn("w", rounded("w", 8))


@query("diffusion_map")
def diffusion_map(spark, d):
    return embed.embedding_coordinates(embed.diffusion_map(spark, rows(spark, d), 3))


@query("tsne")
def tsne(spark, d):
    return embed.embedding_coordinates(embed.tsne(spark, rows(spark, d), perplexity=20, seed=1, iterations=250))


@query("umap")
def umap(spark, d):
    return embed.embedding_coordinates(embed.umap(spark, rows(spark, d), seed=1, n_epochs=100))


# Provenance


@query("provenance_stages", "SELECT * FROM (VALUES ('distance', 'auto', 'executors', 'sql', 'first_eligible', false, 'executors'), ('neighbor_selection', 'auto', 'executors', 'sql', 'first_eligible', false, 'executors')) t(stage, requested_device, device, backend, selection_reason, fallback, output_device)")
def provenance_stages(spark, d):
    return prov.provenance_frame(spark, neighbors.knn(spark, rows(spark, d), 5))


@query("pca_knn_flow")
def pca_knn_flow(spark, d):
    """Principal components, then exact neighbours of the scores."""
    return neighbors.knn(spark, linalg.pca(spark, rows(spark, d), 20).scores, 15, strategy="block").rows


@query("sparse_flow")
def sparse_flow(spark, d):
    """Normalise, principal components, exact neighbours."""
    return neighbors.knn(spark, linalg.pca(spark, _events(spark, d).normalize("rows", 1000, True), 4).scores, 5, strategy="block").rows


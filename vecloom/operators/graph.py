"""Graphs from nearest neighbours, communities and modularity.

A graph is an edge table (src < dst, weight) and a vertex table (vertex_id).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.neighbors import Knn
from vecloom.plans import provenance as prov

WEIGHTINGS = ("binary", "distance", "gaussian")
SYMMETRIES = ("union", "mutual")
#: Edges up to which communities are finished on the driver; larger graphs are first coarsened on the executors.
DRIVER_EDGES = 2_000_000


@dataclass
class Graph:
    edges: DataFrame
    vertices: DataFrame
    weighting: str
    symmetrize: str
    parameters: dict
    stages: dict[str, prov.Stage] = field(default_factory=lambda: {"graph_assembly": prov.stage(backend="sql")})
    provenance_schema: str = prov.SCHEMA

    def adjacency(self) -> DataFrame:
        """src, dst, weight with every edge in both directions."""
        return self.edges.select("src", "dst", "weight").union(self.edges.select(F.col("dst"), F.col("src"), "weight"))

    def __repr__(self) -> str:
        return f"<Graph: {self.weighting} weights, {self.symmetrize}>"


@dataclass
class Communities:
    membership: DataFrame
    communities: int
    modularity: float
    algorithm: str
    resolution: float
    stages: dict[str, prov.Stage] = field(default_factory=lambda: {"community_detection": prov.stage("driver", "local")})
    provenance_schema: str = prov.SCHEMA

    def __repr__(self) -> str:
        return f"<Communities: {self.communities} by {self.algorithm}, modularity {self.modularity:.4f}>"


def check_neighbors(rows: DataFrame, vertices: DataFrame) -> None:
    """Valid, distinct neighbours without self-links; finite distances of 0 or more."""
    d = F.col("distance")
    bad = d.isNull() | F.isnan(d) | (d < 0) | (d == float("inf"))
    got = rows.agg(F.count("*").alias("n"), F.max(bad.cast("int")).alias("bad"), F.max((F.col("row_id") == F.col("neighbor_id")).cast("int")).alias("own"), F.max((F.col("row_id").isNull() | F.col("neighbor_id").isNull()).cast("int")).alias("none")).head()
    if got["n"] == 0 or got["bad"]:
        raise ValueError("Indices and distances must be same-sized matrices with finite, non-negative distances.")
    if got["own"]:
        raise ValueError("A row is no neighbour of itself.")
    known = vertices.select(F.col("vertex_id").alias("neighbor_id"))
    if got["none"] or not rows.select("neighbor_id").join(known, "neighbor_id", "left_anti").isEmpty():
        raise ValueError("Nearest-neighbour indices must be valid graph vertices.")
    if not rows.groupBy("row_id", "neighbor_id").count().where("count > 1").isEmpty():
        raise ValueError("A row must not contain duplicate neighbours.")


def _positive(x, name: str) -> float:
    if isinstance(x, bool) or not np.isscalar(x) or not np.isfinite(x) or x <= 0:
        raise ValueError(f"`{name}` must be a positive finite number.")
    return float(x)


def weights(d: Column, weighting: str, sigma: float | None) -> Column:
    if weighting == "binary":
        return F.lit(1.0)
    if weighting == "distance":
        return 1 / (1 + d)
    return F.exp(-(d * d) / F.lit(2 * sigma * sigma))


def knn_graph(spark: SparkSession, neighbors: Knn | DataFrame, weighting: str = "binary", symmetrize: str = "union", sigma: float | None = None) -> Graph:
    """Undirected edges seen in either direction, or in both; of two weights the larger."""
    if weighting not in WEIGHTINGS or symmetrize not in SYMMETRIES:
        raise ValueError("Unknown weighting or symmetrize.")
    # The checks and the median read the neighbours again, which cost far more than they weigh.
    rows = (neighbors.rows if isinstance(neighbors, Knn) else neighbors).select("row_id", "neighbor_id", "distance").persist()
    vertices = rows.select(F.col("row_id").alias("vertex_id")).distinct()
    check_neighbors(rows, vertices)
    if weighting == "gaussian":
        if sigma is None:
            sigma = rows.where("distance > 0").agg(F.median("distance")).head()[0] or 1.0
        sigma = _positive(sigma, "sigma")
    a, b = F.col("row_id"), F.col("neighbor_id")
    seen = rows.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), weights(F.col("distance"), weighting, sigma).alias("w"), (a < b).alias("up"))
    edges = seen.groupBy("src", "dst").agg(F.max("w").alias("weight"), F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down"))
    if symmetrize == "mutual":
        edges = edges.where("up and down")
    return Graph(edges.select("src", "dst", "weight"), vertices, weighting, symmetrize, {"weighting": weighting, "symmetrize": symmetrize, "sigma": sigma if weighting == "gaussian" else None})


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the weighted modularity of vertex_id, community; 0 for a graph without edges."""
    a, b = membership.toDF("src", "c_src"), membership.toDF("dst", "c_dst")
    placed = edges.join(a, "src").join(b, "dst")
    inner = placed.where("c_src = c_dst").groupBy(F.col("c_src").alias("community")).agg(F.sum("weight").alias("own"))
    ends = placed.select(F.col("c_src").alias("community"), "weight").union(placed.select("c_dst", "weight"))
    degree = ends.groupBy("community").agg(F.sum("weight").alias("degree"))
    total = edges.agg(F.sum("weight").alias("m"))  # one row
    parts = degree.join(inner, "community", "left").crossJoin(F.broadcast(total))
    q = F.sum(F.coalesce("own", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2.0)))
    return parts.agg(F.coalesce(q, F.lit(0.0)).alias("modularity"))


class _Local:
    """A weighted graph on the driver in CSR form; loops hold the weight inside a merged vertex."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, loops: np.ndarray | None = None):
        self.n, self.loops = n, np.zeros(n) if loops is None else loops
        i, j, v = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
        order = np.lexsort((j, i))
        self.nbr, self.w = j[order], v[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n))])
        self.degree = np.bincount(i, v, n) + 2 * self.loops
        self.total = self.degree.sum() / 2

    def move(self, community: np.ndarray, resolution: float, within: np.ndarray | None = None) -> bool:
        """Local moving until nothing improves; `within` confines moves to one class (refinement, singletons only)."""
        if self.total == 0:
            return False
        sums = np.bincount(community, self.degree, self.n)
        sizes = np.bincount(community, minlength=self.n)
        queue, waiting, changed = list(range(self.n)), np.ones(self.n, bool), False
        while queue:
            later = []
            for v in queue:
                waiting[v] = False
                own = community[v]
                if within is not None and sizes[own] > 1:
                    continue
                near: dict[int, float] = {}
                for e in range(self.at[v], self.at[v + 1]):
                    u = self.nbr[e]
                    if u != v and (within is None or within[u] == within[v]):
                        near[community[u]] = near.get(community[u], 0.0) + self.w[e]
                k = self.degree[v]
                gain = lambda c, inside: inside - resolution * k * (sums[c] - (k if c == own else 0)) / (2 * self.total)  # noqa: B023, E731
                best, best_gain = own, gain(own, near.get(own, 0.0))
                for c in sorted(near):
                    g = gain(c, near[c])
                    if g > best_gain + 1e-12:
                        best, best_gain = c, g
                if best != own:
                    changed = True
                    sums[own] -= k
                    sums[best] += k
                    sizes[own] -= 1
                    sizes[best] += 1
                    community[v] = best
                    for e in range(self.at[v], self.at[v + 1]):
                        u = self.nbr[e]
                        if community[u] != best and not waiting[u]:
                            waiting[u] = True
                            later.append(u)
            queue = later if within is None else []
        return changed

    def merged(self, label: np.ndarray) -> _Local:
        """One vertex for each label (0 to n - 1)."""
        i = np.repeat(np.arange(self.n), np.diff(self.at))
        up = i < self.nbr
        a, b, w = label[i[up]], label[self.nbr[up]], self.w[up]
        n = int(label.max()) + 1
        loops = np.bincount(label, self.loops, n) + np.bincount(a[a == b], w[a == b], n)
        lo, hi, w = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b], w[a != b]
        key, at = np.unique(lo * n + hi, return_inverse=True)
        return _Local(n, key // n, key % n, np.bincount(at, w, len(key)), loops)


def louvain_labels(graph: _Local, resolution: float) -> np.ndarray:
    label = np.arange(graph.n)
    while True:
        community = np.arange(graph.n)
        if not graph.move(community, resolution):
            return label
        _, community = np.unique(community, return_inverse=True)
        label, graph = community[label], graph.merged(community)


def leiden_labels(graph: _Local, resolution: float, iterations: int) -> np.ndarray:
    """Local moving, refinement inside each community, merging by the refined parts; so communities stay connected."""
    result = np.arange(graph.n)
    for _ in range(iterations):
        level, label, community = graph, np.arange(graph.n), result.copy()
        while True:
            _, community = np.unique(community, return_inverse=True)
            level.move(community, resolution)
            _, community = np.unique(community, return_inverse=True)
            if community.max() + 1 == level.n:
                break
            refined = np.arange(level.n)
            level.move(refined, resolution, within=community)
            _, refined = np.unique(refined, return_inverse=True)
            if refined.max() + 1 == level.n:
                refined = community
            up = np.zeros(refined.max() + 1, int)
            up[refined] = community
            label, level, community = refined[label], level.merged(refined), up
            if level.n == community.max() + 1:
                level.move(community, resolution)
                break
        result = community[label]
    return _connected(graph, np.unique(result, return_inverse=True)[1])


def _connected(graph: _Local, label: np.ndarray) -> np.ndarray:
    """Communities split into their connected parts."""
    out, n = np.full(graph.n, -1), 0
    for v in range(graph.n):
        if out[v] < 0:
            stack, out[v] = [v], n
            while stack:
                a = stack.pop()
                for e in range(graph.at[a], graph.at[a + 1]):
                    u = graph.nbr[e]
                    if out[u] < 0 and label[u] == label[a]:
                        out[u] = n
                        stack.append(u)
            n += 1
    return out


def _coarsened(spark: SparkSession, edges: DataFrame, vertices: DataFrame, resolution: float, rounds: int = 6) -> DataFrame:
    """vertex_id, part after rounds of moves on the executors: in each, a hashed half of the vertices joins its best neighbouring part."""
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).persist()
    degree = both.groupBy(F.col("src").alias("vertex_id")).agg(F.sum("weight").alias("k")).persist()
    total = degree.agg(F.sum("k")).head()[0] / 2
    label = vertices.select("vertex_id", F.col("vertex_id").alias("part"))
    for t in range(rounds):
        sums = label.join(degree, "vertex_id").groupBy("part").agg(F.sum("k").alias("tot"))
        near = both.join(label.toDF("dst", "part"), "dst").groupBy(F.col("src").alias("vertex_id"), "part").agg(F.sum("weight").alias("inside"))
        own = label.toDF("vertex_id", "own")
        gain = F.col("inside") - resolution * F.col("k") * (F.col("tot") - F.when(F.col("part") == F.col("own"), F.col("k")).otherwise(0.0)) / (2 * total)
        best = near.join(sums, "part").join(degree, "vertex_id").join(own, "vertex_id").groupBy("vertex_id").agg(F.max(F.struct(gain.alias("g"), (-F.col("part")).alias("p"))).alias("b"))
        moves = F.pmod(F.xxhash64("vertex_id", F.lit(t)), F.lit(2)) == 0
        label = label.join(best, "vertex_id", "left").select("vertex_id", F.when(moves & F.col("b").isNotNull(), -F.col("b.p")).otherwise(F.col("part")).alias("part"))
        label = label.checkpoint() if not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty() else label.persist()
    return label


def _communities(spark: SparkSession, graph: Graph, algorithm: str, resolution: float, find) -> Communities:
    resolution = _positive(resolution, "resolution")
    edges, coarse = graph.edges, None
    stages = {"community_detection": prov.stage("driver", "local")}
    if edges.count() > DRIVER_EDGES:
        coarse = _coarsened(spark, edges, graph.vertices, resolution)
        a, b = coarse.toDF("src", "a"), coarse.toDF("dst", "b")
        edges = edges.join(a, "src").join(b, "dst").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))
        stages = {"coarsening": prov.stage(backend="sql"), **stages}
    got = edges.toPandas().sort_values(["src", "dst"])
    ids = np.unique(np.concatenate([(coarse.select("part").distinct() if coarse is not None else graph.vertices).toPandas().iloc[:, 0].to_numpy(), got["src"], got["dst"]]).astype(np.int64))
    src, dst, w = np.searchsorted(ids, got["src"]), np.searchsorted(ids, got["dst"]), got["weight"].to_numpy(float)
    loop = src == dst
    label = find(_Local(len(ids), src[~loop], dst[~loop], w[~loop], np.bincount(src[loop], w[loop], len(ids))), resolution)
    order = {c: k + 1 for k, c in enumerate(dict.fromkeys(label.tolist()))}
    import pandas as pd

    found = spark.createDataFrame(pd.DataFrame({"vertex_id": ids, "community": np.array([order[c] for c in label.tolist()], np.int32)}), "vertex_id long, community int")
    if coarse is not None:
        found = coarse.join(found.withColumnRenamed("vertex_id", "part"), "part").select("vertex_id", "community")
    return Communities(found, len(order), float(modularity(graph.edges, found, resolution).head()[0]), algorithm, resolution, stages)


def louvain(spark: SparkSession, graph: Graph, resolution: float = 1.0) -> Communities:
    return _communities(spark, graph, "louvain", resolution, louvain_labels)


def leiden(spark: SparkSession, graph: Graph, resolution: float = 1.0, n_iterations: int = 2) -> Communities:
    if isinstance(n_iterations, bool) or not np.isscalar(n_iterations) or int(n_iterations) != n_iterations or n_iterations < 1:
        raise ValueError("Leiden needs a whole number of rounds, 1 or more.")
    return _communities(spark, graph, "leiden", resolution, lambda g, r: leiden_labels(g, r, int(n_iterations)))

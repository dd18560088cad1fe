import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import cluster, embed, graph, linalg, neighbors
from vecloom.operators.sparse import sparse
from vecloom.plans import provenance as prov
from vecloom.plans import strategy
from vecloom.plans.selftest import selftest

T = np.array([[1.0, 2, 3], [2, 3, 4], [4, 2, 1], [5, 3, 2], [8, 7, 9], [9, 8, 8]])


def rows(spark, x, parts=2):
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    return spark.createDataFrame([(i + 1, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>").repartition(parts)


def answer(found):
    got = found.rows.orderBy("row_id", "rank").collect()
    return [r["neighbor_id"] for r in got], [r["distance"] for r in got]


@pytest.mark.parametrize("how", ["sql", "block"])
def test_knn_ties_and_offsets(spark, how):
    assert answer(neighbors.knn(spark, rows(spark, [0, 2, 4]), 1, strategy=how)) == ([2, 1, 2], [2, 2, 2])
    assert answer(neighbors.knn(spark, rows(spark, [0, 0, 1]), 1, strategy=how))[0] == [2, 1, 1]
    ids, d = answer(neighbors.knn(spark, rows(spark, 1e8 + np.array([0, 0.9, 1])), 1, strategy=how))
    assert ids == [2, 3, 2] and np.allclose(d, [0.9, 0.1, 0.1], atol=1e-7)
    points = [[0, 0], [1, 0], [-1, 0], [0, 1], [0, -1], [1, 0]]
    assert answer(neighbors.knn(spark, rows(spark, points), 4, strategy=how))[0][:4] == [2, 3, 4, 5]
    with pytest.raises(ValueError, match="neighbours"):
        neighbors.knn(spark, rows(spark, [0, 1]), 2, strategy=how)


@pytest.mark.parametrize("metric", neighbors.METRICS)
def test_strategies_agree(spark, metric):
    x = np.random.default_rng(4).normal(size=(90, 6))
    x[[8, 19]] = x[3]
    a, b = (answer(neighbors.knn(spark, rows(spark, x, p), 7, metric, strategy=s)) for s, p in (("sql", 1), ("block", 3)))
    assert a[0] == b[0] and np.allclose(a[1], b[1], atol=1e-12)
    d = [r["distance"] for r in neighbors.distance(spark, rows(spark, x[:9]), rows(spark, x[9:14]), metric, strategy="block", batch_size=3).orderBy("row_id", "col_id").collect()]
    e = [r["distance"] for r in neighbors.distance(spark, rows(spark, x[:9]), rows(spark, x[9:14]), metric, strategy="sql").orderBy("row_id", "col_id").collect()]
    assert np.allclose(d, e, atol=1e-12)


@pytest.mark.parametrize("how", ["sql", "block"])
def test_distance_scales(spark, how):
    get = lambda x, y, **k: [r["distance"] for r in neighbors.distance(spark, rows(spark, x), rows(spark, y), strategy=how, **k).orderBy("row_id", "col_id").collect()]
    assert np.allclose(get([[1, 2, 3]], [[1, 2, 4], [3, 2, 1]]), [1, np.sqrt(8)])
    assert np.allclose(get([[1e300, 0]], [[0, 1e300]]), [np.sqrt(2) * 1e300])
    assert np.allclose(get([[1e-300, 0]], [[0, 1e-300]]), [np.sqrt(2) * 1e-300], rtol=1e-12, atol=0)
    big = np.finfo(float).max
    far = get([[-big, 0], [1e-300, 1e-300]], [[big, 0], [0, 0]])
    assert far[0] == np.inf and np.isclose(far[3], np.sqrt(2) * 1e-300, atol=0)
    assert np.isclose(get([[1e300, 1e300]], [[1e-300, 0]], metric="cosine")[0], 1 - 1 / np.sqrt(2))
    with pytest.raises(ValueError, match="no direction"):
        get([[0, 0]], [[1, 1]], metric="cosine")
    with pytest.raises(ValueError, match="equally many columns"):
        get([[0, 0]], [[1]])


def test_top_k():
    d = np.array([[0, 1, 1, 2, np.inf, 1], [2, 0, -0.0, 2, 2, 2], [np.inf, 4, 0, 4, 3, 3]])
    assert neighbors.top_k(d, np.arange(1, 7), np.array([1, 2, 3]), 4)[1][0].tolist() == [2, 3, 6, 4]
    with pytest.raises(ValueError, match="NaN"):
        neighbors.top_k(np.array([[np.nan]]), np.array([1]), np.array([2]), 1)


@pytest.mark.parametrize("wide", [4096, 1])
def test_sparse_knn(spark, wide, monkeypatch):
    monkeypatch.setattr(neighbors, "WIDE", wide)
    x = np.random.default_rng(2).poisson(0.6, (30, 5)).astype(float)
    got, want = answer(neighbors.sparse_knn(spark, sparse(spark, x, (30, 5)), 4)), answer(neighbors.knn(spark, rows(spark, x), 4))
    assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_svd_and_pca(spark):
    found = linalg.svd(spark, rows(spark, T))
    u = np.array([r["features"] for r in found.u.orderBy("row_id").collect()])
    assert np.allclose(u @ np.diag(found.d) @ found.v.T, T, atol=1e-10)
    wide = linalg.svd(spark, rows(spark, T[:2]))
    assert len(wide.d) == 2 and np.allclose(wide.d, np.linalg.svd(T[:2])[1])
    for scale in (False, True):
        model = linalg.pca(spark, rows(spark, T, 3), 2, scale=scale)
        z = (T - T.mean(0)) / (T.std(0, ddof=1) if scale else 1)
        _, d, vt = np.linalg.svd(z, full_matrices=False)
        assert np.allclose(model.sdev, d[:2] / np.sqrt(5)) and np.allclose(model.rotation @ model.rotation.T, vt[:2].T @ vt[:2], atol=1e-8)
        again = linalg.predict_pca(model, rows(spark, T)).orderBy("row_id").collect()
        assert np.allclose([r["features"] for r in again], [r["features"] for r in model.scores.orderBy("row_id").collect()])
    rms = linalg.pca(spark, rows(spark, T), 1, center=False, scale=True)
    assert np.allclose(rms.scale, np.sqrt((T**2).sum(0) / 5))
    with pytest.raises(ValueError, match="constant column"):
        linalg.pca(spark, rows(spark, np.column_stack([np.arange(4), np.ones(4)])), 1, scale=True)
    with pytest.raises(ValueError, match="components"):
        linalg.pca(spark, rows(spark, T), 4)
    cov = {(r["i"], r["j"]): r["v"] for r in linalg.sparse_covariance(sparse(spark, T)).collect()}
    assert np.allclose([[cov[i, j] for j in (1, 2, 3)] for i in (1, 2, 3)], np.cov(T.T))


def test_feature_alignment():
    assert linalg.aligned_features(["b", "a"], ["a", "b"], 2) == [1, 0]
    for columns, message in ((["a", "c"], "lacking .'b'., unknown .'c'."), (None, "must name its columns"), (["a"], "lacking"), (["a", "a"], "repeated")):
        with pytest.raises(ValueError, match=message):
            linalg.aligned_features(columns, ["a", "b"], 2)


def test_kmeans(spark):
    x = [[0, 0], [0, 1], [1, 0], [10, 10], [10, 11], [11, 10]]
    fit = cluster.kmeans(spark, rows(spark, x), [x[0], x[3]])
    assert [r["cluster"] for r in fit.assignments.orderBy("row_id").collect()] == [1, 1, 1, 2, 2, 2] and fit.converged
    clusters = lambda m: [r["cluster"] for r in m.assignments.orderBy("row_id").collect()]
    assert clusters(cluster.kmeans(spark, rows(spark, [-2, 0, 1]), [[-1], [1]], iter_max=1)) in ([1, 1, 2], [1, 2, 2])
    same = cluster.kmeans(spark, rows(spark, [1, 1, 1]), [[1], [1]])
    assert clusters(same) == [1, 1, 1] and same.withinss.tolist() == [0, 0] and same.converged
    far = cluster.kmeans(spark, rows(spark, 1e8 + np.array([0, 0.1, 0.9, 1])), 1e8 + np.array([[0.0], [1]]))
    assert clusters(far) == [1, 1, 2, 2] and np.allclose(far.centers[:, 0] - 1e8, [0.05, 0.95], atol=1e-7)
    new = cluster.predict_kmeans(fit, rows(spark, [[0.2, 0.2]]), "distance").orderBy("cluster").collect()
    assert np.isclose(new[0]["distance"], np.hypot(0.2 - 1 / 3, 0.2 - 1 / 3))
    for bad, message in ((dict(centers=6), "number of clusters"), (dict(centers=2, iter_max=0), "iter_max"), (dict(centers=2, tolerance=-1), "tolerance"), (dict(centers=2, seed=1.5), "seed"), (dict(centers=[[1]]), "as many columns")):
        with pytest.raises(ValueError, match=message):
            cluster.kmeans(spark, rows(spark, x), **bad)


def directed(spark, index, distance):
    return spark.createDataFrame([(i + 1, n, float(d)) for i, (a, b) in enumerate(zip(index, distance)) for n, d in zip(a, b)], "row_id long, neighbor_id long, distance double")


def test_graphs(spark):
    index = [[2, 3], [1, 3], [4, 1], [3, 2]]
    g = graph.knn_graph(spark, directed(spark, index, [[1, 4], [3, 2], [2, 1], [0.5, 5]]), "distance", "mutual")
    assert sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in g.edges.collect()) == [(1, 2, 0.5), (1, 3, 0.5), (3, 4, round(1 / 1.5, 9))]
    assert g.adjacency().count() == 6
    for rows_, message in (([[1, 3]], "no neighbour of itself"), ([[2, 2]], "duplicate neighbours"), ([[2, 9]], "valid graph vertices")):
        with pytest.raises(ValueError, match=message):
            graph.knn_graph(spark, directed(spark, rows_ + index[1:], [[1, 2]] * 4))
    with pytest.raises(ValueError, match="positive finite"):
        graph.knn_graph(spark, directed(spark, index, [[1, 2]] * 4), "gaussian", sigma=-1)


def test_communities(spark):
    squares = [[0, 0], [0, 1], [1, 0], [1, 1], [5, 5], [5, 6], [6, 5], [6, 6]]
    g = graph.knn_graph(spark, neighbors.knn(spark, rows(spark, squares), 3), "gaussian")
    for found in (graph.louvain(spark, g), graph.leiden(spark, g)):
        c = [r["community"] for r in found.membership.orderBy("vertex_id").collect()]
        assert c == [1, 1, 1, 1, 2, 2, 2, 2] and np.isclose(found.modularity, 0.5)
    rng = np.random.default_rng(0)
    part = np.repeat(np.arange(4), 15)
    pairs = [(i, j) for i in range(60) for j in range(i + 1, 60) if rng.random() < (0.5 if part[i] == part[j] else 0.03)]
    edges = spark.createDataFrame([(i, j, 1.0) for i, j in pairs], "src long, dst long, weight double")
    planted = graph.Graph(edges, spark.range(60).withColumnRenamed("id", "vertex_id"), "binary", "union", {})
    truth = spark.createDataFrame([(i, int(c)) for i, c in enumerate(part)], "vertex_id long, community int")
    least = graph.modularity(edges, truth).head()[0]
    for found in (graph.louvain(spark, planted), graph.leiden(spark, planted)):
        assert found.modularity >= least - 1e-9
    with pytest.raises(ValueError, match="rounds"):
        graph.leiden(spark, planted, n_iterations=0)
    coarse = graph._coarsened(spark, edges, planted.vertices, 1.0)
    assert graph.modularity(edges, coarse.withColumnRenamed("part", "community")).head()[0] > 0.2


def test_embeddings(spark):
    x = np.sin(np.arange(1, 73) / 5).reshape(24, 3, order="F")
    found = embed.diffusion_map(spark, rows(spark, x), 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    k = np.exp(-(d**2) / (2 * np.median(d[d > 0]) ** 2))
    np.fill_diagonal(k, 0)
    root = 1 / np.sqrt(k.sum(1))
    values, vectors = np.linalg.eigh(k * np.outer(root, root))
    values, vectors = values[::-1], vectors[:, ::-1]
    got = np.array([r["coord"] for r in found.coordinates.orderBy("row_id").collect()])
    want = vectors[:, 1:4] * root[:, None] * np.maximum(values[1:4], 0)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    kernel, degree, _ = embed.diffusion_kernel(spark, rows(spark, x))
    lanczos, _ = embed._lanczos(spark, embed.normalized_kernel(kernel, degree), np.arange(1, 25), 2, 24)
    assert np.allclose(lanczos, values[:2], atol=1e-8)
    groups = np.concatenate([np.random.default_rng(1).normal(0, 0.1, (20, 4)), np.random.default_rng(2).normal(5, 0.1, (20, 4))])
    for made in (embed.tsne(spark, rows(spark, groups), perplexity=5, seed=1, iterations=200), embed.umap(spark, rows(spark, groups), n_neighbors=5, seed=1, n_epochs=60)):
        y = np.array([r["coord"] for r in embed.embedding_coordinates(made).orderBy("row_id").collect()])
        near = np.argsort(((y[:, None] - y[None]) ** 2).sum(-1) + np.eye(40) * 1e9, axis=1)[:, :3]
        assert np.mean((near < 20) == (np.arange(40) < 20)[:, None]) > 0.95
    for call, message in ((lambda: embed.tsne(spark, rows(spark, x), perplexity=30), "perplexity"), (lambda: embed.umap(spark, rows(spark, x), n_neighbors=1), "neighbours here"), (lambda: embed.tsne(spark, rows(spark, x), perplexity=2, theta=2), "from 0 to 1")):
        with pytest.raises(ValueError, match=message):
            call()


def test_input_resolution(spark):
    a, b = rows(spark, T), rows(spark, T[:4])
    assert embed.resolve_input({"dims": {"PCA": a, "x": b}}).count() == 6
    assert embed.resolve_input({"dims": {"PCA": a, "x": b}, "metadata": {"reduced_dim": "x"}}).count() == 4
    assert embed.resolve_input({"dims": {"PCA": a, "x": b}, "metadata": {"reduced_dim": "x"}}, "PCA").count() == 6
    with pytest.raises(ValueError, match="reduced dimension"):
        embed.resolve_input({"dims": {"x": b}})


def test_streaming_prediction(spark, tmp_path):
    from vecloom.streaming.scoring import stream_clusters

    rows(spark, T).write.parquet(str(tmp_path / "in"))
    model = cluster.KMeans(None, T[[0, 5]], np.zeros(2), 0.0, 0, False)
    stream = spark.readStream.schema("row_id long, features array<double>").parquet(str(tmp_path / "in"))
    q = stream_clusters(model, stream).writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["cluster"] for r in spark.table("scored").orderBy("row_id").collect()] == [1, 1, 1, 1, 2, 2]


def test_provenance_and_strategies(spark):
    found = neighbors.knn(spark, rows(spark, T), 2)
    assert [r["stage"] for r in prov.provenance(found)] == ["distance", "neighbor_selection"] and found.compute_device == "executors"
    assert prov.compute_device({"a": prov.stage("driver"), "b": prov.stage()}) == "hybrid"
    with pytest.raises(ValueError, match="fallback"):
        prov.Stage("driver", "driver", "x", "y", True)
    found.provenance_schema = "other/1"
    with pytest.raises(prov.ProvenanceError):
        prov.provenance(found)
    assert strategy.available() and strategy.diagnostics(spark).status in ("ready", "degraded")
    assert strategy.memory_info(spark)[0].available and all(selftest().values())
    with pytest.raises(ValueError, match="not available"):
        strategy.select("gpu", "knn", 1)
    with pytest.raises(ValueError, match="lacks operations"):
        strategy.register(strategy.Strategy("half", "driver", {}))


def test_kmeans_models_are_checked(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0])], "row_id long, features array<double>")
    good = dict(assignments=None, centers=np.zeros((2, 2)), withinss=np.ones(2), tot_withinss=2.0, iterations=1, converged=True)
    assert cluster.predict_kmeans(cluster.KMeans(**good), rows).count() == 1
    for bad in ({"centers": np.full((2, 2), np.nan)}, {"centers": np.zeros(2)}, {"withinss": np.ones(3)}, {"withinss": -np.ones(2)}, {"tot_withinss": 5.0}, {"iterations": -1}, {"converged": None}):
        with pytest.raises(ValueError):
            cluster.predict_kmeans(cluster.KMeans(**good | bad), rows)


def test_column_statistics_merge(spark):
    x = np.random.default_rng(3).normal(1e6, 1, (101, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>").repartition(7)
    got = linalg.column_stats(rows, 3).orderBy("col").toPandas()
    assert np.allclose(got["mean"], x.mean(axis=0), rtol=1e-14) and np.allclose(got["sd"], x.std(axis=0, ddof=1), rtol=1e-9)
    assert np.array_equal(got["low"], x.min(axis=0)) and np.array_equal(got["high"], x.max(axis=0)) and np.allclose(got["rms"], np.sqrt((x**2).sum(axis=0) / 100))


def test_features_are_found_by_name():
    find = linalg.aligned_features
    assert find(None, None, 2) == [0, 1] and find(["b", "a"], ["a", "b"], 2) == [1, 0] and find(["a", "a"], ["a", "a"], 2) == [0, 1]
    for columns, names in ((["a"], None), (None, ["a", "b"]), (["a", "c"], ["a", "b"]), (["a", "b", "b"], ["a", "b"])):
        with pytest.raises(ValueError):
            find(columns, names, 2)


def test_rounded_neighbours_are_found_by_block(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 3)), 1)
    x[60:90] = x[0]
    x[0:2] += [[0.005, 0, 0], [0.015, 0, 0]]
    d = neighbors.distance(spark, rows(spark, x)).where("row_id <> col_id").withColumn("distance", F.round("distance", 2)).collect()
    want = sorted(d, key=lambda r: (r["row_id"], r["distance"], r["col_id"]))
    want = {i: [(r["col_id"], r["distance"]) for r in want if r["row_id"] == i][:7] for i in range(1, 151)}
    for how in ("sql", "block"):
        got = {}
        for r in neighbors.knn(spark, rows(spark, x), 7, strategy=how, digits=2).rows.orderBy("row_id", "rank").collect():
            got.setdefault(r["row_id"], []).append((r["neighbor_id"], r["distance"]))
        assert got == want
    half = np.array([0.005, 0.015, 1.005, 2.675, 0.0149999999, 0.0])
    assert neighbors.rounded_as_sql(half, 2).tolist() == [r[0] for r in spark.createDataFrame([(float(v),) for v in half], "v double").select(F.round("v", 2)).collect()]


def test_pairs_of_blocks_come_from_one_copy_of_the_rows(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows were repeated for every block")

    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(70, 3)), np.round(rng.normal(size=(50, 3)), 1)
    x[20:30] = x[0]
    x[31] = 3 * x[30]
    monkeypatch.setattr(neighbors, "_cells", refuse)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbors, "PAIRS", 40)
    for metric in neighbors.METRICS:
        for other in (None, rows(spark, y)):
            for digits in (None, 2, 6):
                made = [neighbors.distance(spark, rows(spark, x), other, metric, 7, how, digits) for how in ("sql", "block")]
                want, got = ({(r["row_id"], r["col_id"]): r["distance"] for r in m.collect()} for m in made)
                assert made[1].count() == len(got) == 70 * (70 if other is None else 50)
                assert got == pytest.approx(want, abs=1e-12) if digits is None else got == want
    plan = made[1]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    q, r = rng.normal(size=(40, 5)), rng.normal(size=(30, 5))
    direct = np.array([[neighbors.cosine_direct(a, b) for b in r / 9] for a in q / 9])
    for digits in (0, 3, 15):
        assert neighbors._rounded_cosine(q / 9, r / 9, digits).ravel().tolist() == neighbors.rounded_as_sql(direct.ravel(), digits).tolist()


def test_diffusion_works_by_blocks(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(90, 3))
    x[10:30] = x[0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sigma = np.median(d[d > 0])
    k = np.exp(-(d**2) / (2 * sigma**2)) * (1 - np.eye(90))
    root = 1 / np.sqrt(k.sum(1))

    def refuse(*_, **__):
        raise AssertionError("pairs were shuffled")

    monkeypatch.setattr(embed, "normalized_kernel", refuse)
    monkeypatch.setattr(neighbors, "_sql_distance", refuse)
    monkeypatch.setattr(F, "median", refuse)
    for bins, gathered in ((1 << 16, 1 << 20), (8, 16)):
        monkeypatch.setattr(embed, "BINS", bins)
        monkeypatch.setattr(embed, "GATHERED", gathered)
        _, degree, found = embed.diffusion_kernel(spark, rows(spark, x))
        assert np.isclose(found, sigma, rtol=1e-13)
    assert np.allclose([r["degree"] for r in degree.orderBy("row_id").collect()], k.sum(1))
    got = np.zeros((90, 90))
    for r in embed.diffusion_matrix(spark, rows(spark, x)).collect():
        got[r["row_id"] - 1, r["col_id"] - 1] = r["w"]
    assert np.allclose(got, k * np.outer(root, root), atol=1e-12)
    dense = embed.diffusion_map(spark, rows(spark, x), 2)
    monkeypatch.setattr(embed, "DENSE_ROWS", 10)
    steps = embed.diffusion_map(spark, rows(spark, x), 2)
    a, b = (np.array([r["coord"] for r in m.coordinates.orderBy("row_id").collect()]) for m in (dense, steps))
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-7)


def test_a_kernel_pass_works_out_each_pair_once(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(300, 5))
    x[40:60] = x[0]
    x[70] *= 1e4
    monkeypatch.setattr(embed, "KERNEL_ROWS", 64)
    monkeypatch.setattr(embed, "CHUNK", 1000)
    pairs = embed._pairs(rows(spark, x), 300)
    count = lambda same, q_ids, q, r_ids, r: [[np.array([sum(np.isfinite(d).sum() for d in embed._distance_blocks(same, q_ids, q, r_ids, r, "euclidean"))])]]
    assert embed._over_pairs(pairs, count, "n long").agg(F.sum("n")).head()[0] == 300 * 299 / 2
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for guess in (20, 2048):  # the median of a few rows' pairs may lie elsewhere
        monkeypatch.setattr(embed, "GUESS_ROWS", guess)
        assert np.isclose(embed._median_distance(pairs, rows(spark, x), 300, "euclidean", 1e6), np.median(d[d > 0]), rtol=1e-12)
    ones = lambda ids: np.ones((len(ids), 1))
    for sigma in (3.0, 1e-3):
        k = np.exp(-((d / sigma) ** 2) / 2) * (1 - np.eye(300))
        got = embed._multiplied(pairs, "euclidean", sigma, lambda ids: np.stack([ids, ids**0.5], 1), ones, ["a", "b"]).orderBy("row_id").collect()
        i = np.arange(1, 301)
        assert np.allclose([[r["a"], r["b"]] for r in got], k @ np.stack([i, i**0.5], 1), rtol=1e-9)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_lanczos_passes_multiply_blocks_of_vectors(spark, monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(8)
    half = rng.normal(size=(20, 20))
    whole = np.kron(np.eye(2), half + half.T) / 10  # each eigenvalue twice
    i, j = np.nonzero(whole)
    cells = spark.createDataFrame(pd.DataFrame({"row_id": i + 1, "col_id": j + 1, "w": whole[i, j]}), "row_id long, col_id long, w double").cache()
    want = np.linalg.eigvalsh(whole)[::-1]
    values, vectors = embed._lanczos(spark, cells, np.arange(1, 41), 4, 10)
    assert np.allclose(values, want[:4], atol=1e-9) and np.allclose(whole @ vectors, vectors * values, atol=1e-8) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-9)

    def multiply(v):
        passes.append(v.shape)
        return spark.createDataFrame(pd.DataFrame({"row_id": ids} | {f"y{c}": (a @ v)[:, c] for c in range(v.shape[1])}))

    x = rng.normal(size=(400, 64))
    a = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 256) * (1 - np.eye(400))
    a /= np.sqrt(np.outer(a.sum(1), a.sum(1)))
    ids, passes = np.arange(5, 405), []
    want, planes = (m[..., ::-1][..., :4] for m in np.linalg.eigh(a))
    values, vectors = embed._lanczos(spark, multiply, ids, 4, 10)
    assert len(passes) <= 8 and passes[0] == (400, 32)
    assert np.allclose(values, want, atol=1e-12) and np.allclose(np.abs(vectors), np.abs(planes), atol=1e-6)
    monkeypatch.setattr(embed, "WIDTH", 6)  # the basis is cut to its leading vectors several times
    monkeypatch.setattr(embed, "BASIS_VECTORS", 24)
    values, vectors = embed._lanczos(spark, multiply, ids, 4, 3)
    assert np.allclose(values, want, atol=1e-12) and np.allclose(np.abs(vectors), np.abs(planes), atol=1e-6)


def test_tsne_holds_no_square_matrix(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a square matrix on the driver")

    monkeypatch.setattr(embed, "_affinities", refuse)
    monkeypatch.setattr(embed, "DENSE_ROWS", 30)
    groups = np.concatenate([np.random.default_rng(1).normal(0, 0.1, (30, 4)), np.random.default_rng(2).normal(5, 0.1, (30, 4))])
    y = np.array([r["coord"] for r in embed.tsne(spark, rows(spark, groups), perplexity=8, seed=1, iterations=200).coordinates.orderBy("row_id").collect()])
    near = np.argsort(((y[:, None] - y[None]) ** 2).sum(-1) + np.eye(60) * 1e9, axis=1)[:, :3]
    assert np.mean((near < 30) == (np.arange(60) < 30)[:, None]) > 0.95
    diff = y[:, None] - y[None]
    q = 1 / (1 + (diff**2).sum(-1)) * (1 - np.eye(60))
    push, total = embed._repulsion(y)
    assert np.allclose(push, (q[:, :, None] ** 2 * diff).sum(1)) and np.isclose(total, q.sum())
    ids, places, p = embed._near_affinities(spark, rows(spark, groups), 60, 8)
    full = np.zeros((60, 60))
    full[np.arange(60)[:, None], places] = p
    assert np.isclose(full.sum(), 0.5) and np.allclose(embed._attraction(y, places, p), ((full + full.T)[:, :, None] * (q[:, :, None] * diff)).sum(1))


def test_tsne_reads_repulsion_from_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for scale, columns, most in ((1e-4, 2, 1e-9), (1, 2, 1e-3), (20, 2, 0.02), (20, 1, 0.02)):
        y = scale * rng.normal(size=(2500, columns)) + 5
        (push, total), (want, whole) = embed._grid_repulsion(y), embed._repulsion(y)
        assert np.linalg.norm(push - want) <= most * np.linalg.norm(want) and np.isclose(total, whole, rtol=most)
    assert np.allclose(embed._grid_repulsion(np.ones((9, 2)))[0], 0)

    def refuse(*_):
        raise AssertionError("all pairs on the driver")

    monkeypatch.setattr(embed, "_repulsion", refuse)
    monkeypatch.setattr(embed, "DENSE_ROWS", 30)
    monkeypatch.setattr(embed, "GRID_ROWS", 40)
    groups = np.concatenate([np.random.default_rng(1).normal(0, 0.1, (30, 4)), np.random.default_rng(2).normal(5, 0.1, (30, 4))])
    y = np.array([r["coord"] for r in embed.tsne(spark, rows(spark, groups), perplexity=8, seed=1, iterations=200).coordinates.orderBy("row_id").collect()])
    near = np.argsort(((y[:, None] - y[None]) ** 2).sum(-1) + np.eye(60) * 1e9, axis=1)[:, :3]
    assert np.mean((near < 30) == (np.arange(60) < 30)[:, None]) > 0.95

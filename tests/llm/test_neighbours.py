import numpy as np
import pandas as pd

from inkwell.llm import neighbours as nb


def _frame(spark, v, source=None, ids=None):
    ids = ids or [f"r{i:05d}" for i in range(len(v))]
    source = source or [f"s{i}" for i in range(len(v))]
    return spark.createDataFrame(pd.DataFrame({"row_id": ids, "source_id": source, "vec": [(x / np.linalg.norm(x)).astype("<f4").tobytes() for x in v]}), "row_id string, source_id string, vec binary")


def _brute(v, source, k):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = v @ v.T
    sims[np.array(source)[:, None] == np.array(source)[None, :]] = -9
    return np.argsort(-sims, axis=1, kind="stable")[:, :k], sims


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (30, 24))
    v = centers[rng.integers(0, 30, 3000)] + rng.normal(0, 0.5, (3000, 24))
    source = [f"s{i // 4}" for i in range(3000)]
    got = nb.nearest_vectors(_frame(spark, v, source), 10, list_size=150).toPandas()
    true, _ = _brute(v, source, 10)
    found = got.groupby("row_id")["neighbour_id"].apply(set)
    recall = np.mean([len(found[f"r{i:05d}"] & {f"r{j:05d}" for j in true[i]}) / 10 for i in range(3000)])
    assert recall >= 0.9
    assert got.groupby("row_id").size().max() == 10
    own = dict(zip([f"r{i:05d}" for i in range(3000)], source))
    assert all(own[a] != own[b] for a, b in zip(got["row_id"], got["neighbour_id"]))


def test_a_third_of_equal_vectors_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 100)
    rng = np.random.default_rng(4)
    v = np.concatenate([np.tile(rng.normal(0, 1, (1, 8)), (300, 1)), rng.normal(0, 1, (600, 8))])
    source = ["same"] * 150 + [f"s{i}" for i in range(750)]
    got = nb.nearest_vectors(_frame(spark, v, source), 5, min_similarity=0.999).toPandas()
    copies = got[got["row_id"] < "r00300"]
    assert copies.groupby("row_id").size().eq(5).all() and copies["row_id"].nunique() == 300
    assert (copies["similarity"] > 0.9999).all()
    assert set(copies[copies["row_id"] < "r00150"]["neighbour_id"]) == {f"r{i:05d}" for i in range(150, 155)}


def test_edge_cases(spark):
    assert nb.nearest_vectors(_frame(spark, np.ones((1, 4))).limit(0), 3).count() == 0
    assert nb.nearest_vectors(_frame(spark, np.ones((1, 4))), 3).count() == 0
    two = nb.nearest_vectors(_frame(spark, np.ones((2, 4)), ids=["a", "b"]), 3).collect()
    assert {(r["row_id"], r["neighbour_id"], r["rank"]) for r in two} == {("a", "b", 1), ("b", "a", 1)}
    twice = _frame(spark, np.ones((2, 4)), ids=["a", "b"])
    assert nb.nearest_vectors(twice.unionAll(twice), 3).count() == 2


def test_decode(spark):
    import base64

    enc = lambda *x: base64.b64encode(np.array(x, "<f4").tobytes()).decode()
    rows = [("a", "s", "act", enc(3, 4)), ("b", "s", "act", None), ("c", "s", "act", enc(0, 0)), ("d", "s", "act", enc(1, 2, 3)), ("e", "s", "old", enc(1, 2)), ("f", "s", "act", "!!"), ("g", None, "act", enc(float("nan"), 1))]
    chunks = spark.createDataFrame(rows, "row_id string, source_id string, artifact_id string, embedding_base64 string")
    arts = spark.createDataFrame([("act", 2, True), ("old", 2, False), ("nil", 2, None)], "artifact_id string, dimension int, is_active boolean")
    got = nb.decode(chunks, arts).collect()
    assert [r["row_id"] for r in got] == ["a"]
    assert np.allclose(np.frombuffer(got[0]["vec"], "<f4"), [0.6, 0.8])


def test_graph_finds_nearest_centroids():
    rng = np.random.default_rng(5)
    c = rng.normal(0, 1, (3000, 16)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q = rng.normal(0, 1, (200, 16)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, dist = nb.CentroidGraph(c).nearest(q, 8)
    true = np.argsort(-(q @ c.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids, true)]) > 0.9
    assert (np.diff(dist, axis=1) >= -1e-6).all()


def test_graph_looks_at_few_centroids():
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 1, (200, 16))
    c = (centers[rng.integers(0, 200, 20_000)] + rng.normal(0, 0.4, (20_000, 16))).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q = (centers[rng.integers(0, 200, 500)] + rng.normal(0, 0.4, (500, 16))).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    graph = nb.CentroidGraph(c)
    ids, _ = graph.nearest(q, 8)
    true = np.argsort(-(q @ c.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids, true)]) > 0.9
    assert graph.looked / len(q) < 0.1 * len(c)


def test_lists_are_even():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.05, (3000, 8)) + 1, rng.normal(0, 1, (1000, 8))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sizes = np.bincount(nb._owners(x, nb.fit_centroids(x, 40)))
    assert sizes.max() <= 200 and (sizes > 0).all()
    assert len(nb.fit_centroids(np.ones((500, 4), np.float32), 10)) <= 10  # equal vectors can't be split


def test_two_levels_of_centroids(spark, monkeypatch):
    monkeypatch.setattr(nb, "TOP", 8)
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 1, (40, 16))
    v = centers[rng.integers(0, 40, 4000)] + rng.normal(0, 0.5, (4000, 16))
    source = [f"s{i}" for i in range(4000)]
    got = nb.nearest_vectors(_frame(spark, v, source), 10, list_size=100).toPandas()
    true, _ = _brute(v, source, 10)
    found = got.groupby("row_id")["neighbour_id"].apply(set)
    assert np.mean([len(found[f"r{i:05d}"] & {f"r{j:05d}" for j in true[i]}) / 10 for i in range(4000)]) >= 0.9


def test_too_many_artifacts_are_refused(spark):
    import pytest

    arts = spark.range(nb.MAX_ARTIFACTS + 1).selectExpr("cast(id as string) as artifact_id", "4 as dimension", "true as is_active")
    with pytest.raises(ValueError, match="active artifacts"):
        nb._active(arts)


def test_measured_recall(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(11)
    centers = rng.normal(0, 1, (20, 16))
    v = centers[rng.integers(0, 20, 1500)] + rng.normal(0, 0.5, (1500, 16))
    source = [f"s{i // 3}" for i in range(1500)]
    got = nb.recall(_frame(spark, v, source), 10, F.col("row_id") < "r00300").first()
    assert got["queries"] == 300 and got["recall"] >= 0.9
    assert nb.recall(_frame(spark, v[:4]).limit(0), 10, F.lit(True)).first()["queries"] == 0

"""The k most similar vectors for every vector, by balanced posting lists.

Centroids are fitted on a bounded share of the vectors, drawn by hash: up to TOP lists on the driver; more in two
levels, the driver fitting cells and the cluster the lists of each cell. Lists that take more than twice their share are
split until all are even. Every vector is posted to its nearest list and, near a boundary, to up to POSTINGS lists whose
distance is within POST_RATIO of the nearest; as a query it visits up to PROBES lists within PROBE_RATIO. The nearest
centroids come from a graph over the centroids that is held in memory, built once and walked best-first from a few hubs
with a beam of bounded width, many queries at once; a walk looks at a few hundred centroids however many there are.
Each list is one block product; lists that outgrow BLOCK vectors are cut into blocks of members and of queries.
The results of the lists of a vector are merged. Candidate search only is approximate: every vector is indexed,
similarities are exact cosines of float32 vectors.

What is broadcast is bounded: MAX_LISTS centroids with DEGREE links each. Copies of one vector: of more than 2k rows
with equal vectors only those that can be among the k smallest by (similarity, id) for some row are posted, which
loses nothing; all stay queries.

Defined cases: null, undecodable, wrongly sized, non-finite and all-zero vectors take no part. Repeated rows count
once. Ties go to the smaller row_id. Rows of the same source are no neighbours; a null source_id is a source of its own.
Fewer than k other vectors give fewer neighbours; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import cut

SAMPLE_ROWS, LIST_SIZE, BLOCK = 32_768, 2_000, 16_384
TOP, MAX_LISTS, ROWS_PER_LIST = 1_024, 65_536, 24
POSTINGS, POST_RATIO, PROBES, PROBE_RATIO = 2, 0.1, 8, 0.2
HUBS, DEGREE, BEAM, AHEAD = 64, 24, 24, 4
MAX_ARTIFACTS, ASKED = 1_000, 4_096


def _active(artifacts: DataFrame) -> DataFrame:
    """Ids and dimensions of the active artifacts, a control table; refuses more than can be broadcast."""
    active = artifacts.where(F.coalesce("is_active", F.lit(False))).select("artifact_id", "dimension").distinct()
    if active.limit(MAX_ARTIFACTS + 1).count() > MAX_ARTIFACTS:
        raise ValueError(f"more than {MAX_ARTIFACTS} active artifacts")
    return active


def decode(chunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(row_id, source_id, vec) of the active artifacts: unit vectors as little-endian float32."""
    active = _active(artifacts)
    raw = (
        chunks.select("row_id", "source_id", "artifact_id", F.try_to_binary("embedding_base64", F.lit("base64")).alias("raw"))
        .join(F.broadcast(active), "artifact_id")
        .where("row_id is not null and raw is not null and octet_length(raw) = 4 * dimension and dimension > 0")
        .select("row_id", "source_id", "raw")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.frombuffer(b"".join(pdf["raw"]), dtype="<f4").reshape(len(pdf), -1).astype(np.float64)
                with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                    norm = np.sqrt((v * v).sum(1))
                    fine = np.isfinite(norm) & (norm > 0)
                    unit = (v[fine] / norm[fine, None]).astype("<f4")
                if not fine.any():
                    continue
                yield pd.DataFrame({"row_id": pdf["row_id"][fine], "source_id": pdf["source_id"][fine], "vec": [x.tobytes() for x in unit]})

    return raw.mapInPandas(run, "row_id string, source_id string, vec binary")


def _owners(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])


def _kmeans(x: np.ndarray, lists: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Spherical k-means."""
    c = x[rng.choice(len(x), lists, replace=False)].astype(np.float32)
    for _ in range(rounds):
        owner = _owners(x, c)
        size = np.bincount(owner, minlength=lists)
        order = np.argsort(owner, kind="stable")
        sums = np.zeros_like(c)
        filled = np.flatnonzero(size)
        sums[filled] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(size[filled])[:-1]]), axis=0)
        for j in np.flatnonzero(size == 0):
            sums[j] = x[rng.integers(len(x))]
        c = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return c


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids whose lists are even on x: those with more than twice their share are split, empty ones go."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    share = max(4.0, len(x) / lists)
    c = _kmeans(x, lists, rng, rounds)
    fixed: set[bytes] = set()  # lists that can't be split, as all their vectors are equal
    for _ in range(16):
        owner = _owners(x, c)
        size = np.bincount(owner, minlength=len(c))
        large = [j for j in np.flatnonzero(size > 2 * share) if c[j].tobytes() not in fixed]
        if not large:
            break
        new = [c[np.setdiff1d(np.flatnonzero(size), large)]]
        for j in large:
            own = x[owner == j]
            parts = _kmeans(own, min(len(own), max(2, round(len(own) / share))), rng, 4)
            if len(np.unique(_owners(own, parts))) < 2:
                parts = c[j : j + 1]
                fixed.add(parts[0].tobytes())
            new.append(parts)
        c = np.concatenate(new)
    return c


class CentroidGraph:
    """A graph over centroids: each knows its nearest ones; queries walk it best-first from hubs. Built once, then broadcast."""

    def __init__(self, centroids: np.ndarray):
        self.c = np.ascontiguousarray(centroids, dtype=np.float32)
        n = len(self.c)
        degree = min(DEGREE, n - 1)
        self.links = np.full((n, max(1, degree)), -1, dtype=np.int32)
        for i in range(0, n if degree else 0, 1024):
            sims = self.c[i : i + 1024] @ self.c.T
            sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
            self.links[i : i + 1024] = np.argpartition(-sims, degree - 1, axis=1)[:, :degree]
        hubs = max(HUBS, int(2 * n**0.5))  # spread as the centroids are, so that every group of them has one
        spread = self.c if n <= hubs else _kmeans(self.c, hubs, np.random.default_rng(7), 4)
        self.hubs = np.unique((np.concatenate([(spread[i : i + 256] @ self.c.T).argmax(1) for i in range(0, len(spread), 256)])).astype(np.int32))
        self.looked = 0  # similarities computed so far

    def nearest(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the `most` nearest centroids of each row of q, nearest first."""
        most = min(most, len(self.c))
        ids, dist = np.empty((len(q), most), np.int64), np.empty((len(q), most), np.float32)
        for i in range(0, len(q), 1024):
            found, sims = self._walk(q[i : i + 1024], most)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
            ids[i : i + 1024] = np.take_along_axis(found, order, 1)
            dist[i : i + 1024] = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, order, 1)))
        return ids, dist

    def _walk(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query, ids and similarities, once all in it have been looked around from."""
        n, width = len(self.c), max(BEAM, 2 * most)
        start = q @ self.c[self.hubs].T
        self.looked += start.size
        if len(self.hubs) == n:
            return np.broadcast_to(self.hubs, start.shape), start
        width = min(width, len(self.hubs))
        best = np.argpartition(-start, width - 1, axis=1)[:, :width]
        ids, sims = self.hubs[best], np.take_along_axis(start, best, 1)
        open_ = np.ones(ids.shape, dtype=bool)
        live = np.arange(len(q))
        while len(live):
            ahead = np.where(open_[live], sims[live], -3)
            pick = np.argpartition(-ahead, AHEAD - 1, axis=1)[:, :AHEAD]
            going = (np.take_along_axis(ahead, pick, 1) > -3).any(1)
            live, pick, ahead = live[going], pick[going], ahead[going]
            if not len(live):
                break
            fresh = np.take_along_axis(ahead, pick, 1) > -3
            open_[live[:, None], pick] = False
            near = np.where(fresh[:, :, None], self.links[np.take_along_axis(ids[live], pick, 1)], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near[:, :, None] == ids[live][:, None, :]).any(2)] = -1
            got = np.full(near.shape, -2, dtype=np.float32)
            r, k = np.nonzero(near >= 0)
            got[r, k] = np.einsum("ij,ij->i", q[live[r]], self.c[near[r, k]])
            self.looked += len(r)
            all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], got], 1)
            all_open = np.concatenate([open_[live], near >= 0], 1)
            keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live], sims[live], open_[live] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_sims, all_open))
        return ids, sims


def _vectors(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f4").reshape(len(column), -1)


def _top(q: np.ndarray, qs: np.ndarray, qid: np.ndarray, m: np.ndarray, ms: np.ndarray, mid: np.ndarray, k: int, least: float) -> Iterator[tuple]:
    """The k best members for each query; members come sorted by id, so ties go to the smaller one."""
    for i in range(0, len(q), 512):
        sims = q[i : i + 512] @ m.T
        sims[(qs[i : i + 512, None] == ms[None, :])] = -2
        if least > -1:
            rows = np.flatnonzero((sims >= least).any(1))
            sims = sims[rows]
        else:
            rows = np.arange(len(sims))
        if not len(rows):
            continue
        if sims.shape[1] > k:
            cutoff = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
            sims = np.where(sims >= cutoff, sims, -2)
        r, c = np.nonzero(sims >= max(least, -1.5))
        order = np.lexsort((mid[c], -sims[r, c], r))
        r, c = r[order], c[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[rank < k], c[rank < k]
        yield qid[i + rows[r]], mid[c], sims[r, c]


def _sample(vectors: DataFrame, share: float) -> DataFrame:
    """A share of the vectors, by hash of their row_id."""
    return vectors.where(F.pmod(F.xxhash64("row_id"), F.lit(1 << 31)) <= int((1 << 31) * min(1.0, share))).select("vec")


def _centroids(vectors: DataFrame, n: int, lists: int, sample_rows: int) -> np.ndarray:
    """The centroids of n vectors; the driver sees sample_rows vectors (expected; twice that at most) and the centroids."""
    few = min(lists, TOP) if lists <= TOP else int(np.ceil(lists**0.5))
    top = fit_centroids(_vectors(_sample(vectors, sample_rows / n).limit(2 * sample_rows).toPandas()["vec"]), few)
    if lists <= TOP:
        return top
    cells = vectors.sparkSession.sparkContext.broadcast(top)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"cell": _owners(_vectors(pdf["vec"]), cells.value), "vec": pdf["vec"]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = fit_centroids(_vectors(pdf["vec"]), -(-len(pdf) // ROWS_PER_LIST))
        return pd.DataFrame({"vec": [x.tobytes() for x in found]})

    # a cell has ROWS_PER_LIST * sqrt(lists) rows of the sample or about twice that, as cells are even
    placed = _sample(vectors, ROWS_PER_LIST * lists / n).mapInPandas(place, "cell long, vec binary")
    return _vectors(placed.groupBy("cell").applyInPandas(fit, "vec binary").toPandas()["vec"])


def nearest_vectors(vectors: DataFrame, k: int = 10, min_similarity: float | None = None, postings: int = POSTINGS, probes: int = PROBES, list_size: int = LIST_SIZE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(row_id, neighbour_id, similarity, rank) of (row_id, source_id, vec); rank 1 is the most similar.

    min_similarity leaves out neighbours below it. As those of the k best that reach it are the same before and
    after merging, it is applied within lists already.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors, "vectors")  # decoded once; read by the sample and by the assignment
    n = vectors.count()
    out = "row_id string, neighbour_id string, similarity double, rank int"
    if n == 0:
        return spark.createDataFrame([], out)
    graph = CentroidGraph(_centroids(vectors, n, min(MAX_LISTS, -(-n // list_size)), sample_rows))
    shared = spark.sparkContext.broadcast(graph)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            ids, dist = graph.nearest(_vectors(pdf["vec"]), max(postings, probes))
            asked = dist <= dist[:, :1] * (1 + PROBE_RATIO) + 1e-6
            asked[:, probes:] = False
            posted = dist <= dist[:, :1] * (1 + POST_RATIO) + 1e-6
            posted[:, postings:] = False
            posts = posted.sum(1)
            yield pdf.assign(lists=[a[: max(1, x, y)].tolist() for a, x, y in zip(ids, asked.sum(1), posts)], asks=asked.sum(1).astype(np.int32), posts=posts.astype(np.int32))

    assigned = vectors.mapInPandas(assign, "row_id string, source_id string, vec binary, lists array<long>, asks int, posts int")
    # 64-bit names keep the exchanges small; the row_ids come back at the end
    assigned = cut(assigned.withColumn("src", F.coalesce(F.xxhash64("source_id"), F.xxhash64(F.lit("row"), "row_id"))).withColumn("vh", F.xxhash64("vec")), "assigned")

    # of many equal vectors, post those that can be among the k best
    crowds = assigned.groupBy("vh").count().where(F.col("count") > 2 * k).select("vh")
    per_source = Window.partitionBy("vh", "src").orderBy("row_id")
    per_vector = Window.partitionBy("vh").orderBy("row_id")
    keep = (
        assigned.join(crowds, "vh", "left_semi").select("row_id", "src", "vh").distinct()
        .withColumn("_s", F.row_number().over(per_source)).where(F.col("_s") <= k)
        .withColumn("_v", F.row_number().over(per_vector)).where(F.col("_v") <= 2 * k)
        .select("row_id", F.lit(True).alias("kept"))
    )
    flagged = assigned.join(crowds.withColumn("crowd", F.lit(True)), "vh", "left").join(keep, "row_id", "left").withColumn("posts", F.when(F.col("crowd") & F.col("kept").isNull(), 0).otherwise(F.col("posts"))) if crowds.limit(1).count() else assigned

    each = flagged.select("row_id", "src", "vec", "asks", "posts", F.posexplode("lists").alias("at", "list")).select("row_id", "src", "vec", "list", (F.col("at") < F.col("asks")).alias("asks"), (F.col("at") < F.col("posts")).alias("posts"))
    sizes = each.groupBy("list").agg(F.count_if("posts").alias("m"), F.count_if("asks").alias("q")).select("list", F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK)).cast("int").alias("mb"), F.greatest(F.lit(1), F.ceil(F.col("q") / BLOCK)).cast("int").alias("qb"))
    placed = each.join(F.broadcast(sizes), "list")  # one row for each list
    block = F.pmod(F.xxhash64("row_id"), F.lit(1 << 20))
    spread = placed.select(
        "row_id", "src", "vec", "list", "asks", "posts", F.when(F.col("asks"), F.pmod(block, F.col("qb"))).alias("own_q"), F.when(F.col("posts"), F.pmod(block, F.col("mb"))).alias("own_m"), "mb", "qb"
    ).withColumn(
        "cell",
        F.explode(
            F.when((F.col("mb") == 1) & (F.col("qb") == 1), F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))))
            .otherwise(F.array_union(
                F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda i: F.struct(i.cast("long").alias("i"), F.col("own_q").cast("long").alias("j")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>")),
                F.when(F.col("posts"), F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda j: F.struct(F.col("own_m").cast("long").alias("i"), j.cast("long").alias("j")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>")),
            ))
        ),
    ).select("row_id", "src", "vec", "list", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), (F.col("asks") & (F.col("own_q") == F.col("cell.j"))).alias("asks"), (F.col("posts") & (F.col("own_m") == F.col("cell.i"))).alias("posts"))
    least = -1.0 if min_similarity is None else float(min_similarity)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id").drop_duplicates("row_id")
        v, src, ids = _vectors(pdf["vec"]), pdf["src"].to_numpy(), np.arange(len(pdf))
        asks, posts = pdf["asks"].fillna(False).to_numpy(bool), pdf["posts"].fillna(False).to_numpy(bool)
        found = list(_top(v[asks], src[asks], ids[asks], v[posts], src[posts], ids[posts], k, least)) if asks.any() and posts.any() else []
        if not found:
            return pd.DataFrame([], columns=["row_id", "neighbour_id", "similarity"])
        a, b, s = (np.concatenate(x) for x in zip(*found))
        names = pdf["row_id"].to_numpy()
        return pd.DataFrame({"row_id": names[a], "neighbour_id": names[b], "similarity": s.astype(np.float64)})

    found = spread.groupBy("list", "i", "j").applyInPandas(search, "row_id string, neighbour_id string, similarity double")
    best = Window.partitionBy("row_id").orderBy(F.desc("similarity"), "neighbour_id")
    merged = found.groupBy("row_id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mutual_pairs(neighbours: DataFrame, min_similarity: float) -> DataFrame:
    """(row_id_a, row_id_b), row_id_a < row_id_b: rows that are among each other's neighbours."""
    close = neighbours.where(F.col("similarity") >= min_similarity)
    pair = close.select(F.least("row_id", "neighbour_id").alias("row_id_a"), F.greatest("row_id", "neighbour_id").alias("row_id_b"), (F.col("row_id") < F.col("neighbour_id")).cast("int").alias("side"))
    return pair.groupBy("row_id_a", "row_id_b").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("row_id_a", "row_id_b")


def recall(vectors: DataFrame, k: int, asked: Column) -> DataFrame:
    """One row (queries, recall): the share of the true k nearest of the rows asked for that nearest_vectors finds.

    The truth is a block product of the asked vectors (in blocks of ASKED, on the driver only while they are sent out)
    with all vectors; a true neighbour counts as found if it, or one as similar, is among the k.
    """
    spark = vectors.sparkSession
    truth = None
    block: list = []

    def exact(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r["row_id"] for r in rows], np.array([r["source_id"] or "" for r in rows], dtype=object), _vectors(pd.Series([bytes(r["vec"]) for r in rows]))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, sources, q = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                sims = q @ _vectors(pdf["vec"]).T
                sims[(sources[:, None] == pdf["source_id"].fillna("").to_numpy()[None, :]) & (sources[:, None] != "")] = -2
                sims[np.array(ids, dtype=object)[:, None] == pdf["row_id"].to_numpy()[None, :]] = -2
                best = -np.partition(-sims, min(k, sims.shape[1]) - 1, axis=1)[:, : min(k, sims.shape[1])]
                r, c = np.nonzero(best > -2)
                yield pd.DataFrame({"row_id": [ids[i] for i in r], "similarity": best[r, c].astype(np.float64)})

        return vectors.dropDuplicates(["row_id"]).mapInPandas(run, "row_id string, similarity double")

    for row in vectors.where(asked).dropDuplicates(["row_id"]).toLocalIterator():
        block.append(row)
        if len(block) == ASKED:
            truth, block = exact(block) if truth is None else truth.unionByName(exact(block)), []
    if block:
        truth = exact(block) if truth is None else truth.unionByName(exact(block))
    if truth is None:
        return spark.createDataFrame([(0, None)], "queries long, recall double")
    order = Window.partitionBy("row_id").orderBy(F.desc("similarity"))
    kth = truth.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).groupBy("row_id").agg(F.min("similarity").alias("kth"), F.count("*").alias("true"))
    found = nearest_vectors(vectors, k).join(kth, "row_id").groupBy("row_id").agg(F.count_if(F.col("similarity") >= F.col("kth") - 1e-6).alias("hit"))
    scored = kth.join(found, "row_id", "left")
    return scored.agg(F.count("*").alias("queries"), F.round(F.avg(F.least(F.lit(1.0), F.coalesce("hit", F.lit(0)) / F.col("true"))), 6).alias("recall"))

"""Flat vector search, and attaching embeddings through a pluggable embedder with batching, retries and dead letters."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import vectors
from inkwell.operators.filters import RowFilter, predicate
from inkwell.operators.lexical import ranked


def search(chunks: DataFrame, vector: list[float], limit: int = 80, metric: str = "cosine", row_filter: RowFilter | None = None, embedding: str = "embedding") -> DataFrame:
    """(row_id, source_id, raw_value, rank_score, rank): an exact scan; vectors of other lengths and nulls don't count."""
    if not vector:
        return chunks.sparkSession.createDataFrame([], "row_id string, source_id string, raw_value double, rank_score double, rank int")
    own = chunks.where(predicate(row_filter)).where(F.size(embedding) == len(vector))
    raw, rank = vectors.score(F.lit(list(map(float, vector))), F.col(embedding), metric)
    scored = own.select("row_id", "source_id", raw.alias("raw_value"), rank.alias("rank_score")).dropDuplicates(["row_id"])
    return ranked(scored, limit, F.desc("rank_score"), F.asc("row_id"))


def search_many(chunks: DataFrame, queries: DataFrame, limit: int, embedding: str = "embedding", metric: str = "cosine") -> DataFrame:
    """(query_id, row_id, source_id, similarity, rank): top-k by a metric (of l2 the negative distance) for queries (query_id, vector, exclude_source_id).

    The queries are taken to the driver in blocks of MAX_QUERIES and multiplied with batches of rows; each batch keeps
    its own best rows, so the exchange carries only those. Each further block is one more scan of the rows.
    """
    out, block = None, []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == MAX_QUERIES:
            found = _search_block(chunks, block, limit, embedding, metric)
            out, block = found if out is None else out.unionByName(found), []
    if block or out is None:
        found = _search_block(chunks, block, limit, embedding, metric)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(chunks: DataFrame, rows: list, limit: int, embedding: str, metric: str) -> DataFrame:
    schema = "query_id string, row_id string, source_id string, similarity double"
    spark = chunks.sparkSession
    if not rows:
        return spark.createDataFrame([], schema + ", rank int")
    ids = [r["query_id"] for r in rows]
    skip = np.array([r["exclude_source_id"] or "" for r in rows], dtype=object)
    q = np.array([r["vector"] for r in rows], dtype=np.float64)
    if metric == "cosine":
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    elif metric not in ("dot", "l2"):
        raise ValueError(f"unknown metric {metric}")
    shared = spark.sparkContext.broadcast((ids, skip, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_ids, own_skip, own_q = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.array(pdf["_v"].tolist(), dtype=np.float64)
            if metric == "cosine":
                length = np.linalg.norm(v, axis=1)
                sims = own_q @ (v / np.where(length > 0, length, 1)[:, None]).T
            elif metric == "dot":
                sims = own_q @ v.T
            else:
                sims = -np.sqrt(np.maximum(0, (own_q**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * own_q @ v.T))
            sims[own_skip[:, None] == pdf["source_id"].to_numpy()[None, :]] = -np.inf
            kth = -np.partition(-sims, limit - 1, axis=1)[:, limit - 1 : limit] if sims.shape[1] > limit else np.full((len(sims), 1), -np.inf)
            r, c = np.nonzero((sims >= kth) & np.isfinite(sims))
            if not len(r):
                continue
            yield pd.DataFrame({"query_id": [own_ids[i] for i in r], "row_id": pdf["row_id"].to_numpy()[c], "source_id": pdf["source_id"].to_numpy()[c], "similarity": sims[r, c]})

    found = chunks.where(F.size(embedding) == q.shape[1]).select("row_id", "source_id", F.col(embedding).alias("_v")).mapInPandas(run, schema)
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id")
    return found.dropDuplicates(["query_id", "row_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


MAX_QUERIES = 4096


# ---- embedding


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class EmbedError(Exception):
    def __init__(self, category: str, retryable: bool = False, retry_after: float | None = None):
        super().__init__(category)
        self.category, self.retryable, self.retry_after = category, retryable, retry_after


def status_error(status: int, retry_after: str | None = None) -> EmbedError:
    """What an HTTP status means for a batch."""
    after = float(retry_after) if retry_after and retry_after.replace(".", "", 1).isdigit() else None
    if status == 429:
        return EmbedError("rate_limit", True, after)
    if status in (401, 403):
        return EmbedError("auth")
    if status in (400, 413, 422):
        return EmbedError("input")
    if status in (408, 504):
        return EmbedError("timeout", True, after)
    return EmbedError("provider", status >= 500, after)


def hash_embedder(dimension: int = 64) -> Embedder:
    """Deterministic unit vectors from token hashes, for tests and as a stand-in without a service."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dimension)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


@dataclass(frozen=True)
class Batching:
    items: int = 64
    tokens: int = 8192
    bytes: int = 1_000_000
    attempts: int = 4
    base_delay: float = 0.5
    max_delay: float = 30.0


def plan_batches(texts: list[str], tokens: list[int], limits: Batching) -> list[list[int]]:
    """Consecutive batches within all limits; an item over a limit goes alone."""
    out: list[list[int]] = []
    now: list[int] = []
    t = b = 0
    for i, (s, n) in enumerate(zip(texts, tokens)):
        size = len(s.encode("utf-8", "surrogatepass"))
        if now and (len(now) == limits.items or t + n > limits.tokens or b + size > limits.bytes):
            out.append(now)
            now, t, b = [], 0, 0
        now.append(i)
        t, b = t + n, b + size
    return out + [now] if now else out


def backoff(attempt: int, limits: Batching, jitter: float, retry_after: float | None = None) -> float:
    return min(limits.max_delay, max(retry_after or 0.0, limits.base_delay * 2**attempt * (0.5 + jitter / 2)))


def embed_batch(embed: Embedder, texts: list[str], limits: Batching, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text: retryable failures are tried again, refused batches are halved down to the single text."""
    for attempt in range(limits.attempts):
        try:
            got = embed(texts)
            if len(got) != len(texts) or any(not all(map(math.isfinite, v)) for v in got):
                raise EmbedError("response")
            return [(list(map(float, v)), None) for v in got]
        except EmbedError as e:
            if e.category == "input" and len(texts) > 1:
                half = len(texts) // 2
                return embed_batch(embed, texts[:half], limits, sleep, jitter) + embed_batch(embed, texts[half:], limits, sleep, jitter)
            if not e.retryable or attempt + 1 == limits.attempts:
                return [(None, e.category)] * len(texts)
            sleep(backoff(attempt, limits, jitter(), e.retry_after))
    return [(None, "provider")] * len(texts)


def embed_column(df: DataFrame, make: Callable[[], Embedder], text: str = "embedding_input", limits: Batching = Batching(), order: str | None = None, cancelled: Callable[[], bool] | None = None) -> DataFrame:
    """df (row_id, embedding_input_hash, text) to (row_id, embedding_input_hash, embedding, error); make builds the embedder in each task.

    Of several inputs of a row the last by `order` counts (then the greatest hash). Once `cancelled` says so, batches not
    yet begun are left out: they are neither embedded nor failed (`remainder` tells them).
    """
    from inkwell.functions.markdown import estimate_tokens

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for pdf in batches:
            if not len(pdf):
                continue
            texts = [t or "" for t in pdf["_t"]]
            done: list = [None] * len(texts)
            for batch in plan_batches(texts, [estimate_tokens(t) for t in texts], limits):
                if cancelled is not None and cancelled():
                    break
                for i, r in zip(batch, embed_batch(embed, [texts[i] for i in batch], limits)):
                    done[i] = r
            made = np.array([r is not None for r in done])
            if not made.any():
                continue
            yield pd.DataFrame({"row_id": pdf["row_id"][made], "embedding_input_hash": pdf["embedding_input_hash"][made], "embedding": [r[0] for r in done if r], "error": [r[1] for r in done if r]})

    last = F.struct(*([F.col(order)] if order else []), "embedding_input_hash", F.col(text))
    once = df.groupBy("row_id").agg(F.max_by(F.struct("embedding_input_hash", F.col(text).alias("_t")), last).alias("r")).select("row_id", "r.*")
    return once.mapInPandas(run, "row_id string, embedding_input_hash string, embedding array<float>, error string")


def attach(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Chunks with the embeddings whose input is still the current one; others keep what they have."""
    fine = embedded.where("error is null").select("row_id", "embedding_input_hash", F.col("embedding").alias("_new")).dropDuplicates(["row_id", "embedding_input_hash"])
    return chunks.join(fine, ["row_id", "embedding_input_hash"], "left").withColumn("embedding", F.coalesce("_new", "embedding")).select(*chunks.columns)


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunk rows with the embeddings of old ones whose id and input are the same."""
    return attach(new, old.where("embedding is not null").select("row_id", "embedding_input_hash", "embedding", F.lit(None).cast("string").alias("error")))


def remainder(items: DataFrame, embedded: DataFrame) -> DataFrame:
    """The (row_id, embedding_input_hash) that a run, cut short, has neither embedded nor failed."""
    return items.select("row_id", "embedding_input_hash").distinct().join(embedded.select("row_id", "embedding_input_hash"), ["row_id", "embedding_input_hash"], "left_anti")


class Reranker(Protocol):
    """Where a reranker would go; none comes with the engine."""

    def __call__(self, query: str, page: DataFrame) -> DataFrame: ...


def no_rerank(query: str, page: DataFrame) -> DataFrame:
    """The reranker in force: the order stays."""
    return page


def dead_letters(embedded: DataFrame) -> DataFrame:
    return embedded.where("error is not null").select("row_id", "embedding_input_hash", "error")

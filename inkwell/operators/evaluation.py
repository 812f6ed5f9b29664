"""Retrieval quality: recall, reciprocal rank, zero results, and gates over approximate search.

results (query_id, rank, target_id); expected (query_id, target_id, group). A query without results counts as a miss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import cut


def per_query(results: DataFrame, expected: DataFrame, recall_at: int = 10, mrr_at: int = 10) -> DataFrame:
    """(query_id, group, hit, rr, zero) of every query that has expectations."""
    want = expected.select("query_id", "target_id", "group").distinct()
    got = results.groupBy("query_id", "target_id").agg(F.min("rank").alias("rank"))
    any_result = results.select("query_id").distinct().withColumn("_any", F.lit(1))
    joined = want.join(got, ["query_id", "target_id"], "left").groupBy("query_id", "group").agg(F.min("rank").alias("first"))
    scored = joined.join(any_result, "query_id", "left")
    return scored.select("query_id", "group", F.coalesce((F.col("first") <= recall_at).cast("int"), F.lit(0)).alias("hit"), F.when(F.col("first") <= mrr_at, 1 / F.col("first")).otherwise(0.0).alias("rr"), F.col("_any").isNull().cast("int").alias("zero"))


def quality(results: DataFrame, expected: DataFrame, recall_at: int = 10, mrr_at: int = 10) -> DataFrame:
    """(group, queries, recall, mrr, zero_rate)."""
    return per_query(results, expected, recall_at, mrr_at).groupBy("group").agg(F.count("*").alias("queries"), F.avg("hit").alias("recall"), F.avg("rr").alias("mrr"), F.avg("zero").alias("zero_rate"))


def overlap_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the true k nearest (query_id, id) that was found."""
    hit = truth.join(found.select("query_id", "id").distinct().withColumn("_f", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("_f") / F.lit(k)).alias("recall"))


def percentile(value: Column, p: float) -> Column:
    """The value at place floor(n * p) of the sorted values, the last one at most. For bounded groups of measurements."""
    values = F.sort_array(F.collect_list(value))
    return F.element_at(values, (F.least(F.size(values) - 1, F.floor(F.size(values) * F.lit(p)).cast("int")) + 1).cast("int"))


def percentiles(df: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """(group, value): the same over any number of rows: values are counted, put in order by range, and ranks come from running counts.

    No task holds a group: a group's values are spread over its ranges, of which only the counts are put together.
    """
    from pyspark.sql import Window

    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    parted = counted.repartitionByRange(F.col(group), F.col(value)).withColumn("_part", F.spark_partition_id())
    parted = cut(parted, "ranges")
    ahead = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = parted.groupBy(group, "_part").agg(F.sum("n").alias("m"))
    sums = sums.select(group, "_part", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("_before"), F.sum("m").over(Window.partitionBy(group)).alias("_all"))
    inside = Window.partitionBy(group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = parted.join(sums, [group, "_part"]).withColumn("_upto", F.col("_before") + F.sum("n").over(inside))
    place = F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.lit(p)))
    return placed.where((F.col("_upto") - F.col("n") <= place) & (place < F.col("_upto"))).select(group, value)


def unit_vectors(spark: SparkSession, n: int, dimension: int, seed: int = 20260715) -> DataFrame:
    """(id, vector): reproducible unit vectors for benches; vector i comes from a xorshift generator of 32 bits that begins with seed ^ i."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = (pdf["id"].to_numpy().astype(np.uint64) ^ np.uint64(seed)).astype(np.uint32)
            x = np.where(x == 0, np.uint32(1), x)
            v = np.empty((len(x), dimension))
            for k in range(dimension):
                x = x ^ (x << np.uint32(13))
                x = x ^ (x >> np.uint32(17))
                x = x ^ (x << np.uint32(5))
                v[:, k] = x / 2**31 - 1
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"id": pdf["id"], "vector": list(v.astype(np.float32))})

    return spark.range(n).mapInPandas(run, "id long, vector array<float>")


def full_width(text: str) -> str:
    """A fixture's words in full-width letters, as some input methods write them."""
    return "".join("\u3000" if c == " " else chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)


@dataclass(frozen=True)
class Gate:
    """What an approximate index has to reach to replace the flat scan."""

    queries: int = 500
    mean_recall: float = 0.95
    share: float = 0.99
    share_recall: float = 0.8
    least: float = 0.5
    gain: float = 0.3
    gain_ms: float = 10
    p95_ms: float = 100
    flat_ms: float = 25


def ann_gate(recalls: DataFrame, timings: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """One row: figures and verdict. recalls (query_id, recall); timings (kind: flat or ann, ms)."""
    r = recalls.agg(F.count("*").alias("queries"), F.avg("recall").alias("mean_recall"), F.avg((F.col("recall") >= gate.share_recall).cast("int")).alias("share"), F.min("recall").alias("least"))
    t = timings.groupBy().agg(percentile(F.when(F.col("kind") == "flat", F.col("ms")), 0.95).alias("flat_p95"), percentile(F.when(F.col("kind") == "ann", F.col("ms")), 0.95).alias("ann_p95"))
    gain = F.col("flat_p95") - F.col("ann_p95")
    passed = (
        (F.col("queries") >= gate.queries) & (F.col("mean_recall") >= gate.mean_recall) & (F.col("share") >= gate.share) & (F.col("least") >= gate.least) & (gain >= gate.gain_ms) & (gain / F.col("flat_p95") >= gate.gain)
        & (F.col("flat_p95") < gate.p95_ms) & (F.col("ann_p95") < gate.p95_ms) & (F.col("flat_p95") > gate.flat_ms)
    )
    return r.join(F.broadcast(t)).withColumn("passed", passed)


def cross_language(triples: DataFrame) -> DataFrame:
    """One row (pairs, passed, score, verified): an anchor has to be nearer to its translation than to the distractor."""
    from inkwell.functions import vectors

    ok = vectors.cosine(F.col("anchor"), F.col("translation")) > vectors.cosine(F.col("anchor"), F.col("distractor"))
    return triples.select(F.coalesce(ok, F.lit(False)).alias("ok")).agg(F.count("*").alias("pairs"), F.count_if("ok").alias("passed"), F.avg(F.col("ok").cast("int")).alias("score"), F.bool_and("ok").alias("verified"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).count().where("count > 1")

"""Filling fixed-capacity containers with items of varying length, by planning over the length histogram.

Items longer than the limit are cut into pieces of the limit and a rest; all others stay whole. The driver sees
only how many pieces of each length there are (at most `limit` rows per limit, whatever the data's size), plans by
best fit, longest first, over counts, and writes the plan as slots: pieces of a length with ranks from a to b go,
so many to a container, to containers from c on. Pieces then take their slot by joining on length and rank.

Ranks within a length come from row numbers within (length, salt) plus the counts of the salts before, so that no
task holds all pieces of a frequent length.

Defined cases: null ids are left out; null or negative lengths count as 0; items of length 0 go together to one
container. Repeated ids are repeated items only if their rows differ; exact duplicates count once. A limit below 1
or null packs nothing; more than MAX_LIMITS limits are refused. No items: no containers. Other columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALT_ROWS, MAX_SALTS, MAX_LIMITS = 100_000, 4096, 1_000


def plan(histogram: dict[int, int], limit: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, from_rank, to_rank, per_container, first_container) and the number of containers."""
    open_groups: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of containers (first, how many)
    rooms: list[int] = []
    slots: list[tuple[int, int, int, int, int]] = []
    containers = 0

    def put(room: int, first: int, many: int) -> None:
        if many:
            if room not in open_groups:
                bisect.insort(rooms, room)
                open_groups[room] = []
            open_groups[room].append((first, many))

    for length in sorted((x for x, c in histogram.items() if c > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = limit // length if length else left
                many = -(-left // each)
                put(limit, containers, many)
                containers += many
                continue
            room = rooms[at]
            first, many = open_groups[room].pop()
            if not open_groups[room]:
                del open_groups[room]
                rooms.pop(at)
            each = room // length if length else left
            full = min(many, left // each)
            if full:
                slots.append((length, rank, rank + full * each, each, first))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if left and full < many:
                slots.append((length, rank, rank + left, left, first + full))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, many - full)
    return slots, containers


def _limits(limits: DataFrame) -> DataFrame:
    """(limit_id, limit) of a control table; refuses more than can be broadcast."""
    own = limits.where("token_limit >= 1").select("limit_id", F.col("token_limit").cast("long").alias("limit")).distinct()
    if own.limit(MAX_LIMITS + 1).count() > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    return own


def pieces(items: DataFrame, limits: DataFrame, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(limit_id, limit, key, piece, length) of every item under every limit."""
    own = items.where(F.col(key).isNotNull()).select(key, F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("_size")).distinct()
    caps = F.broadcast(_limits(limits))
    every = own.join(caps)  # a fixed handful of limits for each item
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("_size") / F.col("limit")) - 1).cast("long"))
    return every.withColumn("piece", F.explode(cuts)).select("limit_id", "limit", key, "piece", F.least(F.col("limit"), F.col("_size") - F.col("piece") * F.col("limit")).alias("length"))


def pack(items: DataFrame, limits: DataFrame, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(limit_id, key, piece, length, container_id): the container of every piece; piece 0 is the whole item unless it exceeds the limit.

    items should be cheap to read twice (a table or a cut): once for the histogram, once for the assignment.
    """
    spark = items.sparkSession
    cut = pieces(items, limits, key, size)
    counts = cut.groupBy("limit_id", "limit", "length").count().collect()  # at most limit + 1 rows for each limit
    total = sum(r["count"] for r in counts)
    salts = max(1, min(MAX_SALTS, total // SALT_ROWS))
    rows = []
    for limit_id, limit in sorted({(r["limit_id"], r["limit"]) for r in counts}):
        slots, _ = plan({r["length"]: r["count"] for r in counts if r["limit_id"] == limit_id}, limit)
        by_length: dict[int, list] = {}
        for length, a, b, each, first in slots:
            by_length.setdefault(length, []).append((a, b, each, first))
        rows += [(limit_id, length, s) for length, s in by_length.items()]
    kind = dict(limits.dtypes)["limit_id"]
    slots_df = spark.createDataFrame(rows, f"limit_id {kind}, length long, slots array<struct<a: long, b: long, each: long, first: long>>")
    salted = cut.drop("limit").withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)))
    before = Window.partitionBy("limit_id", "length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("limit_id", "length", "_salt").count().select("limit_id", "length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("limit_id", "length", "_salt").orderBy(key, "piece")
    ranked = salted.withColumn("_n", F.row_number().over(inside) - 1).join(offsets, ["limit_id", "length", "_salt"]).withColumn("rank", F.col("_n") + F.col("_offset"))
    placed = ranked.join(F.broadcast(slots_df), ["limit_id", "length"])  # bounded as the histogram is
    slot = F.filter("slots", lambda s: (s["a"] <= F.col("rank")) & (F.col("rank") < s["b"]))[0]
    return placed.withColumn("_slot", slot).select("limit_id", key, "piece", "length", (F.col("_slot.first") + F.floor((F.col("rank") - F.col("_slot.a")) / F.col("_slot.each"))).cast("long").alias("container_id"))


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Containers, tokens and the share of space used, by limit."""
    by_container = packed.groupBy("limit_id", "container_id").agg(F.sum("length").alias("used"))
    caps = F.broadcast(_limits(limits).withColumnRenamed("limit", "token_limit"))
    return by_container.join(caps, "limit_id").groupBy("limit_id", "token_limit").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest")).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("token_limit")), 6))

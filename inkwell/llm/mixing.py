"""Mixing sources to target weights, by capped water-filling.

Each source is to hold its target share of a total size. A source that would have to be repeated more often than
allowed is clamped at that; what it lacks is spread over the others in proportion to their shares, until all are
feasible. By default the total is the size of all records there are, the report shows which sources were clamped and
the shares reached; total=EXACT asks for the largest total at which nothing has to be clamped, so that every target share
is reached (but for one record). A source repeated 2.4 times has every record twice and a seeded sample, two fifths of
its size, once more.

The sample takes records in the order of a seeded hash until its size is reached. Sizes are summed per source and
hash bucket (the driver sees at most BUCKETS rows for each source); whole buckets come in or stay out, and only the
bucket at the edge, a small part of one source, is put in order. So no task holds a source.

Defined cases: null ids and sources are left out; null sizes count as 0. Exact duplicates count once. Sources
without target aren't chosen; targets without records get nothing and, as their share can't be reached, don't limit
the exact total. Shares are scaled to sum to 1; null or negative ones count as 0; max_repeats below 0 or null as 0.
Several rows of targets for one source, or more than MAX_SOURCES sources, are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, MAX_SOURCES = 1024, 10_000
PIECES = 1024
EXACT = "exact"


def water_fill(available: dict[str, float], shares: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Size of each source: shares of the total, clamped at cap * available, the excess spread in proportion."""
    room = {s: max(0.0, caps.get(s, 0)) * available.get(s, 0) for s in shares}
    size, free, left = {s: 0.0 for s in shares}, {s for s in shares if shares[s] > 0}, float(total)
    while free and left > 0:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if left * shares[s] / weight >= room[s]}
        if not full:
            for s in free:
                size[s] = left * shares[s] / weight
            break
        for s in sorted(full):
            size[s] = room[s]
        left -= sum(room[s] for s in full)
        free -= full
    return size


def feasible_total(available: dict[str, float], shares: dict[str, float], caps: dict[str, float]) -> float:
    """The largest total at which every source that has records reaches its share."""
    limits = [caps[s] * available[s] / shares[s] for s in shares if shares[s] > 0 and available.get(s, 0) > 0 and caps.get(s, 0) > 0]
    return min(limits, default=0.0)


def _targets(targets: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    rows = targets.where("source is not null").select("source", "target_share", "max_repeats").distinct().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES or len({r["source"] for r in rows}) < len(rows):
        raise ValueError(f"targets are one row for each of at most {MAX_SOURCES} sources")
    shares = {r["source"]: max(0.0, r["target_share"] or 0.0) for r in rows}
    total = sum(shares.values()) or 1.0
    return {s: x / total for s, x in shares.items()}, {r["source"]: float(max(0, r["max_repeats"] or 0)) for r in rows}


def _own(items: DataFrame, key: str, size: str) -> DataFrame:
    """(key, source, _size) of the records that count, once."""
    return items.where(F.col(key).isNotNull() & F.col("source").isNotNull()).select(key, "source", F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("_size")).distinct()


def _planned(available: dict[str, int], everything: int, shares: dict[str, float], caps: dict[str, float], total: float | str | None) -> tuple[float, dict[str, float]]:
    goal = feasible_total(available, shares, caps) if total == EXACT else float(everything if total is None else total)
    return goal, water_fill(available, shares, caps, goal)


def plan_shares(items: DataFrame, targets: DataFrame, total: float | str | None = None, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(source, target_share, max_repeats, available, planned, planned_share, clamped): what water-filling asks of each source."""
    shares, caps = _targets(targets)
    sums = {r["source"]: r["n"] for r in _own(items, key, size).groupBy("source").agg(F.sum("_size").alias("n")).join(F.broadcast(_names(items, shares)), "source", "left_semi").collect()}  # a row for each target
    everything = _everything(items, key, size) if total is None else 0
    goal, sizes = _planned(sums, everything, shares, caps, total)
    whole = sum(sizes.values())
    rows = [(s, shares[s], int(caps[s]), int(sums.get(s, 0)), sizes[s], sizes[s] / whole if whole else 0.0, _clamped(sizes[s], goal * shares[s])) for s in sorted(shares)]
    return items.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, available long, planned double, planned_share double, clamped boolean")


def _names(items: DataFrame, shares: dict[str, float]) -> DataFrame:
    return items.sparkSession.createDataFrame([(s,) for s in sorted(shares)], "source string")


def _everything(items: DataFrame, key: str, size: str) -> int:
    return _own(items, key, size).agg(F.sum("_size").alias("n")).first()["n"] or 0


def _clamped(size: float, wanted: float) -> bool:
    return bool(size < wanted * (1 - 1e-9))


def mix(items: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 1, key: str = "doc_id", size: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Chosen (key, source, size, copies) and the report (source, target_share, max_repeats, available, clamped, chosen, actual_share).

    total: the size to reach; None for all there is; EXACT for the largest at which no source is clamped.
    items should be cheap to read twice (a table or a cut).
    """
    spark = items.sparkSession
    shares, caps = _targets(targets)
    own = _own(items, key, size).withColumn("_order", F.xxhash64(F.lit(seed), F.col(key).cast("string"))).withColumn("_bucket", F.shiftrightunsigned("_order", 54))
    wanted = own.join(F.broadcast(_names(items, shares)), "source", "left_semi")
    sums = wanted.groupBy("source", "_bucket").agg(F.sum("_size").alias("size")).collect()  # at most BUCKETS rows for each target
    available: dict[str, int] = {}
    for r in sums:
        available[r["source"]] = available.get(r["source"], 0) + r["size"]
    goal, sizes = _planned(available, _everything(items, key, size) if total is None else 0, shares, caps, total)
    rows = []
    for source in shares:
        have = available.get(source, 0)
        times = sizes[source] / have if have else 0.0
        whole = int(times + 1e-9)
        rest = max(0.0, sizes[source] - whole * have)
        edge, before = -1, 0
        for bucket, n in sorted((r["_bucket"], r["size"]) for r in sums if r["source"] == source):
            if before + n > rest:
                edge = bucket
                break
            before += n
        else:
            edge = BUCKETS
        rows.append((source, whole, edge, rest - before))
    steps = spark.createDataFrame(rows, "source string, _whole int, _edge long, _rest double")
    placed = wanted.join(F.broadcast(steps), "source")
    plain = placed.where("_bucket <> _edge").withColumn("copies", F.col("_whole") + (F.col("_bucket") < F.col("_edge")).cast("int"))
    edge = _at_the_edge(placed.where("_bucket = _edge"), key)
    chosen = plain.unionByName(edge).where("copies > 0").select(key, "source", F.col("_size").alias(size), "copies")
    got = chosen.groupBy("source").agg(F.sum(F.col(size) * F.col("copies")).alias("chosen"))
    wishes = spark.createDataFrame([(s, shares[s], int(caps[s]), int(available.get(s, 0)), _clamped(sizes[s], goal * shares[s])) for s in sorted(shares)], "source string, target_share double, max_repeats int, available long, clamped boolean")
    report = wishes.join(got, "source", "left").withColumn("chosen", F.coalesce("chosen", F.lit(0)))
    all_of_it = Window.partitionBy(F.lit(1))  # one row for each target
    return chosen, report.withColumn("actual_share", F.when(F.sum("chosen").over(all_of_it) > 0, F.col("chosen") / F.sum("chosen").over(all_of_it)).otherwise(0.0))


def _at_the_edge(edge: DataFrame, key: str) -> DataFrame:
    """Records of the bucket at the edge of each source with their copies: those come in, in order, that the rest has room for.

    The bucket is cut into PIECES by the next bits of the order; sizes before a piece are summed first, so that a task
    puts only a piece in order, a millionth of a source.
    """
    cut_up = edge.withColumn("_piece", F.shiftrightunsigned("_order", 44).bitwiseAND(F.lit(PIECES - 1)))
    ahead = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = cut_up.groupBy("source", "_piece").agg(F.sum("_size").alias("n")).select("source", "_piece", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"))
    order = Window.partitionBy("source", "_piece").orderBy("_order", key).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut_up.join(before, ["source", "_piece"]).withColumn("_sum", F.col("_before") + F.sum("_size").over(order))
    return summed.withColumn("copies", F.col("_whole") + (F.col("_sum") - F.col("_size") / 2 <= F.col("_rest")).cast("int")).select(*edge.columns, "copies")

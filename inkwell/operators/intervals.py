"""Disjoint intervals of sequence numbers, kept as rows (block, lo, hi), both ends included.

Intervals are clipped to fixed blocks of 2**block_bits numbers. They stay disjoint, and every operation
(build, merge, subtract, look up) works inside a block, so all of them partition by `block`, no step needs a
global order, and a task never holds more than 2**block_bits distinct numbers, however unequal the data.

Nulls: a null sequence number is no number and is left out. Repeated numbers count once. Empty inputs give
empty results. Columns other than the named one are ignored here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 14


def block_of(seq: Column, block_bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(seq.cast("long"), block_bits)


def islands(df: DataFrame, seq: str = "seq", block_bits: int = BLOCK_BITS) -> DataFrame:
    """The maximal runs of consecutive numbers in df[seq], by block."""
    numbers = (
        df.select(F.col(seq).cast("long").alias("seq"))
        .where("seq is not null")
        .withColumn("block", block_of(F.col("seq"), block_bits))
        .select("block", "seq")
        .distinct()
    )
    by_block = Window.partitionBy("block").orderBy("seq")
    return (
        numbers.withColumn("run", F.col("seq") - F.row_number().over(by_block))
        .groupBy("block", "run")
        .agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        .select("block", "lo", "hi")
    )


def _edges(df: DataFrame, weight: str) -> DataFrame:
    other = "b" if weight == "a" else "a"
    lo = F.struct(F.col("lo").alias("at"), F.lit(1).alias(weight), F.lit(0).alias(other))
    hi = F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias(weight), F.lit(0).alias(other))
    return df.select("block", F.explode(F.array(lo, hi)).alias("e")).select("block", "e.at", "e.a", "e.b")


def _segments(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elementary segments (block, lo, hi, a, b), a and b telling how often each side covers the segment."""
    points = _edges(a, "a").unionByName(_edges(b, "b")).groupBy("block", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy("block").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return points.select(
        "block",
        F.col("at").alias("lo"),
        (F.lead("at").over(order) - 1).alias("hi"),
        F.sum("a").over(so_far).alias("a"),
        F.sum("b").over(so_far).alias("b"),
    ).where("hi is not null")


def _glue(segments: DataFrame) -> DataFrame:
    """Join segments that touch."""
    order = Window.partitionBy("block").orderBy("lo")
    starts = segments.withColumn("new", F.when(F.lag("hi").over(order) == F.col("lo") - 1, 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("block", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("block", "lo", "hi")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two interval sets."""
    return _glue(_segments(a, b).where("a > 0 or b > 0").select("block", "lo", "hi"))


def subtract(available: DataFrame, processed: DataFrame) -> DataFrame:
    """What is available and not processed: the gaps, late commits included."""
    return _glue(_segments(available, processed).where("a > 0 and b <= 0").select("block", "lo", "hi"))


def rows_in(df: DataFrame, intervals: DataFrame, seq: str = "seq", block_bits: int = BLOCK_BITS) -> DataFrame:
    """The rows of df whose number lies in an interval; repeated rows stay repeated.

    A linear merge inside each block: the last interval that starts at or before the number is carried along,
    so the cost doesn't depend on how fragmented the intervals are.
    """
    keep = df.where(F.col(seq).isNotNull())
    left = keep.select(
        block_of(F.col(seq), block_bits).alias("_block"), F.col(seq).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_hi"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    )
    marks = intervals.select(F.col("block").alias("_block"), F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.col("hi").alias("_hi"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy("_block").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    reach = left.unionByName(marks).withColumn("_end", F.last("_hi", ignorenulls=True).over(order))
    return reach.where("_kind = 1 and _end >= _at").select("_row.*")

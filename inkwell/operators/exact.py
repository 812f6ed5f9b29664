"""Exact search, verified against the raw text: titles, aliases, file names, paths, tags and chunk texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators.filters import RowFilter, predicate
from inkwell.operators.lexical import ranked

# Order of fields among hits.
PRIORITY = {"title": 0, "alias": 1, "filename": 2, "path": 3, "text": 4, "tag": 5}
ALL = ("text", "title", "alias", "filename", "path", "tag")
MAX_NEEDLES = 1000


@dataclass(frozen=True)
class Needle:
    phrase: str
    fields: tuple[str, ...] = ALL


def _holds(want: Column) -> Callable[[Column], Column]:
    return lambda v: F.coalesce(F.contains(v, want), F.lit(False))


def hits(sources: DataFrame, chunks: DataFrame, needles: list[Needle], case_sensitive: bool = False, row_filter: RowFilter | None = None) -> DataFrame:
    """(source_id, row_id, field, phrase, offset, line, match_length), one for each (record, field, phrase).

    The needles of a query are a handful of literals; each scan checks up to MAX_NEEDLES at once, so a table is read once
    for so many.
    Offsets count for texts; for other fields they are 0. row_id is null for hits in sources.
    """
    needles = [n for n in needles if n.phrase]
    spark = sources.sparkSession
    if not needles:
        return spark.createDataFrame([], "source_id string, row_id string, field string, phrase string, offset int, line int, match_length int")
    blocks = [_hits_of_block(sources, chunks, needles[i : i + MAX_NEEDLES], case_sensitive, row_filter) for i in range(0, len(needles), MAX_NEEDLES)]
    return reduce(DataFrame.unionByName, blocks).dropDuplicates(["source_id", "row_id", "field", "phrase"])


def _hits_of_block(sources: DataFrame, chunks: DataFrame, needles: list[Needle], case_sensitive: bool, row_filter: RowFilter | None) -> DataFrame:
    src = sources.where(predicate(row_filter)).where("source_id is not null").select("source_id", "title_raw", "aliases", "filename_raw", "path_raw", "tags").dropDuplicates(["source_id"])
    values = {"title": F.array("title_raw"), "alias": F.col("aliases"), "filename": F.array("filename_raw"), "path": F.array("path_raw"), "tag": F.transform("tags", lambda t: F.concat(F.lit("#"), t))}
    checks = []
    for n in needles:
        want = F.lit(n.phrase) if case_sensitive else F.lower(F.lit(n.phrase))
        for f in (x for x in values if x in n.fields):
            folded = values[f] if case_sensitive else F.transform(values[f], F.lower)
            found = F.exists(folded, _holds(want))
            checks.append(F.when(found, F.struct(F.lit(f).alias("field"), F.lit(n.phrase).alias("phrase"))))
    out = None
    if checks:
        in_sources = src.select("source_id", F.explode(F.array_compact(F.array(*checks))).alias("h"))
        out = in_sources.select("source_id", F.lit(None).cast("string").alias("row_id"), "h.field", "h.phrase", F.lit(0).alias("offset"), F.lit(None).cast("int").alias("line"), F.length("h.phrase").alias("match_length"))
    own = [n for n in needles if "text" in n.fields]
    if own:
        rows = chunks.where(predicate(row_filter)).where("row_id is not null").select("row_id", "source_id", "line_start", "text_raw")
        low = F.col("text_raw") if case_sensitive else F.lower("text_raw")
        maybe = F.lit(False)
        for n in own:
            maybe = maybe | F.contains(low, F.lit(n.phrase) if case_sensitive else F.lower(F.lit(n.phrase)))
        kept = rows.where(maybe).dropDuplicates(["row_id"])
        each = kept.select("*", F.explode(F.array(*[F.struct(F.lit(n.phrase).alias("phrase"), text.find_verified("text_raw", F.lit(n.phrase), case_sensitive).cast("int").alias("offset")) for n in own])).alias("h")).where("h.offset is not null")
        in_text = each.select("source_id", "row_id", F.lit("text").alias("field"), "h.phrase", "h.offset", (F.col("line_start") + text.count_lines("text_raw", F.col("h.offset"))).cast("int").alias("line"), F.length("h.phrase").alias("match_length"))
        out = in_text if out is None else out.unionByName(in_text)
    return out


def search(sources: DataFrame, chunks: DataFrame, needles: list[Needle], limit: int = 50, case_sensitive: bool = False, row_filter: RowFilter | None = None) -> DataFrame:
    """The first `limit` hits by field, offset and id, with their rank."""
    order = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("field")]
    found = hits(sources, chunks, needles, case_sensitive, row_filter).withColumn("_o", order)
    return ranked(found, limit, F.asc("_o"), F.asc("offset"), F.asc("source_id"), F.asc_nulls_first("row_id"), F.asc("phrase")).drop("_o")

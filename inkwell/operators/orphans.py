"""Orphan references: records that refer to keys that are missing, deleted or arrive later.

A parent key is valid over intervals of time: a note's name from the revision that brings it to the one that renames or
deletes the note, an open end if it is there now. References and intervals are partitioned and sorted by key and merged;
what the intervals say about the time of the reference separates missing, deleted and late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import cut

#: A key with more than this share of all references is spread over SALTS partitions; at most 1/HOT_SHARE keys can be hot.
HOT_SHARE, SALTS = 0.01, 64
_OPEN = (1 << 63) - 1  # the end of an interval that hasn't ended


def link_name(link: Column) -> Column:
    """The note name in a link: %XX decoded, without fragment, folders, final .md or .txt and outer spaces, in lower case."""
    escaped = F.regexp_replace(F.regexp_replace(link, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    text = F.coalesce(F.try_url_decode(escaped), link)
    text = F.regexp_replace(text, r"(?s)#.*$", "")
    text = F.regexp_replace(text, r"(?s)^.*/", "")
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    text = F.regexp_replace(text, r"(?i)\.(md|txt)$", "")
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def is_note_link(link: Column) -> Column:
    """Whether a link can name a note at all: no web or mail address and no attachment."""
    text = F.lower(F.trim(link))
    return link.isNotNull() & ~text.rlike(r"^(https?|mailto):") & ~text.rlike(r"\.(png|pdf|svg|csv)$")


def file_name(path: Column) -> Column:
    """The file name without folders and extension, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"(?s)^.*/", ""), r"(?s)(?<=.)\.[^.]*$", ""))


def references(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ref_table, ref_key, ref_pos, kind, key, ref_ms): every reference of both tables, once."""
    links = (
        sources.where("source_id is not null")
        .select("source_id", "mtime_ms", F.posexplode("links").alias("pos", "link"))
        .where(is_note_link(F.col("link")))
        .select(F.lit("sources").alias("ref_table"), F.col("source_id").alias("ref_key"), F.col("pos").cast("int").alias("ref_pos"), F.lit("name").alias("kind"), link_name(F.col("link")).alias("key"), F.col("mtime_ms").alias("ref_ms"))
    )
    owners = chunks.where("row_id is not null and source_id is not null").select(F.lit("chunks").alias("ref_table"), F.col("row_id").alias("ref_key"), F.lit(0).alias("ref_pos"), F.lit("id").alias("kind"), F.col("source_id").alias("key"), F.col("mtime_ms").alias("ref_ms"))
    return links.unionByName(owners).dropDuplicates(["ref_table", "ref_key", "ref_pos"])


def merged(intervals: DataFrame, *keys: str) -> DataFrame:
    """(*keys, from_ms, to_ms): intervals of a key that meet or overlap as one; a null from_ms is the beginning of time."""
    order = Window.partitionBy(*keys).orderBy("from_ms", "to_ms")
    reach = F.max("to_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.select(*keys, F.coalesce("from_ms", F.lit(-_OPEN)).alias("from_ms"), "to_ms").distinct().withColumn("_new", F.when(F.col("from_ms") <= reach, 0).otherwise(1))
    numbered = marked.withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_n").agg(F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms")).drop("_n")


def parents(sources: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(kind, key, valid): the disjoint intervals (from_ms, to_ms) over which each key named a note; the last is open if it does now.

    Of the feed a source's revisions are put in order; each holds until the next. Whether a note is there now the
    catalog says, not the feed. Intervals are merged by source first, then by key, so that a name many notes share
    brings few intervals to its task.
    """
    name = lambda path: F.struct(F.lit("name").alias("kind"), file_name(F.col(path)).alias("key"))
    own = F.struct(F.lit("id").alias("kind"), F.col("source_id").alias("key"))
    now = sources.select(F.explode(F.array(own, name("path_raw"))).alias("k"), "created_ms").where("k.key is not null").groupBy("k").agg(F.min("created_ms").alias("from_ms")).select("k.kind", "k.key", "from_ms", F.lit(_OPEN).alias("to_ms"))
    every = now
    if changes is not None:
        feed = changes.where("source_id is not null and source_revision is not null").groupBy("source_id", "source_revision").agg(F.max_by(F.struct("change_kind", "path_raw", "mtime_ms"), "seq").alias("r")).select("source_id", "source_revision", "r.*")
        order = Window.partitionBy("source_id").orderBy("source_revision")
        spans = feed.withColumn("until", F.lead("mtime_ms").over(order)).where("change_kind <> 'delete'")
        # the last revision of a note that the catalog doesn't hold tells no end: it ends as it begins
        ended = spans.select(F.explode(F.array(own, name("path_raw"))).alias("k"), "source_id", F.col("mtime_ms").alias("from_ms"), F.greatest("mtime_ms", F.coalesce("until", "mtime_ms")).alias("to_ms"))
        by_source = merged(ended.select("k.kind", "k.key", "source_id", "from_ms", "to_ms").where("key is not null and from_ms is not null"), "kind", "key", "source_id")
        every = every.unionByName(by_source.drop("source_id"))
    return merged(every, "kind", "key").groupBy("kind", "key").agg(F.array_sort(F.collect_list(F.struct("from_ms", "to_ms"))).alias("valid"))


def resolve(refs: DataFrame, parent_keys: DataFrame) -> DataFrame:
    """refs with `status`: ok, late (the parent is there now, but came or came back after the reference), deleted or missing.

    Both sides are partitioned and sorted by (kind, key, salt) and merged in one linear pass (a sort-merge
    join; parents are one row per key, so it never multiplies rows). Keys that hold more than HOT_SHARE of
    all references are spread over SALTS partitions; there can be at most 1/HOT_SHARE of them, which bounds
    the list that is broadcast. Total and counts come from one aggregate.

    Nulls: references without key aren't references; a reference without time is never late. Ties and repeated
    rows don't matter, as parents are aggregated first. Empty parents make every reference missing; empty
    references give no rows. Extra columns of refs are kept.
    """
    counted = cut(refs.groupBy("kind", "key").count(), "reference-counts")
    total = counted.agg(F.sum("count").alias("n")).first()["n"] or 0
    hot = F.broadcast(counted.where(F.col("count") > max(10_000, total * HOT_SHARE)).select("kind", "key", F.lit(True).alias("_hot")))  # 1 / HOT_SHARE at most
    salted = refs.join(hot, ["kind", "key"], "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("ref_key", "ref_pos"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    spread = parent_keys.join(hot, ["kind", "key"], "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    joined = salted.hint("merge").join(spread, ["kind", "key", "_salt"], "left").drop("_salt")
    is_there = F.element_at("valid", -1)["to_ms"] == _OPEN
    held_then = F.col("ref_ms").isNull() | F.exists("valid", lambda v: (v["from_ms"] <= F.col("ref_ms")) & (F.col("ref_ms") < v["to_ms"]))
    return joined.withColumn("status", F.when(F.col("valid").isNull(), "missing").when(~is_there, "deleted").when(held_then, "ok").otherwise("late")).drop("valid")


def orphans(sources: DataFrame, chunks: DataFrame, changes: DataFrame | None = None, statuses: tuple[str, ...] = ("missing", "deleted")) -> DataFrame:
    """(ref_table, ref_key, ref_pos, period, status) of every reference whose parent is missing or deleted, or what else is asked for."""
    refs = cut(references(sources, chunks), "references")  # read by the counts and by the join
    found = resolve(refs, parents(sources, changes)).where(F.col("status").isin(*statuses))
    return found.select("ref_table", "ref_key", "ref_pos", F.date_format(F.date_from_unix_date(F.floor(F.col("ref_ms") / 86_400_000).cast("int")), "yyyy-MM").alias("period"), "status")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted by table, period and status."""
    return found.groupBy("ref_table", "period", "status").agg(F.count("*").alias("orphans"))

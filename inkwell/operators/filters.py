"""Structured filters over chunks and sources, compiled to column predicates that reach the scan where they can."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.session import small


@dataclass(frozen=True)
class RowFilter:
    folders: tuple[str, ...] = ()
    path_contains: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    mtime_before: int | None = None
    mtime_after: int | None = None
    source_ids: tuple[str, ...] | None = None
    exclude_source_ids: tuple[str, ...] = field(default=())

    def narrowed(self, **more) -> RowFilter:
        return replace(self, **more)


def folder_matches(folders: tuple[str, ...]) -> Column:
    """Any of the folders or a folder below it; the empty folder is the root alone."""
    out = F.lit(False)
    for f in folders:
        name = f.lower().strip("/")
        out = out | (F.col("folder_norm") == name) | F.col("folder_norm").startswith(name + "/")
    return out


def tags_match(tags: tuple[str, ...]) -> Column:
    """Each wanted tag equals a tag or is above one; letter case and a leading # don't matter."""
    out = F.lit(True)
    for t in tags:
        want = t.lower().removeprefix("#")
        out = out & F.coalesce(F.exists("tags", lambda x: (F.lower(x) == want) | F.lower(x).startswith(want + "/")), F.lit(False))
    return out


def predicate(f: RowFilter | None) -> Column:
    """All parts of a filter that are present; the time window excludes both ends."""
    out = F.lit(True)
    if f is None:
        return out
    if f.source_ids is not None:
        out = out & F.col("source_id").isin(*f.source_ids)
    if f.exclude_source_ids:
        out = out & ~F.col("source_id").isin(*f.exclude_source_ids)
    if f.extensions:
        out = out & F.col("extension").isin(*f.extensions)
    if f.mtime_before is not None:
        out = out & (F.col("mtime_ms") < f.mtime_before)
    if f.mtime_after is not None:
        out = out & (F.col("mtime_ms") > f.mtime_after)
    if f.folders:
        out = out & folder_matches(f.folders)
    for needle in f.path_contains:
        out = out & F.col("path_norm").contains(needle.lower())
    if f.tags:
        out = out & tags_match(f.tags)
    return out


MAX_LITERALS = 1_000


def apply_filter(df: DataFrame, f: RowFilter | None) -> DataFrame:
    """Rows that a filter lets pass. Lists of sources beyond MAX_LITERALS are joined instead of spelled out in the plan."""
    if f is None:
        return df
    for name, how in (("source_ids", "left_semi"), ("exclude_source_ids", "left_anti")):
        ids = getattr(f, name)
        if ids is not None and len(ids) > MAX_LITERALS:
            df = df.join(small(df.sparkSession, [(i,) for i in dict.fromkeys(ids)], "source_id string"), "source_id", how).select(*df.columns)
            f = replace(f, **{name: None if name == "source_ids" else ()})
    return df.where(predicate(f))


def combine(base: RowFilter | None, folders=(), path_contains=(), tags=(), extensions=(), before: int | None = None, after: int | None = None) -> RowFilter:
    """A base filter and a query's own: lists are joined, the window narrows; source lists come from the base alone."""
    base = base or RowFilter()
    least = [x for x in (base.mtime_before, before) if x is not None]
    most = [x for x in (base.mtime_after, after) if x is not None]
    return replace(
        base,
        folders=base.folders + tuple(folders),
        path_contains=base.path_contains + tuple(path_contains),
        tags=base.tags + tuple(tags),
        extensions=base.extensions + tuple(extensions),
        mtime_before=min(least, default=None),
        mtime_after=max(most, default=None),
    )

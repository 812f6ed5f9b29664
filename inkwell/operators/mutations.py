"""Changes of the index as new versions of its tables: nothing that is being read is overwritten.

Every function takes the tables as they are and returns them as they become; ArtifactStore writes them and swaps
the pointer. Revisions guard against stale work: what is not newer than what is held changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text


def manifest_state(manifest: DataFrame) -> DataFrame:
    """One row per (artifact_id, source_id): of several, that with the highest revisions, then the latest update."""
    key = F.struct(F.coalesce("indexed_revision", F.lit(0)), F.coalesce("seen_revision", F.lit(0)), F.coalesce("updated_ms", F.lit(0)), F.coalesce("retry_count", F.lit(0)), F.coalesce("status", F.lit("")))
    columns = [c for c in manifest.columns if c not in ("artifact_id", "source_id")]
    best = manifest.groupBy("artifact_id", "source_id").agg(F.max_by(F.struct(*columns), key).alias("r"))
    return best.select("artifact_id", "source_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def commit_sources(sources: DataFrame, chunks: DataFrame, manifest: DataFrame, new_sources: DataFrame, new_chunks: DataFrame, artifact_id: str, now_ms: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Put in new rows of sources whose revision is above the indexed one; their older rows go."""
    held = manifest.where(F.col("artifact_id") == artifact_id).groupBy("source_id").agg(F.max("indexed_revision").alias("_held"))
    fresh = new_sources.dropDuplicates(["source_id"]).join(held, "source_id", "left").where("_held is null or source_revision > _held").drop("_held")
    ids = fresh.select("source_id")
    out_sources = sources.join(ids, "source_id", "left_anti").unionByName(fresh.select(*sources.columns))
    out_chunks = chunks.join(ids, "source_id", "left_anti").unionByName(new_chunks.join(ids, "source_id", "left_semi").select(*chunks.columns))
    done = fresh.select(
        F.lit(artifact_id).alias("artifact_id"), "source_id", F.col("source_revision").alias("seen_revision"), F.col("source_revision").alias("indexed_revision"), F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("last_error_code"),
        F.lit(None).cast("string").alias("last_error_message"), F.lit(0).alias("retry_count"), F.lit(now_ms).cast("long").alias("last_attempt_ms"), F.lit(now_ms).cast("long").alias("updated_ms"),
    )
    rest = manifest.join(done.select("artifact_id", "source_id"), ["artifact_id", "source_id"], "left_anti")
    return out_sources, out_chunks, rest.unionByName(done.select(*manifest.columns))


def _upsert_manifest(manifest: DataFrame, changed: DataFrame) -> DataFrame:
    return manifest.join(changed.select("artifact_id", "source_id"), ["artifact_id", "source_id"], "left_anti").unionByName(changed.select(*manifest.columns))


def mark_seen(manifest: DataFrame, seen: DataFrame, artifact_id: str, now_ms: int = 0) -> DataFrame:
    """seen (source_id, revision): pending where the revision is above the one seen before."""
    now = seen.groupBy("source_id").agg(F.max("revision").cast("int").alias("_rev")).withColumn("artifact_id", F.lit(artifact_id))
    old = now.join(manifest_state(manifest), ["artifact_id", "source_id"], "left").where("seen_revision is null or _rev > seen_revision")
    changed = old.withColumns({"seen_revision": F.col("_rev"), "indexed_revision": F.coalesce("indexed_revision", F.lit(0)), "status": F.lit("pending"), "retry_count": F.coalesce("retry_count", F.lit(0)), "updated_ms": F.lit(now_ms).cast("long")})
    return _upsert_manifest(manifest, changed)


def mark_failed(manifest: DataFrame, failed: DataFrame, artifact_id: str, now_ms: int = 0) -> DataFrame:
    """failed (source_id, revision, code, message): status failed, one more retry."""
    now = failed.groupBy("source_id").agg(F.max("revision").cast("int").alias("_rev"), F.max_by("code", "revision").alias("_code"), F.max_by("message", "revision").alias("_message")).withColumn("artifact_id", F.lit(artifact_id))
    old = now.join(manifest_state(manifest), ["artifact_id", "source_id"], "left")
    changed = old.withColumns({
        "seen_revision": F.greatest("_rev", F.coalesce("seen_revision", F.lit(0))), "indexed_revision": F.coalesce("indexed_revision", F.lit(0)), "status": F.lit("failed"), "last_error_code": F.col("_code"), "last_error_message": F.col("_message"),
        "retry_count": F.coalesce("retry_count", F.lit(0)) + 1, "last_attempt_ms": F.lit(now_ms).cast("long"), "updated_ms": F.lit(now_ms).cast("long"),
    })
    return _upsert_manifest(manifest, changed)


def delete_sources(sources: DataFrame, chunks: DataFrame, manifest: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop sources, their chunks and their state."""
    ids = gone.select("source_id").distinct()
    return tuple(t.join(ids, "source_id", "left_anti") for t in (sources, chunks, manifest))


def rename_sources(sources: DataFrame, chunks: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """renames (source_id, new_path): ids and rows stay, path columns and terms are rewritten, revisions go up by one."""
    new = renames.groupBy("source_id").agg(F.max("new_path").alias("_path")).withColumn("_parts", text.path_parts("_path")).withColumn("_norm", text.normalize_lexical("_path")).withColumn("_terms", text.path_terms("_path"))

    def pick(col, value):
        return F.when(F.col("_path").isNotNull(), value).otherwise(F.col(col)).alias(col)

    common = {"source_revision": F.col("source_revision") + 1, "folder_norm": F.lower("_parts.folder"), "path_norm": F.col("_norm"), "extension": F.col("_parts.extension")}
    of_sources = common | {"path_raw": F.col("_path"), "filename_raw": F.col("_parts.filename"), "filename_norm": F.lower("_parts.filename"), "folder_raw": F.col("_parts.folder")}
    of_chunks = common | {"path_terms": F.col("_terms")}
    out = []
    for table, values in ((sources, of_sources), (chunks, of_chunks)):
        joined = table.join(new, "source_id", "left")
        out.append(joined.select(*[pick(c, values[c]) if c in values else F.col(c) for c in table.columns]))
    return out[0], out[1]


def touch_sources(sources: DataFrame, touched: DataFrame) -> DataFrame:
    """touched (source_id, mtime_ms, size_bytes): times and sizes only, revisions go up by one."""
    new = touched.groupBy("source_id").agg(F.max("mtime_ms").alias("_m"), F.max_by("size_bytes", "mtime_ms").alias("_s"))
    joined = sources.join(new, "source_id", "left")
    values = {"mtime_ms": F.col("_m"), "size_bytes": F.col("_s"), "source_revision": F.col("source_revision") + 1}
    return joined.select(*[F.when(F.col("_m").isNotNull(), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in sources.columns])


def decide_upsert(tasks: DataFrame, manifest: DataFrame, catalog: DataFrame, artifact_id: str) -> DataFrame:
    """tasks (source_id, path, revision, latest_revision, raw_content_hash) with `outcome`: removed, superseded, skipped or index."""
    held = manifest.where(F.col("artifact_id") == artifact_id).groupBy("source_id").agg(F.max("indexed_revision").alias("indexed_revision"))
    own = catalog.select("source_id", F.lower("raw_content_hash").alias("_old")).dropDuplicates(["source_id"])
    joined = tasks.join(held, "source_id", "left").join(own, "source_id", "left")
    outcome = (
        F.when(F.col("raw_content_hash").isNull(), "removed").when(F.col("revision") < F.col("latest_revision"), "superseded").when(F.col("revision") <= F.coalesce("indexed_revision", F.lit(0)), "superseded")
        .when(F.lower("raw_content_hash") == F.col("_old"), "skipped").otherwise("index")
    )
    return joined.withColumn("outcome", outcome).drop("_old")


def retry_candidates(manifest: DataFrame, chunks: DataFrame, dead: DataFrame | None, artifact_id: str) -> tuple[DataFrame, DataFrame]:
    """Sources that failed, and rows that lack an embedding and aren't dead letters."""
    failed = manifest_state(manifest).where((F.col("artifact_id") == artifact_id) & (F.col("status") == "failed")).select("source_id", "seen_revision", "retry_count")
    missing = chunks.where((F.col("artifact_id") == artifact_id) & F.col("embedding").isNull()).select("row_id", "embedding_input_hash").distinct()
    if dead is not None:
        missing = missing.join(dead.select("row_id", "embedding_input_hash"), ["row_id", "embedding_input_hash"], "left_anti")
    return failed, missing


def store_statistics(sources: DataFrame, chunks: DataFrame, manifest: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: sources, chunks, chunks with embedding, pending, failed and stale states."""
    s = sources.select("source_id").distinct().agg(F.count("*").alias("sources"))
    c = chunks.select("row_id", F.col(embedding).isNotNull().alias("e")).distinct().agg(F.count("*").alias("chunks"), F.count_if("e").alias("with_embedding"))
    m = manifest_state(manifest).agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("pending", "failed", "stale")])
    return s.join(F.broadcast(c)).join(F.broadcast(m))


def optimize(store, **compact: str) -> int:
    """Rewrite the tables of an artifact as its next version, each in few sorted files (table -> column to sort by); the pointer tells when."""
    state, tables = store.load()
    if state != "ready":
        raise LookupError(f"the artifact is {state}")
    own = {name: df.repartitionByRange(compact[name]).sortWithinPartitions(compact[name]) if name in compact else df for name, df in tables.items()}
    return store.save(optimized=True, **own)


def rebuild_all(store, build, files: DataFrame) -> int:
    """Start anew: what the artifact holds is destroyed, everything in files is built again. build: files -> tables by name."""
    tables = build(files)
    store.destroy()
    return store.save(**tables)

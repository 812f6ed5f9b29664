"""Incremental runs: process exactly what was added or changed since the last successful run.

`Ledger` keeps the processed sequence numbers as disjoint intervals; a run subtracts them from what is available, hands
the gaps (late commits included) to the caller and commits output and merged intervals together, in one atomic step.
`stale_sources` finds by such a run the sources whose held content is out of date.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import intervals as iv

MAX_ARTIFACTS = 1_000
_FOLDER_NAME = 36  # characters of a run's folder name, which is all that a marker holds


def active_artifacts(artifacts: DataFrame) -> DataFrame:
    """The ids of the active artifacts; a control table, refused beyond MAX_ARTIFACTS."""
    active = artifacts.where(F.coalesce("is_active", F.lit(False))).select("artifact_id").distinct()
    if active.limit(MAX_ARTIFACTS + 1).count() > MAX_ARTIFACTS:
        raise ValueError(f"more than {MAX_ARTIFACTS} active artifacts")
    return active


def stale_sources(changes: DataFrame, manifest: DataFrame, artifacts: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """(source_id, source_revision, latest_hash, held_hash) of sources whose latest content isn't the held one.

    The latest row has the highest source_revision, however late it arrived. The held row has the highest
    indexed_revision among the manifest rows of the active artifact. Content is raw_content_hash in lower
    case; deletes and what is not held have none. The rows the index has seen already (revision at or below
    the held one) are processed: their numbers are the ledger's intervals to begin with. One run of the ledger
    over the feed gives the gaps; only sources with rows there are compared, and the result is committed with
    the merged intervals. Without a ledger the intervals are used without being kept.

    Nulls: rows without source_id, seq or source_revision describe no change and are left out; a null
    indexed_revision holds nothing. Repeated rows and revisions delivered again count once: of several rows
    of a revision the one with the highest seq counts. A held revision the feed never delivered holds nothing
    that could be compared, so its source comes out unless its latest row is a delete. Empty tables: no
    changes give no rows; no manifest makes every source with content stale. Extra columns are ignored.
    """
    content = F.when(F.col("change_kind") == "delete", F.lit(None)).otherwise(F.lower("raw_content_hash"))
    feed = changes.where("source_id is not null and seq is not null and source_revision is not null").select("seq", "source_id", F.col("source_revision").cast("int").alias("revision"), content.alias("content"))
    by_revision = feed.groupBy("source_id", "revision").agg(F.max_by(F.struct("content"), "seq").alias("c"), F.max("seq").alias("top"))
    held_at = (
        manifest.join(F.broadcast(active_artifacts(artifacts)), "artifact_id", "left_semi")
        .groupBy("source_id")
        .agg(F.max("indexed_revision").cast("int").alias("held_revision"))
        .where("held_revision > 0 and source_id is not null")
    )
    held = by_revision.join(held_at, "source_id").where("revision = held_revision").select("source_id", "held_revision", F.col("c.content").alias("held_hash"))

    processed = iv.islands(feed.join(held.select("source_id", "held_revision"), "source_id").where("revision <= held_revision"))

    def compared(pending: DataFrame) -> DataFrame:
        latest = pending.groupBy("source_id").agg(F.max("revision").alias("source_revision"), F.max_by(F.struct("content"), F.struct("revision", "seq")).alias("c"))
        return (
            latest.join(held, "source_id", "left")
            .select("source_id", "source_revision", F.col("c.content").alias("latest_hash"), "held_hash")
            .where(~F.col("latest_hash").eqNullSafe(F.col("held_hash")))
        )

    if ledger is None:
        return compared(iv.rows_in(feed, iv.subtract(iv.islands(feed), processed)))
    ledger.adopt(processed)
    return ledger.output(ledger.run(feed, compared)["version"])


class Ledger:
    """Versions of (output, processed intervals) under one folder; a version counts once its marker exists.

    A run writes to a folder of its own, which no other run touches, and then creates the marker of its version, which
    names that folder, without overwriting. A run that dies before, or while writing the marker, leaves nothing behind
    that a reader looks at: the next run sees the old intervals and gets the same gaps again. A run that wrote its marker is never repeated. Of two runs at
    once the one that is first to create the marker counts; the other one fails, and can start again on what is left.
    """

    def __init__(self, spark: SparkSession, path: str, block_bits: int = iv.BLOCK_BITS):
        self.spark, self.path, self.block_bits = spark, path.rstrip("/"), block_bits
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _markers(self) -> dict[int, int]:
        """Length of the marker of each version; one small file per run, never one per record."""
        folder = self._p(f"{self.path}/_commits")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return {int(f.getPath().getName()): f.getLen() for f in found if f.getPath().getName().isdigit()}

    def versions(self) -> list[int]:
        """Committed versions."""
        return sorted(v for v, size in self._markers().items() if size == _FOLDER_NAME)

    def _folder(self, version: int) -> str:
        """Where a committed version lies."""
        return f"{self.path}/{self.spark.read.text(f'{self.path}/_commits/{version}', wholetext=True).first()['value']}"

    def processed(self) -> DataFrame:
        """Intervals processed so far."""
        done = self.versions()
        schema = "block long, lo long, hi long"
        return self.spark.read.schema(schema).parquet(f"{self._folder(done[-1])}/intervals") if done else self.spark.createDataFrame([], schema)

    def output(self, version: int) -> DataFrame:
        """What one committed run wrote."""
        return self.spark.read.parquet(f"{self._folder(version)}/output")

    def outputs(self) -> DataFrame | None:
        """What all committed runs wrote."""
        paths = [f"{self._folder(v)}/output" for v in self.versions()]
        paths = [p for p in paths if self._fs.exists(self._p(p))]
        return self.spark.read.parquet(*paths) if paths else None

    def adopt(self, processed: DataFrame) -> int:
        """Begin with intervals that were processed before there was a ledger."""
        if self.versions():
            raise ValueError("the ledger has been begun already")
        folder = self._own_folder()
        processed.select("block", "lo", "hi").write.parquet(f"{self.path}/{folder}/intervals")
        return self._commit(1, folder)

    def run(self, feed: DataFrame, work: Callable[[DataFrame], DataFrame], seq: str = "seq") -> dict:
        """Hand work the unprocessed rows of feed; write its result and the merged intervals; commit both."""
        version = max(self._markers(), default=0) + 1
        folder = self._own_folder()
        base = f"{self.path}/{folder}"
        available, processed = iv.islands(feed, seq, self.block_bits), self.processed()
        iv.subtract(available, processed).write.parquet(f"{base}/gaps")
        gaps = self.spark.read.schema("block long, lo long, hi long").parquet(f"{base}/gaps")
        work(iv.rows_in(feed, gaps, seq, self.block_bits)).write.parquet(f"{base}/output")
        iv.merge(processed, gaps).write.parquet(f"{base}/intervals")
        new = gaps.agg(F.coalesce(F.sum(F.expr("hi - lo + 1")), F.lit(0)).alias("n")).first()["n"]
        return {"version": self._commit(version, folder), "new": new}

    def _own_folder(self) -> str:
        return f"run-{uuid.uuid4().hex}"

    def _commit(self, version: int, folder: str) -> int:
        """Create the marker; fails if another run has taken this version."""
        self._fs.mkdirs(self._p(f"{self.path}/_commits"))
        try:
            marker = self._fs.create(self._p(f"{self.path}/_commits/{version}"), False)
        except Exception as error:
            raise RuntimeError(f"another run has taken version {version}") from error
        marker.write(bytearray(folder.encode()))
        marker.close()
        return version

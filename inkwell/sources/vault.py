"""Notes on a file system as a table, and versioned artifacts with a fingerprint."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.indexing import in_scope

SNAPSHOT = "path string, content string, ctime_ms long, mtime_ms long, size_bytes long"


def read_vault(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("md", "txt"), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, content, ctime_ms, mtime_ms, size_bytes) of the notes below root; paths are relative. File systems tell no creation time, so it is the modification time."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(base)
    prefix = re.sub(r"^file:/*", "/", base)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(prefix) + "/", "")
    ms = F.unix_millis("modificationTime")
    return raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), ms.alias("ctime_ms"), ms.alias("mtime_ms"), F.col("length").alias("size_bytes")).where(in_scope("path", extensions, include, exclude))


class ArtifactStore:
    """Named tables in versions below one folder; a version counts once the pointer names it.

    load tells `empty` (nothing there), `ready`, or `rebuilt` (another fingerprint or an unreadable pointer: start anew).
    """

    def __init__(self, spark: SparkSession, root: str, artifact_id: str, fingerprint: str):
        if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.-]*", artifact_id):
            raise ValueError("an artifact id is a plain name")
        self.spark, self.base, self.artifact_id, self.fingerprint = spark, f"{root.rstrip('/')}/{artifact_id}", artifact_id, fingerprint
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> dict | None:
        at = self._path(f"{self.base}/artifact.json")
        if not self._fs.exists(at):
            return None
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.base}/artifact.json", wholetext=True).collect())
        return json.loads(text)

    def _unreadable(self) -> bool:
        try:
            self._pointer()
        except ValueError:
            return True
        return False

    def times(self) -> tuple[int | None, int | None]:
        """When the artifact was last written and last optimized."""
        p = {} if self._unreadable() else (self._pointer() or {})
        return p.get("written_ms"), p.get("optimized_ms")

    def load(self) -> tuple[str, dict[str, DataFrame]]:
        try:
            p = self._pointer()
        except ValueError:
            return "rebuilt", {}
        if p is None:
            return "empty", {}
        if p.get("fingerprint") != self.fingerprint or p.get("artifact_id") != self.artifact_id:
            return "rebuilt", {}
        return "ready", {name: self.spark.read.parquet(f"{self.base}/v{p['version']}/{name}") for name in p["tables"]}

    def save(self, optimized: bool = False, **tables: DataFrame) -> int:
        """Write all tables as the next version, then swap the pointer; what readers hold stays readable. optimized: note the time as that of the last rewrite."""
        kept = {} if self._unreadable() else (self._pointer() or {})
        version, now = kept.get("version", 0) + 1, round(time.time() * 1000)
        for name, df in tables.items():
            if name == "postings":  # by field, sorted by term: a query reads the row groups of its terms
                df.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(f"{self.base}/v{version}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{self.base}/v{version}/{name}")
        text = json.dumps({"artifact_id": self.artifact_id, "fingerprint": self.fingerprint, "version": version, "tables": sorted(tables), "written_ms": now, "optimized_ms": now if optimized else kept.get("optimized_ms")})
        tmp, final = self._path(f"{self.base}/artifact.new"), self._path(f"{self.base}/artifact.json")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(final, False)
        self._fs.rename(tmp, final)
        return version

    def prune(self, keep: int = 2) -> None:
        """Delete all but the newest versions."""
        found = sorted((int(s.getPath().getName()[1:]) for s in self._fs.listStatus(self._path(self.base)) if re.fullmatch(r"v\d+", s.getPath().getName())), reverse=True)
        for v in found[keep:]:
            self._fs.delete(self._path(f"{self.base}/v{v}"), True)

    def destroy(self) -> None:
        self._fs.delete(self._path(self.base), True)

"""Point and range readers over the catalog, chunk and manifest tables: pruned scans in a defined order, repeated rows once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.mutations import manifest_state


def chunk(chunks: DataFrame, row_id: str) -> DataFrame:
    """The chunk of a row_id; no row if there is none."""
    return chunks.where(F.col("row_id") == row_id).limit(1)


def chunks_of(chunks: DataFrame, source_id: str) -> DataFrame:
    """The chunks of a source in their order in the note."""
    return chunks.where(F.col("source_id") == source_id).dropDuplicates(["row_id"]).orderBy("chunk_ordinal", "row_id")


def source(sources: DataFrame, source_id: str) -> DataFrame:
    return sources.where(F.col("source_id") == source_id).limit(1)


def source_by_path(sources: DataFrame, path: str) -> DataFrame:
    """The source at a path as it is written; of several the first by id."""
    return sources.where(F.col("path_raw") == path).orderBy("source_id").limit(1)


def list_sources(sources: DataFrame) -> DataFrame:
    """All sources by path."""
    return sources.where("source_id is not null").dropDuplicates(["source_id"]).orderBy("path_raw", "source_id")


def manifest_of(manifest: DataFrame, artifact_id: str, source_id: str) -> DataFrame:
    """The state of one source in an artifact."""
    return manifest_state(manifest.where((F.col("artifact_id") == artifact_id) & (F.col("source_id") == source_id)))


def list_manifest(manifest: DataFrame, artifact_id: str, status: str | None = None) -> DataFrame:
    """The states of an artifact, of one status if it is given, by source. The status counts that the latest row has."""
    own = manifest_state(manifest.where(F.col("artifact_id") == artifact_id))
    return (own if status is None else own.where(F.col("status") == status)).orderBy("source_id")

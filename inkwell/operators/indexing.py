"""Raw files to source and chunk rows: structure and chunking in one Arrow pass, all analysis in native columns."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import hashing, markdown, text

NOTE = """path string, ctime_ms long, mtime_ms long, size_bytes long, raw_content_hash string, title_raw string, aliases array<string>,
tags array<string>, headings array<string>, links array<string>, frontmatter_json string, tasks array<struct<text: string, checked: boolean, line: int>>,
fences array<struct<first: int, last: int, language: string>>, content string,
chunks array<struct<structural_anchor: string, chunk_ordinal: int, heading_path: array<string>, block_type: string, line_start: int, line_end: int, char_start: int, char_end: int, text_raw: string>>"""


@dataclass(frozen=True)
class Recipe:
    """What decides how rows look; part of the artifact's fingerprint."""

    artifact_id: str = "main"
    budget: markdown.Budget = field(default_factory=markdown.Budget)
    frontmatter_fields: tuple[str, ...] = ()
    extraction_version: int = 1
    strategy: str = "heading"
    analyzer: str = "unicode-multilingual"
    analyzer_version: int = 1
    ngram_min: int = 2
    ngram_max: int = 3
    nfkc: bool = True
    template: str = "{{title}}\n{{heading_path}}\n{{content}}"

    @property
    def lexical_fingerprint(self) -> str:
        return hashing.hash_canonical([self.analyzer, self.analyzer_version, self.ngram_min, self.ngram_max, self.nfkc])


def in_scope(path: Column | str, extensions: tuple[str, ...] = ("md", "txt"), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a path belongs to the corpus. Patterns are folders or globs with *; exclusion wins; no inclusion means all."""
    import re

    p = F.col(path) if isinstance(path, str) else path

    def matches(pattern: str) -> Column:
        if "*" in pattern:
            return p.rlike("^" + ".*".join(re.escape(x) for x in pattern.split("*")) + "$")
        name = pattern.strip("/")
        return (p == name) | p.startswith(name + "/")

    def any_of(patterns: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for x in patterns:
            out = out | matches(x)
        return out

    wanted = F.lower(F.element_at(F.split(p, r"\."), -1)).isin(*[e.lower() for e in extensions]) & p.contains(".")
    return wanted & ~any_of(exclude) & (any_of(include) if include else F.lit(True))


def extract_notes(files: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """Structure and chunks of (path, content, ctime_ms, mtime_ms, size_bytes). Null contents count as empty."""
    keep, budget = recipe.frontmatter_fields, recipe.budget

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            rows = []
            for path, content, ctime, mtime, size in zip(pdf["path"], pdf["content"], pdf["ctime_ms"], pdf["mtime_ms"], pdf["size_bytes"]):
                content = content or ""
                stem = path.rsplit("/", 1)[-1]
                stem = stem.rsplit(".", 1)[0] if "." in stem[1:] else stem
                note = markdown.extract(content, stem)
                front = {k: note.fields[k] for k in keep if k in note.fields}
                rows.append((
                    path, ctime, mtime, size, hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest(), note.title, note.aliases, note.tags, [t for _, t, _ in note.headings], [x[0] for x in note.links],
                    json.dumps(front, ensure_ascii=False, separators=(",", ":")), [{"text": a, "checked": b, "line": c} for a, b, c in note.tasks], [{"first": a, "last": b, "language": c or None} for a, b, c in note.fences], content, markdown.chunks(note, budget),
                ))
            yield pd.DataFrame(rows, columns=["path", "ctime_ms", "mtime_ms", "size_bytes", "raw_content_hash", "title_raw", "aliases", "tags", "headings", "links", "frontmatter_json", "tasks", "fences", "content", "chunks"])

    return files.where("path is not null").select("path", "content", "ctime_ms", "mtime_ms", "size_bytes").mapInPandas(run, NOTE)


def source_rows(notes: DataFrame, recipe: Recipe = Recipe(), now_ms: int = 0, revision: int = 1) -> DataFrame:
    """The catalog rows of extracted notes; source_id comes with them or is derived from the path once, at creation."""
    parts = text.path_parts("path")
    own = notes.withColumn("_p", parts).withColumn("_s", text.script_counts("content")).withColumn("_l", text.language_of("_s"))
    sid = F.col("source_id") if "source_id" in notes.columns else F.substring(F.sha2(F.col("path"), 256), 1, 32)
    return own.select(
        sid.alias("source_id"), F.col("path").alias("path_raw"), text.normalize_lexical("path", recipe.nfkc).alias("path_norm"), F.col("_p.filename").alias("filename_raw"), F.lower("_p.filename").alias("filename_norm"),
        F.col("_p.folder").alias("folder_raw"), F.lower("_p.folder").alias("folder_norm"), F.col("_p.extension").alias("extension"), "title_raw", text.normalize_lexical("title_raw", recipe.nfkc).alias("title_norm"), "aliases", "tags", "headings", "links", "frontmatter_json",
        "ctime_ms", "mtime_ms", "size_bytes", "raw_content_hash", hashing.metadata_projection_hash(F.col("path"), F.col("title_raw"), F.col("aliases"), F.col("tags"), F.col("frontmatter_json"), F.col("mtime_ms"), F.col("size_bytes")).alias("metadata_projection_hash"),
        F.lit(revision).alias("source_revision"), F.col("_l.primary_language").alias("primary_language"), F.col("_l.languages").alias("languages"), F.col("_l.scripts").alias("scripts"), F.lit(now_ms).cast("long").alias("created_ms"), F.lit(now_ms).cast("long").alias("updated_ms"),
    )


def chunk_rows(notes: DataFrame, recipe: Recipe = Recipe(), now_ms: int = 0, revision: int = 1) -> DataFrame:
    """The chunk rows of extracted notes with all term arrays and hashes."""
    sid = F.col("source_id") if "source_id" in notes.columns else F.substring(F.sha2(F.col("path"), 256), 1, 32)
    lo, hi, nfkc = recipe.ngram_min, recipe.ngram_max, recipe.nfkc
    by_note = notes.select(sid.alias("source_id"), "path", "title_raw", F.array_join("aliases", " ").alias("_alias"), "tags", "mtime_ms", "chunks").withColumns({
        "_p": text.path_parts("path"), "path_terms": text.path_terms("path"), "path_norm": text.normalize_lexical("path", nfkc), "extraction_hash": hashing.extraction_hash(recipe.extraction_version, recipe.strategy, F.col("chunks")),
    })
    by_note = text.with_analysis(by_note, "title_raw", "_t", lo, hi, nfkc, False, False)
    by_note = text.with_analysis(by_note, "_alias", "_a", lo, hi, nfkc, False, False)
    rows = by_note.select(*[c for c in by_note.columns if c != "chunks"], F.explode("chunks").alias("c")).select("*", "c.*").withColumn("_heads", F.array_join("heading_path", " "))
    rows = text.with_analysis(rows, "text_raw", "_x", lo, hi, nfkc)
    rows = text.with_analysis(rows, "_heads", "_h", lo, hi, nfkc, False, False)
    rows = rows.withColumn("_s", text.script_counts("text_raw")).withColumn("_l", text.language_of("_s"))
    rendered, _, _ = text.render_template(recipe.template, {"title": F.col("title_raw"), "heading_path": F.array_join("heading_path", " > "), "content": F.col("text_raw"), "path": F.col("path"), "tags": F.array_join("tags", ", ")})
    return rows.select(
        hashing.row_id(F.lit(recipe.artifact_id), F.col("source_id"), F.col("structural_anchor"), F.col("chunk_ordinal")).alias("row_id"), F.lit(recipe.artifact_id).alias("artifact_id"), "source_id", F.lit(revision).alias("source_revision"), "structural_anchor", "chunk_ordinal", "heading_path", "block_type", "text_raw",
        F.concat("_x.terms", "_x.secondary_terms").alias("lexical_terms"), F.col("_x.ngrams").alias("lexical_ngrams"), F.col("_x.identifier_terms").alias("identifier_terms"), F.col("_t.terms").alias("title_terms"), F.col("_a.terms").alias("alias_terms"), F.col("_h.terms").alias("heading_terms"),
        F.transform("tags", F.lower).alias("tag_terms"), "path_terms", F.col("_l.languages").alias("language_codes"), F.col("_l.scripts").alias("script_codes"), "line_start", "line_end", "char_start", "char_end", F.sha2("text_raw", 256).alias("raw_chunk_hash"), "extraction_hash",
        hashing.lexical_input_hash(recipe.analyzer, recipe.analyzer_version, recipe.lexical_fingerprint, F.col("text_raw"), F.col("heading_path"), F.col("title_raw"), F.col("tags"), F.col("path")).alias("lexical_input_hash"), hashing.embedding_input_hash(rendered).alias("embedding_input_hash"),
        F.lit(None).cast("array<float>").alias("embedding"), rendered.alias("embedding_input"), "mtime_ms", F.lower("_p.folder").alias("folder_norm"), "path_norm", F.col("_p.extension").alias("extension"), "tags", F.lit(now_ms).cast("long").alias("created_ms"), F.lit(now_ms).cast("long").alias("updated_ms"),
    )


def scan_diff(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, outcome) of a full scan: added, changed, touched (times only), unchanged or removed.

    files: path, raw_content_hash, mtime_ms, size_bytes. catalog: path_raw and the same. One co-partitioned full
    outer join; paths are unique on either side once exact duplicates are dropped.
    """
    f = files.where("path is not null").select("path", F.lower("raw_content_hash").alias("fh"), F.col("mtime_ms").alias("fm"), F.col("size_bytes").alias("fs"), F.lit(True).alias("_f")).dropDuplicates(["path"])
    c = catalog.where("path_raw is not null").select(F.col("path_raw").alias("path"), F.lower("raw_content_hash").alias("ch"), F.col("mtime_ms").alias("cm"), F.col("size_bytes").alias("cs"), F.lit(True).alias("_c")).dropDuplicates(["path"])
    outcome = (
        F.when(F.col("_c").isNull(), "added").when(F.col("_f").isNull(), "removed").when(~F.col("fh").eqNullSafe(F.col("ch")), "changed")
        .when(~F.col("fm").eqNullSafe(F.col("cm")) | ~F.col("fs").eqNullSafe(F.col("cs")), "touched").otherwise("unchanged")
    )
    return f.join(c, "path", "full_outer").select("path", outcome.alias("outcome"))

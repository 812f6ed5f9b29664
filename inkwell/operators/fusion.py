"""Reciprocal rank fusion of ranked lists, aggregation by source, diversity, and result rows with reasons."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from inkwell.functions import text


@dataclass(frozen=True)
class Weights:
    k: float = 60.0
    exact: float = 1.4
    lexical: float = 1.0
    semantic: float = 1.0


HIT = "struct<field: string, phrase: string, offset: int, line: int, match_length: int>"
CANDIDATE = f"key string, row_id string, source_id string, exact_rank int, lexical_rank int, semantic_rank int, exact_hit {HIT}, matched_fields array<string>, matched_terms array<string>, score double"


def stack(exact: DataFrame | None, lexical: DataFrame | None, semantic: DataFrame | None) -> DataFrame:
    """The lists one below the other: (key, row_id, source_id, list, rank, hit, fields, terms)."""
    none = F.lit(None).cast("array<string>")
    parts = []
    for name, df in (("e", exact), ("l", lexical), ("s", semantic)):
        if df is not None:
            hit = F.struct("field", "phrase", "offset", "line", "match_length").cast(HIT) if name == "e" else F.lit(None).cast(HIT)
            fields, terms = (F.col("matched_fields"), F.col("matched_terms")) if name == "l" else (none, none)
            parts.append(df.select(F.coalesce("row_id", F.concat(F.lit("source:"), "source_id")).alias("key"), "row_id", "source_id", F.lit(name).alias("list"), "rank", hit.alias("hit"), fields.alias("fields"), terms.alias("terms")))
    return reduce(DataFrame.unionByName, parts)


def fuse_rows(rows: Iterable[Row], weights: Weights = Weights()) -> list[dict]:
    """As fuse, for stacked lists that have been collected: top-k lists are bounded by their limits."""
    found: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["list"], r["rank"])):
        own = found.setdefault(r["key"], dict.fromkeys(("exact_rank", "lexical_rank", "semantic_rank", "exact_hit", "matched_fields", "matched_terms")) | {"key": r["key"], "row_id": r["row_id"], "source_id": r["source_id"]})
        of = {"e": "exact_rank", "l": "lexical_rank", "s": "semantic_rank"}[r["list"]]
        if own[of] is None:
            own[of] = r["rank"]
            if r["list"] == "e":
                own["exact_hit"] = r["hit"].asDict()
            elif r["list"] == "l":
                own["matched_fields"], own["matched_terms"] = r["fields"], r["terms"]
    for own in found.values():
        own["score"] = 0.0
        for w, c in ((weights.exact, "exact_rank"), (weights.lexical, "lexical_rank"), (weights.semantic, "semantic_rank")):
            own["score"] += w / (weights.k + own[c]) if own[c] is not None else 0.0
    return sorted(found.values(), key=lambda c: (-c["score"], c["key"]))


def fuse(exact: DataFrame | None, lexical: DataFrame | None, semantic: DataFrame | None, weights: Weights = Weights()) -> DataFrame:
    """(key, row_id, source_id, score, exact_rank, lexical_rank, semantic_rank, exact_hit, matched_fields, matched_terms).

    The lists are stacked and grouped once by key, which is the row, or source:<id> for hits in a source. The first
    rank of a key in a list counts.
    """
    stacked = stack(exact, lexical, semantic)

    def rank(of: str) -> Column:
        return F.min(F.when(F.col("list") == of, F.col("rank")))

    ranks = stacked.groupBy("key").agg(
        F.max("row_id").alias("row_id"), F.max("source_id").alias("source_id"), rank("e").alias("exact_rank"), rank("l").alias("lexical_rank"), rank("s").alias("semantic_rank"),
        F.min_by("hit", F.when(F.col("list") == "e", F.col("rank"))).alias("exact_hit"), F.min_by("fields", F.when(F.col("list") == "l", F.col("rank"))).alias("matched_fields"), F.min_by("terms", F.when(F.col("list") == "l", F.col("rank"))).alias("matched_terms"),
    )
    score = F.lit(0.0)
    for w, c in ((weights.exact, "exact_rank"), (weights.lexical, "lexical_rank"), (weights.semantic, "semantic_rank")):
        score = score + F.coalesce(F.lit(float(w)) / (F.lit(float(weights.k)) + F.col(c)), F.lit(0.0))
    return ranks.withColumn("score", score)


def exclude_text(fused: DataFrame, chunks: DataFrame, excluded: list[str]) -> DataFrame:
    """Drop rows whose raw text contains an excluded phrase; hits in sources stay."""
    if not excluded:
        return fused
    low = F.lower("text_raw")
    bad = F.lit(False)
    for e in excluded:
        bad = bad | F.contains(low, F.lit(e.lower()))
    return fused.join(chunks.where(bad).select("row_id").distinct(), "row_id", "left_anti")


def by_source(fused: DataFrame, method: str = "max") -> DataFrame:
    """(source_id, score, best_key, block_count): the best block's score or the mean of the best three."""
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "key")
    numbered = fused.withColumn("_n", F.row_number().over(order))
    score = F.max("score") if method == "max" else F.avg(F.when(F.col("_n") <= 3, F.col("score")))
    return numbered.groupBy("source_id").agg(score.alias("score"), F.min_by("key", "_n").alias("best_key"), F.count("*").alias("block_count"))


def diversify(fused: DataFrame, most: int = 2) -> DataFrame:
    """At most `most` blocks of a source."""
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "key")
    return fused.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def reasons() -> Column:
    """array<struct(kind, detail, rank)>: why a row is among the results."""
    field = F.col("exact_hit.field")
    kind = F.when(field == "text", "exact_phrase").otherwise(F.concat(F.lit("matched_"), field))
    signals = sum(F.col(c).isNotNull().cast("int") for c in ("exact_rank", "lexical_rank", "semantic_rank"))
    none = F.lit(None).cast("int")
    return F.array_compact(
        F.array(
            F.when(F.col("exact_hit").isNotNull(), F.struct(kind.alias("kind"), F.col("exact_hit.phrase").alias("detail"), F.coalesce(F.col("exact_hit.line"), none).alias("rank"))),
            F.when(F.col("lexical_rank").isNotNull(), F.struct(F.lit("lexical").alias("kind"), F.array_join("matched_terms", " ").alias("detail"), F.col("lexical_rank").alias("rank"))),
            F.when(F.col("semantic_rank").isNotNull(), F.struct(F.lit("semantic").alias("kind"), F.lit("").alias("detail"), F.col("semantic_rank").alias("rank"))),
            F.when(signals >= 2, F.struct(F.lit("hybrid").alias("kind"), F.lit("").alias("detail"), none.alias("rank"))),
        )
    )


def hydrate(candidates: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Result rows of the few candidates of a page: source fields, position, snippet and reasons. Vanished sources drop out."""
    c = chunks.select("row_id", "line_start", "line_end", "char_start", "char_end", "heading_path", "text_raw", "language_codes").dropDuplicates(["row_id"])
    s = sources.select("source_id", "path_raw", "filename_raw", "title_raw", "folder_raw", "languages").dropDuplicates(["source_id"])
    few = F.broadcast(candidates)  # a page of results
    joined = c.join(few, "row_id", "right").join(s, "source_id")
    in_text = F.when(F.col("exact_hit.field") == "text", F.col("exact_hit.offset"))
    shown = joined.withColumn("_s", text.snippet("text_raw", in_text, F.col("exact_hit.match_length"))).withColumn("reasons", reasons())
    extra = [x for x in ("rank", "block_count") if x in candidates.columns]
    return shown.select(
        F.col("key").alias("id"), "source_id", "row_id", F.col("path_raw").alias("path"), F.col("filename_raw").alias("filename"), F.col("title_raw").alias("title"), F.col("folder_raw").alias("folder"), "line_start", "line_end", "char_start", "char_end", "heading_path",
        F.col("_s.snippet").alias("snippet"), F.col("_s.highlight_start").alias("highlight_start"), F.col("_s.highlight_end").alias("highlight_end"), "score", "reasons", F.coalesce("language_codes", "languages").alias("languages"), *extra,
    )

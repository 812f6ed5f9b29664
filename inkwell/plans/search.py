"""The search service: parse, plan, retrieve, fuse, exclude, aggregate or diversify, hydrate. One lazy plan, one action by the caller."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import exact, fusion, lexical, semantic
from inkwell.operators.filters import RowFilter, apply_filter
from inkwell.plans import query as q
from inkwell.session import small


@dataclass(frozen=True)
class Profile:
    """Default limits and weights."""

    exact_limit: int = 50
    lexical_limit: int = 80
    semantic_limit: int = 80
    weights: fusion.Weights = field(default_factory=fusion.Weights)
    max_per_source: int = 2
    aggregation: str = "max"
    metric: str = "cosine"
    query_template: str = "{{content}}"


@dataclass(frozen=True)
class Response:
    results: DataFrame
    plan: q.Plan
    query: q.Query
    degraded: tuple[str, ...]


class SearchService:
    """Searches sources and chunks. Without a saved index the postings of a query's terms, and no others, are built for it."""

    def __init__(self, sources: DataFrame, chunks: DataFrame, postings: DataFrame | None = None, statistics: DataFrame | None = None, embed: Callable[[str], list[float] | None] | None = None, profile: Profile = Profile()):
        self.sources, self.chunks, self.profile, self.embed = sources, chunks, profile, embed
        self.postings = postings
        self.statistics = statistics if statistics is not None else lexical.field_statistics(chunks)
        self.spark = sources.sparkSession

    def search(self, raw: str, mode: str = "auto", limit: int = 20, result_type: str = "blocks", base: RowFilter | None = None, case_sensitive: bool = False) -> Response:
        """One lazy plan from the tables to the page."""
        query, plan, rows, degraded = self._planned(raw, mode, base)
        if plan.metadata_only:
            return Response(metadata_scan(self.sources, rows, limit), plan, query, degraded)
        lists, weights, degraded = self._lists(query, plan, rows, case_sensitive, degraded)
        visible = fusion.exclude_text(fusion.fuse(*lists, weights), self.chunks, list(query.excluded))
        if result_type == "sources":
            best = lexical.ranked(fusion.by_source(visible, self.profile.aggregation), limit, F.desc("score"), F.asc("source_id"))
            page = visible.drop("score", "source_id").join(F.broadcast(best), F.col("key") == F.col("best_key")).drop("best_key")
        else:
            page = lexical.ranked(fusion.diversify(visible, self.profile.max_per_source), limit, F.desc("score"), F.asc("key"))
        return Response(fusion.hydrate(page, self.chunks, self.sources), plan, query, degraded)

    def search_now(self, raw: str, mode: str = "auto", limit: int = 20, result_type: str = "blocks", base: RowFilter | None = None, case_sensitive: bool = False) -> Response:
        """The same results for someone who waits: the top-k lists, which their limits bound, are collected in one job and fused here; only the page is looked up."""
        query, plan, rows, degraded = self._planned(raw, mode, base)
        if plan.metadata_only:
            return Response(metadata_scan(self.sources, rows, limit), plan, query, degraded)
        lists, weights, degraded = self._lists(query, plan, rows, case_sensitive, degraded)
        found = fusion.fuse_rows(fusion.stack(*lists).collect(), weights)
        own = [c["row_id"] for c in found if c["row_id"] is not None]
        if query.excluded and own:
            low, bad = F.lower("text_raw"), F.lit(False)
            for e in query.excluded:
                bad = bad | F.contains(low, F.lit(e.lower()))
            gone = {r["row_id"] for r in self.chunks.where(F.col("row_id").isin(*own) & bad).select("row_id").collect()}
            found = [c for c in found if c["row_id"] not in gone]
        by_source: dict[str, list[dict]] = {}
        for c in found:
            by_source.setdefault(c["source_id"], []).append(c)
        extra = ", rank int"
        if result_type == "sources":
            mean = self.profile.aggregation != "max"
            page = [cs[0] | {"score": sum(c["score"] for c in cs[:3]) / len(cs[:3]) if mean else cs[0]["score"], "block_count": len(cs)} for cs in by_source.values()]
            page = sorted(page, key=lambda c: (-c["score"], c["source_id"]))[:limit]
            extra += ", block_count long"
        else:
            kept = {id(c) for cs in by_source.values() for c in cs[: self.profile.max_per_source]}
            page = [c for c in found if id(c) in kept][:limit]
        schema = fusion.CANDIDATE + extra
        names = [x.split()[0] for x in re.split(r", (?![^<]*>)", schema)]
        candidates = small(self.spark, [tuple((c | {"rank": i + 1}).get(n) for n in names) for i, c in enumerate(page)], schema)
        chunks = self.chunks.where(F.col("row_id").isin([c["row_id"] for c in page if c["row_id"] is not None]))
        sources = self.sources.where(F.col("source_id").isin([c["source_id"] for c in page]))
        return Response(fusion.hydrate(candidates, chunks, sources), plan, query, degraded)

    def _planned(self, raw: str, mode: str, base: RowFilter | None) -> tuple[q.Query, q.Plan, RowFilter, tuple[str, ...]]:
        query = q.parse(raw)
        plan = q.plan(query, mode, embedding=self.embed is not None and "embedding" in self.chunks.columns)
        return query, plan, q.row_filter(query, base), plan.degraded

    def _lists(self, query: q.Query, plan: q.Plan, rows: RowFilter, case_sensitive: bool, degraded: tuple[str, ...]) -> tuple[tuple[DataFrame | None, ...], fusion.Weights, tuple[str, ...]]:
        """The ranked lists of the stages that run, and the weights to fuse them with."""
        p = self.profile
        found_exact = found_lexical = found_semantic = None
        if plan.exact:
            found_exact = exact.search(self.sources, self.chunks, q.needles(query, plan.mode == "exact"), p.exact_limit, case_sensitive, rows)
        if plan.lexical:
            (terms, ngrams, identifiers), *rest = map(text.analyze_words, (query.content_text, *query.excluded))
            excluded = [x for t, n, _ in rest for x in t + n]
            wanted = lexical.query_terms(self.spark, terms, ngrams, identifiers)
            every = list(dict.fromkeys([*terms, *ngrams, *identifiers, *excluded]))
            own = lexical.build_postings(self.chunks, every) if self.postings is None else lexical.only_terms(self.postings, every)
            found_lexical = lexical.search(self.chunks, own, self.statistics, wanted, p.lexical_limit, excluded, rows)
        if plan.semantic:
            vector = self.embed(text.render_words(p.query_template, query.content_text))
            if vector is None:
                degraded += ("semantic_unavailable",)
            else:
                found_semantic = semantic.search(self.chunks, vector, p.semantic_limit, p.metric, rows)
        if found_exact is None and found_lexical is None and found_semantic is None:
            found_exact = exact.search(self.sources, self.chunks, [], 1)
        w = p.weights
        return (found_exact, found_lexical, found_semantic), fusion.Weights(w.k, w.exact, w.lexical, w.semantic * plan.semantic_factor), tuple(dict.fromkeys(degraded))


def save_index(store, sources: DataFrame, chunks: DataFrame) -> int:
    """Write sources, chunks (without term arrays), postings and statistics as the next version of an artifact."""
    slim = chunks.dropDuplicates(["row_id"]).drop(*[c for c in chunks.columns if c.endswith(("_terms", "_ngrams"))])
    postings = lexical.with_frequencies(lexical.build_postings(chunks), chunks)
    return store.save(sources=sources.dropDuplicates(["source_id"]), chunks=slim, postings=postings, statistics=lexical.field_statistics(chunks))


def open_index(store, embed: Callable[[str], list[float] | None] | None = None, profile: Profile = Profile()) -> SearchService:
    """A service over a saved artifact."""
    state, tables = store.load()
    if state != "ready":
        raise LookupError(f"the artifact is {state}")
    statistics = small(store.spark, [tuple(r) for r in tables["statistics"].select("field", "n_docs", "avg_len").collect()], "field string, n_docs long, avg_len double")  # a row for each field
    return SearchService(tables["sources"], tables["chunks"], tables["postings"], statistics, embed, profile)


def metadata_scan(sources: DataFrame, rows: RowFilter, limit: int) -> DataFrame:
    """Sources that match a filter, by path."""
    own = apply_filter(sources, rows).select("source_id", F.col("path_raw").alias("path"), F.col("filename_raw").alias("filename"), F.col("title_raw").alias("title"), F.col("folder_raw").alias("folder"), "languages").dropDuplicates(["source_id"])
    return own.orderBy("path", "source_id").limit(limit)

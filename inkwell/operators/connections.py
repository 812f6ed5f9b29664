"""Related notes: nearest blocks, links in both directions and shared tags, with evidence and feedback."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import lexical, semantic
from inkwell.operators.filters import RowFilter

# Bonuses of link signals, blocks taken and neighbours asked per block.
WIKILINK, BACKLINK, SHARED_TAG, TAG_CAP = 0.2, 0.15, 0.05, 2
BLOCKS, NEIGHBOURS = 4, 24
SELECTION_TOKENS = 512


def names(sources: DataFrame) -> DataFrame:
    """(source_id, name): the names by which links reach a note."""
    return sources.select("source_id", F.explode(text.link_names("path_raw", "title_raw")).alias("name")).where("name <> ''").distinct()


def targets(sources: DataFrame) -> DataFrame:
    """(source_id, name): the names a note links to."""
    return sources.select("source_id", F.explode("links").alias("link")).where("link is not null").select("source_id", text.link_target("link").alias("name")).where("name <> ''").distinct()


def link_graph(sources: DataFrame) -> DataFrame:
    """(src, dst): every link from a note to another. Many notes may share a name; links per note are few, so the join keeps to the links' size."""
    edges = targets(sources).withColumnRenamed("source_id", "src").join(names(sources).withColumnRenamed("source_id", "dst"), "name")
    return edges.where("src <> dst").select("src", "dst").distinct()


def link_signals(sources: DataFrame, source_id: str) -> DataFrame:
    """(source_id, kind, score, detail): wikilinks, backlinks and shared tags of one note."""
    once = sources.dropDuplicates(["source_id"])
    me = once.where(F.col("source_id") == source_id)
    others = once.where(F.col("source_id") != source_id)
    my_targets, my_names = F.broadcast(targets(me).select("name")), F.broadcast(names(me).select("name"))
    wiki = names(others).join(my_targets, "name", "left_semi").select("source_id").distinct().select("source_id", F.lit("wikilink").alias("kind"), F.lit(WIKILINK).alias("score"), F.lit("").alias("detail"))
    back = targets(others).join(my_names, "name", "left_semi").select("source_id").distinct().select("source_id", F.lit("backlink").alias("kind"), F.lit(BACKLINK).alias("score"), F.lit("").alias("detail"))
    tag = F.lower("tag")
    my_tags = F.broadcast(me.select(F.explode("tags").alias("tag")).select(tag.alias("t")).distinct())
    shared = others.select("source_id", F.explode("tags").alias("tag")).withColumn("t", tag).join(my_tags, "t", "left_semi").groupBy("source_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("t")).alias("ts"))
    tags = shared.select("source_id", F.lit("shared_tag").alias("kind"), (F.lit(SHARED_TAG) * F.least("n", F.lit(TAG_CAP))).alias("score"), F.array_join("ts", " ").alias("detail"))
    return wiki.unionByName(back).unionByName(tags)


def representative_blocks(chunks: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The longest chunks with embeddings of each source."""
    order = Window.partitionBy("source_id").orderBy(F.desc(F.length("text_raw")), "chunk_ordinal", "row_id")
    own = chunks.where("embedding is not null and size(embedding) > 0").dropDuplicates(["row_id"])
    return own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= blocks).drop("_n")


def semantic_signals(chunks: DataFrame, source_id: str) -> DataFrame:
    """(source_id, kind, score, detail): the best similarity of another note's block, above 0, and that block."""
    mine = representative_blocks(chunks.where(F.col("source_id") == source_id)).select(F.col("row_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("source_id").alias("exclude_source_id"))
    near = semantic.search_many(chunks, mine, NEIGHBOURS)
    return near.withColumn("s", text.clamp01(F.col("similarity"))).where("s > 0").groupBy("source_id").agg(F.max("s").alias("score"), F.max_by("row_id", F.struct("s", "row_id")).alias("detail")).select("source_id", F.lit("semantic").alias("kind"), "score", "detail")


def lexical_signals(hits: DataFrame) -> DataFrame:
    """(source_id, kind, score, detail) from lexical hits: scaled by the best hit, 0.6 at most."""
    best = Window.partitionBy(F.lit(1))  # the hits of one page
    scaled = hits.withColumn("s", text.clamp01(F.col("score") / F.max("score").over(best)) * 0.6).where("s > 0")
    return scaled.groupBy("source_id").agg(F.max("s").alias("score"), F.max_by("row_id", F.struct("s", "row_id")).alias("detail")).select("source_id", F.lit("lexical").alias("kind"), "score", "detail")


def lexical_neighbours(chunks: DataFrame, words: str, exclude: str | None = None, postings: DataFrame | None = None, statistics: DataFrame | None = None) -> DataFrame | None:
    """Signals of the blocks that words find; None if there is nothing in them to look for. Without an index one is built of these words alone."""
    terms, ngrams, identifiers = text.analyze_words(words)
    if not terms and not ngrams:
        return None
    every = list(dict.fromkeys([*terms, *ngrams, *identifiers]))
    own = lexical.build_postings(chunks, every) if postings is None else lexical.only_terms(postings, every)
    known = lexical.field_statistics(chunks) if statistics is None else statistics
    rows = None if exclude is None else RowFilter(exclude_source_ids=(exclude,))
    return lexical_signals(lexical.search(chunks, own, known, lexical.query_terms(chunks.sparkSession, terms, ngrams, identifiers), 2 * NEIGHBOURS, row_filter=rows))


def connect(signals: DataFrame, sources: DataFrame, chunks: DataFrame, limit: int = 20, feedback: DataFrame | None = None, exclude: str | None = None) -> DataFrame:
    """(source_id, path, title, score, pinned, edges, evidence_row_id, snippet, rank): signals added up, hidden notes out, pinned first."""
    total = signals.groupBy("source_id").agg(F.round(F.sum("score"), 9).alias("score"), F.array_sort(F.collect_list(F.struct("kind", "score", "detail"))).alias("edges"), F.max(F.when(F.col("kind").isin("semantic", "lexical"), F.col("detail"))).alias("evidence_row_id"))
    if exclude is not None:
        total = total.where(F.col("source_id") != exclude)
    if feedback is not None:
        total = total.join(feedback.where("hidden").select("source_id"), "source_id", "left_anti").join(feedback.where("pinned").select("source_id", F.lit(True).alias("pinned")).distinct(), "source_id", "left")
    else:
        total = total.withColumn("pinned", F.lit(False))
    known = total.withColumn("pinned", F.coalesce("pinned", F.lit(False))).join(sources.select("source_id", F.col("path_raw").alias("path"), F.col("title_raw").alias("title")).dropDuplicates(["source_id"]), "source_id")
    from inkwell.operators.lexical import ranked

    page = ranked(known, limit, F.desc("pinned"), F.desc("score"), F.asc("source_id"))
    evidence = chunks.select(F.col("row_id").alias("evidence_row_id"), F.when(F.length("text_raw") > 200, F.concat(F.substring("text_raw", 1, 200), F.lit("…"))).otherwise(F.col("text_raw")).alias("snippet")).join(F.broadcast(page.select("evidence_row_id").distinct()), "evidence_row_id", "left_semi").dropDuplicates(["evidence_row_id"])
    return page.join(evidence, "evidence_row_id", "left").select("source_id", "path", "title", "score", "pinned", "edges", "evidence_row_id", "snippet", "rank")


@dataclass(frozen=True)
class Related:
    """Related notes, how they were found (semantic, lexical_fallback or links_only), and whether the selection was cut."""

    items: DataFrame
    mode: str
    truncated: bool = False


def for_source(sources: DataFrame, chunks: DataFrame, source_id: str, limit: int = 20, feedback: DataFrame | None = None, postings: DataFrame | None = None, statistics: DataFrame | None = None) -> Related:
    """Notes related to a note: by its blocks' vectors; if it has none, by its title and headings; links and tags always count.

    A note that isn't there has no related notes.
    """
    own = sources.where(F.col("source_id") == source_id).select("title_raw", *[c for c in ("headings",) if c in sources.columns]).first()
    signals, mode = link_signals(sources, source_id), "links_only"
    if own is not None and chunks.where((F.col("source_id") == source_id) & (F.size("embedding") > 0)).limit(1).count():
        signals, mode = semantic_signals(chunks, source_id).unionByName(signals), "semantic"
    elif own is not None:
        words = " ".join(filter(None, [own["title_raw"], *((own["headings"] or []) if "headings" in sources.columns else [])]))
        found = lexical_neighbours(chunks, words, source_id, postings, statistics)
        if found is not None:
            signals, mode = found.unionByName(signals), "lexical_fallback"
    return Related(connect(signals, sources, chunks, limit, feedback, source_id), mode)


def for_selection(
    sources: DataFrame, chunks: DataFrame, selection: str, active_id: str | None = None, limit: int = 20, embed: Callable[[str], list[float] | None] | None = None, feedback: DataFrame | None = None,
    template: str = "{{content}}", postings: DataFrame | None = None, statistics: DataFrame | None = None, metric: str = "cosine",
) -> Related:
    """Notes related to a selected text, which is never indexed: by its vector, without one by its words. Links don't count."""
    words, was_cut = truncate_selection(selection)
    vector = embed(text.render_words(template, words)) if embed is not None else None
    if vector is not None:
        rows = None if active_id is None else RowFilter(exclude_source_ids=(active_id,))
        near = semantic.search(chunks, vector, 2 * NEIGHBOURS, metric, rows).withColumn("s", text.clamp01(F.col("rank_score"))).where("s > 0")
        signals, mode = near.groupBy("source_id").agg(F.max("s").alias("score"), F.max_by("row_id", F.struct("s", "row_id")).alias("detail")).select("source_id", F.lit("semantic").alias("kind"), "score", "detail"), "semantic"
    else:
        signals, mode = lexical_neighbours(chunks, words, active_id, postings, statistics), "lexical_fallback"
        if signals is None:
            signals = chunks.sparkSession.createDataFrame([], "source_id string, kind string, score double, detail string")
    return Related(connect(signals, sources, chunks, limit, feedback, active_id), mode, was_cut)


def truncate_selection(selection: str, budget: int = SELECTION_TOKENS) -> tuple[str, bool]:
    """The longest beginning within the token budget, and whether anything was cut."""
    from inkwell.functions.markdown import estimate_tokens

    if estimate_tokens(selection) <= budget:
        return selection, False
    low, high = 0, len(selection)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if estimate_tokens(selection[:mid]) <= budget else (low, mid - 1)
    return selection[:low], True

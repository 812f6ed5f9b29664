"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import canonical, language, markup, mixing, neighbours, packing, relevance, spans, tokens
from inkwell.queries import VECTORS_SQL
from inkwell.session import cut
from inkwell.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The markup families of each chunk."""
    done = markup.render_markup(table(spark, d, "chunks", "row_id", "text_raw"), "row_id")
    return done.select("row_id", F.explode("families").alias("markup_family")).distinct()


@query()
def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of each chunk."""
    return markup.render_markup(table(spark, d, "chunks", "row_id", "text_raw").dropDuplicates(["row_id"]), "row_id").select("row_id", "clean_text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.decode(table(spark, d, "chunks", "row_id", "source_id", "artifact_id", "embedding_base64"), table(spark, d, "artifacts", "artifact_id", "is_active", "dimension"))


@query(
    f"WITH {VECTORS_SQL}, unit AS (SELECT row_id, source_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM vecs WHERE list_inner_product(v, v) > 0),"
    + """near AS (SELECT a.row_id AS x, b.row_id AS y, list_inner_product(a.u, b.u) AS sim FROM unit a JOIN unit b ON a.row_id <> b.row_id AND a.source_id IS DISTINCT FROM b.source_id QUALIFY row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_inner_product(a.u, b.u), 6) DESC, b.row_id) <= 10)
SELECT n.x AS row_id_a, n.y AS row_id_b FROM near n JOIN near m ON n.x = m.y AND n.y = m.x WHERE n.x < n.y AND n.sim >= 0.95"""
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that are among each other's 10 most similar, with a cosine similarity of at least 0.95."""
    return neighbours.mutual_pairs(neighbours.nearest_vectors(_vectors(spark, d), 10, min_similarity=0.95), 0.95)


@query()
def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar chunks of other sources for every chunk."""
    return neighbours.nearest_vectors(_vectors(spark, d), 10)


@query()
def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the 10 nearest against brute force, for every vector whose hashed row_id is divisible by 100, over all vectors."""
    return neighbours.recall(cut(_vectors(spark, d), "vectors"), 10, F.pmod(F.xxhash64("row_id"), F.lit(100)) == 0)


_P4_SQL = """
WITH once AS (SELECT DISTINCT row_id, source_id, lexical_terms, lexical_ngrams, title_terms, tag_terms FROM chunks WHERE row_id IS NOT NULL),
e AS (
  SELECT row_id, source_id, 'lexical_terms' AS field_name, unnest(lexical_terms) AS term FROM once UNION ALL
  SELECT row_id, source_id, 'lexical_ngrams', unnest(lexical_ngrams) FROM once UNION ALL
  SELECT row_id, source_id, 'title_terms', unnest(title_terms) FROM once UNION ALL
  SELECT row_id, source_id, 'tag_terms', unnest(tag_terms) FROM once
), p AS (SELECT row_id, source_id, field_name, term, count(*) AS tf FROM e WHERE term IS NOT NULL GROUP BY ALL),
t AS (SELECT field_name, term, count(*) AS df, count(DISTINCT source_id) AS n_sources FROM p GROUP BY ALL)
"""


def _p4_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks", "row_id", "source_id", *relevance.FIELDS)


@query(_P4_SQL + "SELECT row_id, field_name, term FROM p JOIN t USING (field_name, term) WHERE n_sources BETWEEN 2 AND 5 AND tf >= CASE WHEN field_name IN ('lexical_terms', 'lexical_ngrams') THEN 3 ELSE 1 END")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms of few sources that stand often in a chunk."""
    often = F.col("tf") >= F.when(F.col("field_name").isin("lexical_terms", "lexical_ngrams"), 3).otherwise(1)
    return relevance.term_weights(_p4_chunks(spark, d), keep=often, keep_terms=F.col("n_sources").between(2, 5)).select("row_id", "field_name", "term")


@query(
    _P4_SQL
    + """, n AS (SELECT field_name, count(*) AS n_docs, avg(len) AS avg_length FROM (SELECT row_id, field_name, sum(tf) AS len FROM p GROUP BY ALL) GROUP BY 1),
l AS (SELECT row_id, field_name, sum(tf) AS len FROM p GROUP BY ALL),
s AS (
  SELECT row_id, field_name, term, tf, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_length)) AS weight
  FROM p JOIN t USING (field_name, term) JOIN n USING (field_name) JOIN l USING (row_id, field_name)
)
SELECT row_id, field_name, count(*) AS terms, CAST(max(tf) AS INT) AS max_tf, round(sum(weight), 4) AS total_weight FROM s GROUP BY ALL"""
)
def p4_weights(spark: SparkSession, d: str) -> DataFrame:
    """All weights, summed up per chunk and field."""
    w = relevance.term_weights(_p4_chunks(spark, d))
    return w.groupBy("row_id", "field_name").agg(F.count("*").alias("terms"), F.max("tf").alias("max_tf"), F.round(F.sum("weight"), 4).alias("total_weight"))


@query(
    _P4_SQL
    + """, n AS (SELECT field_name, count(*) AS n_docs, avg(len) AS avg_length FROM (SELECT row_id, field_name, sum(tf) AS len FROM p GROUP BY ALL) GROUP BY 1),
l AS (SELECT row_id, field_name, sum(tf) AS len FROM p GROUP BY ALL),
s AS (SELECT row_id, field_name, term, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_length)), 6) AS weight FROM p JOIN t USING (field_name, term) JOIN n USING (field_name) JOIN l USING (row_id, field_name))
SELECT row_id, field_name, term, weight, CAST(row_number() OVER (PARTITION BY row_id, field_name ORDER BY weight DESC, term) AS INT) AS rank FROM s QUALIFY rank <= 5"""
)
def p4_top(spark: SparkSession, d: str) -> DataFrame:
    """The five most characteristic terms of each field of each chunk, with their weights."""
    w = relevance.term_weights(_p4_chunks(spark, d)).withColumn("weight", F.round("weight", 6))
    return relevance.top_terms(w, 5).select("row_id", "field_name", "term", "weight", "rank")


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Titles, paths and texts that look the same but differ."""
    return canonical.look_alikes(canonical.vault_values(table(spark, d, "sources", "source_id", "title_raw", "path_raw"), table(spark, d, "chunks", "row_id", "text_raw")))


@query()
def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one consistent form of every title, path and text."""
    own = canonical.vault_values(table(spark, d, "sources", "source_id", "title_raw", "path_raw"), table(spark, d, "chunks", "row_id", "text_raw"))
    return canonical.canonical_column(own.where("key is not null").dropDuplicates(["field_name", "key"]), "value", "form").select("field_name", "key", "form")


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Records with missing or wrong language labels and the languages they have."""
    model = language.fit(table(spark, d, "lang_samples"))
    chunks = table(spark, d, "chunks", "row_id", "source_id", "language_codes", "text_raw")
    sources = table(spark, d, "sources", "source_id", "primary_language", "languages")
    return language.wrong_labels(chunks, sources, table(spark, d, "documents", "doc_id", "lang", "text"), model)


@query()
def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    """The language of each chunk and document and of its spans of one language, with confidence."""
    model = language.fit(table(spark, d, "lang_samples"))
    return language.text_segments(table(spark, d, "chunks", "row_id", "text_raw"), table(spark, d, "documents", "doc_id", "text"), model)


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their token counts, tokenized once."""
    return cut(tokens.count_tokens(table(spark, d, "documents", "doc_id", "text", "source"), keep=("source",)), "tokens")


@query()
def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document (of each piece, if it is longer than the limit) for each limit."""
    return packing.pack(_counted(spark, d), table(spark, d, "pack_limits"))


@query()
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, by limit."""
    limits = table(spark, d, "pack_limits")
    return packing.fill_report(packing.pack(_counted(spark, d), limits), limits)


@query()
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents and how often each is used, for a total of all tokens: small sources are clamped, the others take over."""
    return mixing.mix(_counted(spark, d), table(spark, d, "mix_targets"))[0]


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, and which sources were clamped."""
    return mixing.mix(_counted(spark, d), table(spark, d, "mix_targets"))[1]


@query()
def p9_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached with the largest total at which no source is clamped: the targets themselves."""
    return mixing.mix(_counted(spark, d), table(spark, d, "mix_targets"), total=mixing.EXACT)[1]


@query("""WITH a AS (SELECT source, CAST(sum(n_chars) AS DOUBLE) AS available FROM documents GROUP BY 1), g AS (SELECT CAST(sum(n_chars) AS DOUBLE) AS goal FROM documents WHERE source IS NOT NULL),
t AS (SELECT source, target_share / sum(target_share) OVER () AS share, max_repeats, coalesce(available, 0) AS available, max_repeats * coalesce(available, 0) AS room FROM mix_targets LEFT JOIN a USING (source)),
o AS (SELECT *, row_number() OVER (ORDER BY room / share, source) AS n FROM t),
c AS (SELECT *, coalesce(sum(room) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, sum(share) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
f AS (SELECT *, (goal - taken) * share / open >= room AS is_full FROM c, g), k AS (SELECT coalesce(sum(room) FILTER (is_full), 0) AS taken, coalesce(sum(share) FILTER (NOT is_full), 0) AS open FROM f),
p AS (SELECT source, share, max_repeats, available, CASE WHEN is_full THEN room ELSE (goal - k.taken) * share / k.open END AS planned, goal FROM f, k)
SELECT source, round(share, 9) AS target_share, max_repeats, CAST(available AS BIGINT) AS available, CAST(round(planned) AS BIGINT) AS planned, round(planned / sum(planned) OVER (), 9) AS planned_share, planned < goal * share * (1 - 1e-9) AS clamped FROM p""")
def p9_plan(spark: SparkSession, d: str) -> DataFrame:
    """What water-filling asks of each source, by characters instead of tokens, so that SQL can check it."""
    own = table(spark, d, "documents", "doc_id", "source", "n_chars")
    plan = mixing.plan_shares(own, table(spark, d, "mix_targets"), size="n_chars")
    return plan.select("source", F.round("target_share", 9).alias("target_share"), "max_repeats", "available", F.round("planned").cast("long").alias("planned"), F.round("planned_share", 9).alias("planned_share"), "clamped")


_P10_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, i, md5_number(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d WHERE length(text) >= 200))
"""


@query(_P10_SQL + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT DISTINCT doc_id, h FROM w) a JOIN (SELECT DISTINCT doc_id, h FROM w) b ON a.h = b.h AND a.doc_id < b.doc_id")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share a verbatim span of at least 200 characters."""
    return spans.document_pairs(spans.shared_spans(table(spark, d, "documents", "doc_id", "text")))


@query(
    _P10_SQL
    + """, shared AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), c AS (SELECT doc_id, least(200, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 200)) AS n FROM w JOIN shared USING (h)),
s AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS shared_chars FROM c GROUP BY 1)
SELECT doc_id, CAST(length(text) AS INT) AS chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(shared_chars, 0) / length(text), 6) ELSE 0.0 END AS share FROM d LEFT JOIN s USING (doc_id)"""
)
def p10_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands in other documents too; by class, without pairs."""
    return spans.shared_shares(spans.shared_spans(table(spark, d, "documents", "doc_id", "text"), hot=0)).withColumnRenamed("id", "doc_id")

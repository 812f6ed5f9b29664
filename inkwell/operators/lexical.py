"""Postings over nine lexical fields, and BM25 search with weights by field.

Postings are built once per artifact and can be written partitioned by field; a query joins its few terms by
broadcast, so a search reads the postings of its terms alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.filters import RowFilter, predicate
from inkwell.session import small

K1, B = 1.2, 0.75
# Default weights by field.
FIELD_WEIGHTS = {"title": 6.0, "aliases": 5.0, "headings": 3.5, "tags": 3.0, "filename": 2.5, "path": 1.5, "body": 1.0, "identifier": 4.0, "ngram": 1.0}
_COLUMNS = {"title": "title_terms", "aliases": "alias_terms", "headings": "heading_terms", "tags": "tag_terms", "path": "path_terms", "body": "lexical_terms", "identifier": "identifier_terms", "ngram": "lexical_ngrams"}
MAX_QUERY_TERMS = 10_000


def field_terms(chunks: DataFrame) -> DataFrame:
    """(row_id, field, terms): the term arrays of the nine fields, chunks counted once."""
    fields = [F.struct(F.lit(f).alias("field"), F.col(c).alias("terms")) for f, c in _COLUMNS.items()]
    fields.append(F.struct(F.lit("filename").alias("field"), F.filter("path_terms", lambda t: ~t.contains("/")).alias("terms")))
    once = chunks.select("row_id", *_COLUMNS.values()).where("row_id is not null").dropDuplicates(["row_id"])
    return once.select("row_id", F.explode(F.array(*fields)).alias("f")).select("row_id", "f.field", F.filter("f.terms", lambda t: t.isNotNull()).alias("terms")).where("size(terms) > 0")


def build_postings(chunks: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(field, term, row_id, tf, len): tf counts repeated terms, len is the field's length. only: postings of these terms alone, picked before they are counted."""
    each = field_terms(chunks).select("row_id", "field", F.size("terms").alias("len"), F.explode("terms" if only is None else F.filter("terms", lambda t: t.isin(*only) if only else F.lit(False))).alias("term"))
    return each.groupBy("row_id", "field", "term", "len").agg(F.count("*").cast("int").alias("tf")).select("field", "term", "row_id", "tf", "len")


def field_statistics(chunks: DataFrame) -> DataFrame:
    """(field, n_docs, avg_len): records without terms in a field don't count."""
    return field_terms(chunks).groupBy("field").agg(F.count("*").alias("n_docs"), F.avg(F.size("terms")).alias("avg_len"))


def query_terms(spark, terms: list[str], ngrams: list[str] = (), identifiers: list[str] = (), weights: dict[str, float] | None = None) -> DataFrame:
    """(field, term, weight) of a query; at most MAX_QUERY_TERMS distinct terms."""
    weights = FIELD_WEIGHTS if weights is None else weights
    rows = []
    for name in FIELD_WEIGHTS:
        own = ngrams if name == "ngram" else (identifiers or terms) if name == "identifier" else terms
        rows += [(name, t, float(weights.get(name, 0))) for t in dict.fromkeys(own) if weights.get(name, 0) > 0]
    if len(rows) > MAX_QUERY_TERMS * len(FIELD_WEIGHTS):
        raise ValueError("too many query terms")
    return small(spark, rows, "field string, term string, weight double")


def bm25(postings: DataFrame, statistics: DataFrame, query: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(row_id, score, matched_fields, matched_terms) of every record that holds a term of the query."""
    hits = postings.join(F.broadcast(query), ["field", "term"])
    if "df" not in postings.columns:  # a saved index has them
        hits = hits.join(F.broadcast(hits.groupBy("field", "term").agg(F.count("*").alias("df"))), ["field", "term"])  # a row for each query term and field
    scored = hits.join(F.broadcast(statistics), "field")
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("weight") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    owner = [F.max("source_id").alias("source_id")] if "source_id" in postings.columns else []
    return scored.groupBy("row_id").agg(*owner, F.sum(part).alias("score"), F.array_sort(F.collect_set("field")).alias("matched_fields"), F.array_sort(F.collect_set("term")).alias("matched_terms"))


def with_frequencies(postings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Postings as they are saved: with the document frequency of their term and the source of their record."""
    df = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
    owner = chunks.select("row_id", "source_id").dropDuplicates(["row_id"])
    return postings.join(df, ["field", "term"]).join(owner, "row_id").select("field", "term", "row_id", "source_id", "tf", "len", "df")


def exclude_terms(hits: DataFrame, postings: DataFrame, excluded: list[str]) -> DataFrame:
    """Drop records whose body or n-grams hold an excluded term."""
    if not excluded:
        return hits
    bad = postings.where(F.col("field").isin("body", "ngram") & F.col("term").isin(*excluded)).select("row_id")
    return hits.join(bad, "row_id", "left_anti")


def only_terms(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of a query's few terms: a predicate that reaches the scan, where sorted files skip the rest."""
    return postings.where(F.col("term").isin(*terms)) if terms else postings.limit(0)


def search(chunks: DataFrame, postings: DataFrame, statistics: DataFrame, query: DataFrame, limit: int = 80, excluded: list[str] = (), row_filter: RowFilter | None = None) -> DataFrame:
    """(row_id, source_id, score, matched_fields, matched_terms, rank): the best records, ties by row_id."""
    hits = exclude_terms(bm25(postings, statistics, query), postings, list(excluded))
    if "source_id" in hits.columns:
        if row_filter is None or row_filter == RowFilter():
            return _best(hits, limit)
        hits = hits.drop("source_id")
    own = chunks.where(predicate(row_filter)).select("row_id", "source_id").dropDuplicates(["row_id"])
    return _best(hits.join(own, "row_id"), limit)


def _best(hits: DataFrame, limit: int) -> DataFrame:
    rounded = F.round("score", 9)  # sums of the same parts in another order are a tie
    return ranked(hits.withColumn("_s", rounded), limit, F.desc("_s"), F.asc("row_id")).drop("_s")


def ranked(df: DataFrame, limit: int, *order) -> DataFrame:
    """The first `limit` rows in an order, with their rank; a top-k first, so that only `limit` rows meet in one task."""
    from pyspark.sql import Window

    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def overlap_score(terms, needles: list[str]):
    """How many distinct needles a term array holds."""
    return F.size(F.array_intersect(terms, F.array(*[F.lit(n) for n in needles])))

"""How distinctive a term is per record: probabilistic relevance weights (BM25) of every term of every field.

weight = idf(df, N) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length)), per field, with
idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N and the average count records with at least one term in the field.

Rows are partitioned by record once, when repeated rows are dropped; counting terms within a record and the
field lengths then needs no further exchange. Document frequencies are pre-aggregated before they are shuffled.
Terms with more than HOT_DF records are joined by broadcast: as a record adds at most its own terms, there are
at most (postings / HOT_DF) of them, and the list is cut off at HOT_TERMS with the rest joined by shuffle; all
other terms have groups of at most HOT_DF rows.

Defined cases: null arrays and null terms count nothing; an empty term is a term. Repeated terms raise tf.
Repeated rows count once (by row_id). Rows without row_id are left out; a null source_id is no source. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import cut

K1, B = 1.2, 0.75
HOT_DF, HOT_TERMS = 50_000, 20_000
FIELDS = ("lexical_terms", "lexical_ngrams", "title_terms", "tag_terms")


def postings(chunks: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(row_id, source_id, field_name, term, tf, length): each distinct term of each field of each record."""
    once = chunks.select("row_id", "source_id", *fields).where("row_id is not null").dropDuplicates(["row_id"])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.filter(f, lambda t: t.isNotNull()).alias("terms")) for f in fields])).alias("f")
    by_field = once.select("row_id", "source_id", each).select("row_id", "source_id", "f.field_name", F.size("f.terms").alias("length"), "f.terms")
    return by_field.select("row_id", "source_id", "field_name", "length", F.explode("terms").alias("term")).groupBy("row_id", "source_id", "field_name", "term", "length").agg(F.count("*").cast("int").alias("tf"))


def term_statistics(posted: DataFrame) -> DataFrame:
    """(field_name, term, df, n_sources) over all records."""
    by_source = posted.groupBy("field_name", "term", "source_id").agg(F.count("*").alias("n"))
    return by_source.groupBy("field_name", "term").agg(F.sum("n").alias("df"), F.count("source_id").alias("n_sources"))


def field_statistics(chunks: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field_name, n_docs, avg_length): one row per field. Only lengths are shuffled."""
    sizes = F.array(*[F.struct(F.lit(f).alias("field_name"), F.size(F.filter(f, lambda t: t.isNotNull())).alias("length")) for f in fields])
    once = chunks.where("row_id is not null").select("row_id", sizes.alias("sizes")).dropDuplicates(["row_id"])
    return once.select(F.explode("sizes").alias("s")).where("s.length > 0").groupBy("s.field_name").agg(F.count("*").alias("n_docs"), F.avg("s.length").alias("avg_length"))


def term_weights(chunks: DataFrame, fields: tuple[str, ...] = FIELDS, keep=None, keep_terms=None, k1: float = K1, b: float = B) -> DataFrame:
    """(row_id, field_name, term, tf, df, n_sources, weight).

    keep (a condition on postings) and keep_terms (a condition on df and n_sources) select what is scored;
    the statistics always cover all records.
    """
    posted = cut(postings(chunks, fields), "postings")  # read by the statistics and by the scores
    terms = cut(term_statistics(posted), "terms")  # read by the hot terms and by the rest
    wanted = posted if keep is None else posted.where(keep)
    hot = terms.where(F.col("df") > HOT_DF).orderBy(F.desc("df"), "field_name", "term").limit(HOT_TERMS)
    marked = wanted.join(F.broadcast(hot.withColumnsRenamed({"df": "_df", "n_sources": "_n"})), ["field_name", "term"], "left")
    easy = marked.where("_df is not null").withColumnsRenamed({"_df": "df", "_n": "n_sources"})
    rest = marked.where("_df is null").drop("_df", "_n").join(terms if keep_terms is None else terms.where(keep_terms), ["field_name", "term"])
    scored = (easy if keep_terms is None else easy.where(keep_terms)).unionByName(rest)
    scored = scored.join(F.broadcast(field_statistics(chunks, fields).limit(len(fields))), "field_name")
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return scored.select("row_id", "field_name", "term", "tf", "df", "n_sources", (idf * tf).alias("weight"))


def top_terms(weights: DataFrame, k: int = 5) -> DataFrame:
    """The k most characteristic terms of each field of each record, ties by term."""
    order = Window.partitionBy("row_id", "field_name").orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

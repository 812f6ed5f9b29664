"""Registered core queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import incremental, orphans
from inkwell.session import own_folder
from inkwell.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register


_P2_SQL = """
WITH feed AS (
  SELECT source_id, source_revision, arg_max({'c': CASE WHEN change_kind = 'delete' THEN NULL ELSE lower(raw_content_hash) END}, seq).c AS content
  FROM vault_changes WHERE source_id IS NOT NULL AND source_revision IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2
), held_at AS (
  SELECT m.source_id, max(m.indexed_revision) AS rev FROM index_manifest m JOIN (SELECT DISTINCT artifact_id FROM artifacts WHERE is_active) a USING (artifact_id)
  GROUP BY 1 HAVING max(m.indexed_revision) > 0
), held AS (SELECT f.source_id, f.content, f.source_revision FROM feed f JOIN held_at h ON f.source_id = h.source_id AND f.source_revision = h.rev),
latest AS (SELECT source_id, max(source_revision) AS source_revision FROM feed GROUP BY 1)
SELECT l.source_id, l.source_revision
FROM latest l JOIN feed f USING (source_id, source_revision) LEFT JOIN held h ON h.source_id = l.source_id
WHERE f.content IS DISTINCT FROM h.content
"""


def _ledger(spark: SparkSession, name: str) -> incremental.Ledger:
    return incremental.Ledger(spark, own_folder(spark, name))


@query(_P2_SQL)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose latest content differs from the content the index holds: one run of a ledger that begins with what the manifest holds."""
    changes = table(spark, d, "vault_changes", "seq", "source_id", "change_kind", "source_revision", "raw_content_hash")
    manifest = table(spark, d, "index_manifest", "artifact_id", "source_id", "indexed_revision")
    return incremental.stale_sources(changes, manifest, table(spark, d, "artifacts", "artifact_id", "is_active"), _ledger(spark, "stale")).select("source_id", "source_revision")


@query("""WITH f AS (SELECT DISTINCT seq, source_id, floor(epoch_us(arrived_at) / 2592000000000) AS month FROM vault_changes WHERE seq IS NOT NULL AND arrived_at IS NOT NULL), b AS (SELECT min(month) AS lo, max(month) AS hi FROM f),
r AS (SELECT seq, source_id, CAST(least(3, 1 + floor((month - lo) * 3 / (hi - lo + 1))) AS INT) AS run FROM f, b)
SELECT run, count(*) AS records, count(DISTINCT source_id) AS sources, min(seq) AS first_seq, max(seq) AS last_seq FROM r GROUP BY 1 UNION ALL SELECT 4, 0, 0, NULL, NULL""")
def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    """What four runs of one ledger process, each over all that had arrived by then: late numbers come in once, repeated ones never, the fourth finds nothing."""
    feed = table(spark, d, "vault_changes", "seq", "source_id", "arrived_at").where("seq is not null and arrived_at is not null").withColumn("month", F.floor(F.unix_micros(F.col("arrived_at").cast("timestamp")) / 2_592_000_000_000))
    lo, hi = feed.agg(F.min("month"), F.max("month")).first()
    feed = feed.withColumn("part", F.least(F.lit(3), 1 + F.floor((F.col("month") - (lo or 0)) * 3 / ((hi or 0) - (lo or 0) + 1))))
    ledger, out = _ledger(spark, "runs"), None
    summed = [F.count("*").alias("records"), F.count_distinct("source_id").alias("sources"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")]
    for run in (1, 2, 3, 4):
        version = ledger.run(feed.where(F.col("part") <= run).drop("month", "part"), lambda rows: rows.dropDuplicates(["seq"]))["version"]
        own = ledger.output(version).agg(F.lit(run).alias("run"), *summed)
        out = own if out is None else out.unionByName(own)
    return out


_P7_REFS = r"""
WITH refs AS (
  SELECT 'sources' AS ref_table, source_id AS ref_key, CAST(pos - 1 AS INT) AS ref_pos, mtime_ms,
         lower(trim(regexp_replace(trim(regexp_replace(regexp_replace(url_decode(regexp_replace(link, '\+', '%2B', 'g')), '#.*$', '', 's'), '^.*/', '', 's')), '\.(md|txt)$', '', 'i'))) AS name
  FROM (SELECT source_id, mtime_ms, unnest(links) AS link, generate_subscripts(links, 1) AS pos FROM (SELECT DISTINCT source_id, mtime_ms, links FROM sources))
  WHERE link IS NOT NULL AND NOT regexp_matches(lower(trim(link)), '^(https?|mailto):') AND NOT regexp_matches(lower(trim(link)), '\.(png|pdf|svg|csv)$')
), notes AS (SELECT DISTINCT lower(regexp_replace(regexp_replace(path_raw, '^.*/', '', 's'), '\.[^.]*$', '')) AS name FROM sources),
orphans AS (
  SELECT ref_table, ref_key, ref_pos, mtime_ms FROM refs WHERE name NOT IN (SELECT name FROM notes WHERE name IS NOT NULL)
  UNION ALL
  SELECT DISTINCT 'chunks', row_id, 0, mtime_ms FROM chunks WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM sources)
)
"""


def _orphans(spark: SparkSession, d: str, *statuses: str) -> DataFrame:
    sources = table(spark, d, "sources", "source_id", "path_raw", "links", "created_ms", "mtime_ms")
    chunks = table(spark, d, "chunks", "row_id", "source_id", "mtime_ms")
    changes = table(spark, d, "vault_changes", "seq", "source_id", "source_revision", "change_kind", "path_raw", "mtime_ms")
    return orphans.orphans(sources, chunks, changes, statuses)


@query(_P7_REFS + "SELECT ref_table, ref_key, ref_pos FROM orphans")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """References to notes that don't exist (any more)."""
    return _orphans(spark, d, "missing", "deleted").select("ref_table", "ref_key", "ref_pos")


_P7_VALID = r""", keyed AS (SELECT ref_table, ref_key, ref_pos, mtime_ms, 'name' AS kind, name AS key FROM refs UNION ALL SELECT DISTINCT 'chunks', row_id, 0, mtime_ms, 'id', source_id FROM chunks WHERE source_id IS NOT NULL),
feed AS (SELECT source_id, source_revision, arg_max({'k': change_kind, 'p': path_raw, 'm': mtime_ms}, seq) AS r FROM vault_changes WHERE source_id IS NOT NULL AND source_revision IS NOT NULL GROUP BY 1, 2),
held AS (SELECT source_id, r.k AS change_kind, r.p AS path_raw, r.m AS lo, greatest(r.m, coalesce(lead(r.m) OVER (PARTITION BY source_id ORDER BY source_revision), r.m)) AS hi FROM feed),
valid AS (
  SELECT 'id' AS kind, source_id AS key, lo, hi FROM held WHERE change_kind <> 'delete'
  UNION ALL SELECT 'name', lower(regexp_replace(regexp_replace(path_raw, '^.*/', '', 's'), '\.[^.]*$', '')), lo, hi FROM held WHERE change_kind <> 'delete'
  UNION ALL SELECT 'id', source_id, created_ms, 9223372036854775807 FROM sources UNION ALL SELECT 'name', lower(regexp_replace(regexp_replace(path_raw, '^.*/', '', 's'), '\.[^.]*$', '')), created_ms, 9223372036854775807 FROM sources
), state AS (
  SELECT ref_table, ref_key, ref_pos, any_value(keyed.mtime_ms) AS ms, CASE WHEN count(valid.key) = 0 THEN 'missing' WHEN max(hi) < 9223372036854775807 THEN 'deleted' WHEN bool_or(lo <= keyed.mtime_ms AND keyed.mtime_ms < hi) THEN 'ok' ELSE 'late' END AS status
  FROM keyed LEFT JOIN valid USING (kind, key) GROUP BY 1, 2, 3
)
"""


@query(_P7_REFS + _P7_VALID + "SELECT ref_table, strftime(epoch_ms(ms), '%Y-%m') AS period, status, count(*) AS orphans FROM state WHERE status <> 'ok' GROUP BY 1, 2, 3")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted per table, month and status: missing, deleted, or late (the parent came after the reference)."""
    return orphans.orphan_report(_orphans(spark, d, "missing", "deleted", "late"))


# ---- the retrieval engine's own operators

from inkwell.functions import text as tx  # noqa: E402
from inkwell.functions import vectors  # noqa: E402
from inkwell.operators import connections, evaluation, exact, fusion, indexing, lexical, mutations, semantic  # noqa: E402
from inkwell.operators.filters import RowFilter, apply_filter  # noqa: E402
from inkwell.plans.search import SearchService, metadata_scan  # noqa: E402
from inkwell.streaming import coalescer  # noqa: E402

_FILTER = RowFilter(folders=("Projects", "notes"), tags=("#Code",), mtime_after=1_680_000_000_000, mtime_before=1_730_000_000_000, extensions=("md",))
_FILTER_SQL = """(folder_norm = 'projects' OR starts_with(folder_norm, 'projects/') OR folder_norm = 'notes' OR starts_with(folder_norm, 'notes/'))
AND len(list_filter(tags, lambda t: lower(t) = 'code' OR starts_with(lower(t), 'code/'))) > 0 AND mtime_ms > 1680000000000 AND mtime_ms < 1730000000000 AND extension = 'md'"""


@query(f"SELECT DISTINCT row_id, source_id FROM chunks WHERE {_FILTER_SQL}")
def f_chunk_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by folder, tag, time window and extension."""
    return apply_filter(table(spark, d, "chunks"), _FILTER).select("row_id", "source_id").distinct()


@query(f"SELECT DISTINCT source_id FROM sources WHERE {_FILTER_SQL}")
def f_source_filter(spark: SparkSession, d: str) -> DataFrame:
    """Sources by the same filter."""
    return apply_filter(table(spark, d, "sources"), _FILTER).select("source_id").distinct()


@query("SELECT DISTINCT source_id, path_raw AS path FROM sources WHERE contains(path_norm, 'daily') ORDER BY path, source_id LIMIT 50")
def f_metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first sources by path that match a metadata-only query."""
    return metadata_scan(table(spark, d, "sources"), RowFilter(path_contains=("Daily",)), 50).select("source_id", "path")


@query(r"""SELECT row_id, CAST(dense + ceil((chars - dense) / 4.0) AS INT) AS tokens FROM (
  SELECT row_id, length(regexp_replace(text_raw, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}]', '', 'g')) AS dense, length(regexp_replace(text_raw, '[\s\x{0B}\x{85}\p{Z}]', '', 'g')) AS chars FROM (SELECT DISTINCT row_id, text_raw FROM chunks))""")
def x_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of each chunk."""
    return table(spark, d, "chunks", "row_id", "text_raw").select("row_id", tx.estimate_tokens("text_raw").alias("tokens")).distinct()


@query(
    "WITH c AS (SELECT DISTINCT row_id, text_raw FROM chunks), s AS (SELECT row_id, unnest([" + ", ".join(rf"{{'script': '{s}', 'n': length(regexp_replace(text_raw, '[^\p{{{s}}}]', '', 'g'))}}" for s in tx.SCRIPTS) + "]) AS x FROM c) SELECT x.script AS script, count(*) AS chunks, CAST(sum(x.n) AS BIGINT) AS letters FROM s WHERE x.n > 0 GROUP BY 1"
)
def x_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Letters by script over all chunks."""
    counts = table(spark, d, "chunks", "row_id", "text_raw").select("row_id", tx.script_counts("text_raw").alias("s")).distinct().select(F.explode("s").alias("s"))
    return counts.where("s.script <> 'Other'").groupBy("s.script").agg(F.count("*").alias("chunks"), F.sum("s.count").alias("letters"))


_SCRIPT_COUNTS = ", ".join(
    [f"{{'s': '{s}', 'i': {i}, 'n': length(regexp_replace(t, '[^\\p{{{s}}}]', '', 'g'))}}" for i, s in enumerate(tx.SCRIPTS)]
    + [f"{{'s': 'Other', 'i': {len(tx.SCRIPTS)}, 'n': length(regexp_replace(regexp_replace(t, '[^\\p{{L}}]', '', 'g'), '[" + "".join(f"\\p{{{s}}}" for s in tx.SCRIPTS) + "]', '', 'g'))}"]
)


@query(
    rf"""WITH c AS (SELECT DISTINCT row_id, text_raw AS t FROM chunks),
n AS (SELECT row_id, [{_SCRIPT_COUNTS}] AS a FROM c),
p AS (SELECT row_id, list_filter(a, lambda x: x.n > 0) AS a FROM n),
m AS (SELECT row_id, coalesce(list_sum(list_transform(a, lambda x: x.n)), 0) AS total, map_from_entries(list_transform(a, lambda x: {{'k': x.s, 'v': x.n}})) AS k, array_to_string(list_transform(list_sort(list_transform(a, lambda x: {{'o': -x.n, 'i': x.i, 's': x.s}})), lambda x: x.s), ' ') AS scripts, a FROM p),
g AS (SELECT *, coalesce(k['Hiragana'], 0) + coalesce(k['Katakana'], 0) AS kana, coalesce(k['Han'], 0) AS han, coalesce(k['Hangul'], 0) AS ko, coalesce(k['Thai'], 0) AS th, coalesce(k['Hebrew'], 0) AS he, coalesce(k['Arabic'], 0) AS ar FROM m),
o AS (SELECT *, list_filter([{{'n': CASE WHEN kana > 0 THEN kana + han ELSE 0 END, 'l': 'ja'}}, {{'n': ko, 'l': 'ko'}}, {{'n': CASE WHEN kana = 0 THEN han ELSE 0 END, 'l': 'zh'}}, {{'n': th, 'l': 'th'}}, {{'n': he, 'l': 'he'}}, {{'n': ar, 'l': 'ar'}}], lambda x: x.n > 0) AS f FROM g),
b AS (SELECT *, list_max(list_transform(f, lambda x: x.n)) AS best FROM o)
SELECT row_id, coalesce(list_filter(f, lambda x: x.n = best)[1].l, 'und') AS primary_language, array_to_string(list_transform(f, lambda x: x.l), ' ') AS languages, scripts, round(best / total, 6) AS confidence, len(list_filter(a, lambda x: x.n / total >= 0.1)) > 1 AS mixed FROM b"""
)
def x_language(spark: SparkSession, d: str) -> DataFrame:
    """What the scripts of each chunk tell about its language."""
    own = table(spark, d, "chunks", "row_id", "text_raw").select("row_id", tx.script_counts("text_raw").alias("s")).distinct().withColumn("l", tx.language_of("s"))
    return own.select("row_id", "l.primary_language", F.array_join("l.languages", " ").alias("languages"), F.array_join("l.scripts", " ").alias("scripts"), F.round("l.confidence", 6).alias("confidence"), "l.mixed")


@query(r"""SELECT DISTINCT source_id, regexp_extract(path_raw, '[^/]*$') AS filename, CASE WHEN contains(path_raw, '/') THEN regexp_replace(path_raw, '/[^/]*$', '') ELSE '' END AS folder,
  regexp_replace(regexp_extract(path_raw, '[^/]*$'), '(.)\.[^.]+$', '\1') AS stem, lower(regexp_extract(path_raw, '[^.]*$')) AS extension FROM sources""")
def x_path_parts(spark: SparkSession, d: str) -> DataFrame:
    """File name, stem, folder and extension of each source."""
    return table(spark, d, "sources", "source_id", "path_raw").distinct().select("source_id", tx.path_parts("path_raw").alias("p")).select("source_id", "p.filename", "p.folder", "p.stem", "p.extension")


@query(r"SELECT DISTINCT source_id, lower(trim(regexp_replace(title_raw, '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g'))) AS title FROM sources")
def x_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles in lower case with blanks collapsed."""
    return table(spark, d, "sources", "source_id", "title_raw").distinct().select("source_id", F.lower(tx.collapse_whitespace("title_raw")).alias("title"))


@query("SELECT DISTINCT row_id, sha256(text_raw) AS hash, sha256(text_raw) = raw_chunk_hash AS same FROM chunks")
def x_chunk_hash(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes of chunks against the stored ones."""
    return table(spark, d, "chunks", "row_id", "text_raw", "raw_chunk_hash").select("row_id", F.sha2("text_raw", 256).alias("hash"), (F.sha2("text_raw", 256) == F.col("raw_chunk_hash")).alias("same")).distinct()


_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
_HALF = "".join(chr(ord(x) - 0xFEE0) for x in _FULL).replace("'", "''")
_NFKC_SQL = f"nfc_normalize(translate(text_raw, '{_FULL}', '{_HALF}'))"  # of the compatibility forms in the tables


@query(
    f"WITH c AS (SELECT DISTINCT row_id, text_raw FROM chunks), m AS (SELECT row_id, lower({_NFKC_SQL}) AS m FROM c),"
    + r"""n AS (SELECT row_id, trim(regexp_replace(m, '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g')) AS t FROM m),
w AS (SELECT row_id, t, regexp_extract_all(t, '[\p{L}\p{N}_]+') AS a, regexp_extract_all(strip_accents(t), '[\p{L}\p{N}_]+') AS b, regexp_extract_all(t, '[\p{Han}\p{Hiragana}\p{Katakana}]+') || regexp_extract_all(t, '\p{Hangul}+') AS runs FROM n)
SELECT row_id, array_to_string(a || CASE WHEN len(a) = len(b) AND regexp_matches(t, '[^\x00-\x7F]') THEN list_transform(list_filter(list_zip(a, b), lambda x: x[1] <> x[2]), lambda x: x[2]) ELSE [] END, ' ') AS terms,
array_to_string(list_sort(flatten(list_transform(runs, lambda r: CASE WHEN length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, CAST(i AS BIGINT), 2)) || list_transform(range(1, length(r) - 1), lambda i: substr(r, CAST(i AS BIGINT), 3)) END))), ' ') AS ngrams FROM w"""
)
def x_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each chunk, folded forms at the end, and its character n-grams."""
    own = tx.with_analysis(table(spark, d, "chunks", "row_id", "text_raw").dropDuplicates(["row_id"]), "text_raw", "a", identifiers=False)
    return own.select("row_id", F.array_join(F.concat("a.terms", "a.secondary_terms"), " ").alias("terms"), F.array_join(F.array_sort("a.ngrams"), " ").alias("ngrams"))


@query()
def x_analyze(spark: SparkSession, d: str) -> DataFrame:
    """Terms, n-grams and identifier terms of each chunk, analyzed anew."""
    own = tx.with_analysis(table(spark, d, "chunks", "row_id", "text_raw").distinct(), "text_raw", "a")
    return own.select("row_id", F.concat("a.terms", "a.secondary_terms").alias("lexical_terms"), F.col("a.ngrams").alias("lexical_ngrams"), F.col("a.identifier_terms").alias("identifier_terms"))


_POSTINGS_SQL = """
WITH once AS (SELECT DISTINCT ON (row_id) * FROM chunks WHERE row_id IS NOT NULL),
ft AS (
  SELECT row_id, 'title' AS field, title_terms AS terms FROM once UNION ALL SELECT row_id, 'aliases', alias_terms FROM once UNION ALL SELECT row_id, 'headings', heading_terms FROM once
  UNION ALL SELECT row_id, 'tags', tag_terms FROM once UNION ALL SELECT row_id, 'path', path_terms FROM once UNION ALL SELECT row_id, 'filename', list_filter(path_terms, lambda t: NOT contains(t, '/')) FROM once
  UNION ALL SELECT row_id, 'body', lexical_terms FROM once UNION ALL SELECT row_id, 'identifier', identifier_terms FROM once UNION ALL SELECT row_id, 'ngram', lexical_ngrams FROM once
), f AS (SELECT row_id, field, terms, len(terms) AS len FROM ft WHERE len(terms) > 0),
stats AS (SELECT field, count(*) AS n_docs, avg(len) AS avg_len FROM f GROUP BY 1),
p AS (SELECT field, term, row_id, len, count(*) AS tf FROM (SELECT field, row_id, len, unnest(terms) AS term FROM f) GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL)
"""


@query(_POSTINGS_SQL + "SELECT field, count(*) AS postings, count(DISTINCT term) AS terms, CAST(sum(tf) AS BIGINT) AS occurrences, max(df) AS top_df FROM p JOIN dfs USING (field, term) GROUP BY 1")
def l_postings(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index by field: postings, terms, occurrences and the largest document frequency."""
    by_term = lexical.build_postings(table(spark, d, "chunks")).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return by_term.groupBy("field").agg(F.sum("df").alias("postings"), F.count("*").alias("terms"), F.sum("tf").alias("occurrences"), F.max("df").alias("top_df"))


@query(_POSTINGS_SQL + "SELECT field, n_docs, round(avg_len, 6) AS avg_len FROM stats")
def l_field_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Records and average length by field."""
    return lexical.field_statistics(table(spark, d, "chunks")).select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


_WORDS = ["vector", "index", "lantern", "garden", "kiln"]
_WEIGHTS_SQL = "w(field, weight) AS (VALUES ('title', 6.0), ('aliases', 5.0), ('headings', 3.5), ('tags', 3.0), ('filename', 2.5), ('path', 1.5), ('body', 1.0), ('identifier', 4.0))"
_HITS_SQL = (
    _POSTINGS_SQL
    + f", {_WEIGHTS_SQL}"
    + """, hits AS (
  SELECT row_id, sum(CAST(weight AS DOUBLE) * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM p JOIN dfs USING (field, term) JOIN stats USING (field) JOIN w USING (field) WHERE term IN ('vector', 'index', 'lantern', 'garden', 'kiln')
  AND row_id NOT IN (SELECT row_id FROM p WHERE field IN ('body', 'ngram') AND term = 'harbor') GROUP BY 1
), lex AS (SELECT row_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, row_id) AS rank FROM hits QUALIFY rank <= 80)
"""
)


def _lexical_hits(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    postings = lexical.build_postings(chunks, [*_WORDS, "harbor"])
    return lexical.search(chunks, postings, lexical.field_statistics(chunks), lexical.query_terms(spark, _WORDS), 80, ["harbor"])


@query(_HITS_SQL + "SELECT row_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM lex")
def q_lexical(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over nine weighted fields, with an excluded term."""
    return _lexical_hits(spark, d).select("row_id", F.round("score", 6).alias("score"), "rank")


_PHRASES = "(VALUES ('the quiet index'), ('lantern')) n(phrase)"
_EXACT_SQL = f"""
once_s AS (SELECT DISTINCT source_id, title_raw, aliases, filename_raw, path_raw, tags FROM sources WHERE source_id IS NOT NULL),
exact_all AS (
  SELECT source_id, row_id, 'text' AS field, phrase, instr(lower(text_raw), phrase) - 1 AS off FROM (SELECT DISTINCT row_id, source_id, text_raw FROM chunks), {_PHRASES} WHERE instr(lower(text_raw), phrase) > 0
  UNION ALL SELECT source_id, NULL, 'title', phrase, 0 FROM once_s, {_PHRASES} WHERE contains(lower(title_raw), phrase)
  UNION ALL SELECT source_id, NULL, 'alias', phrase, 0 FROM once_s, {_PHRASES} WHERE len(list_filter(aliases, lambda x: contains(lower(x), phrase))) > 0
  UNION ALL SELECT source_id, NULL, 'filename', phrase, 0 FROM once_s, {_PHRASES} WHERE contains(lower(filename_raw), phrase)
  UNION ALL SELECT source_id, NULL, 'path', phrase, 0 FROM once_s, {_PHRASES} WHERE contains(lower(path_raw), phrase)
  UNION ALL SELECT source_id, NULL, 'tag', phrase, 0 FROM once_s, {_PHRASES} WHERE len(list_filter(tags, lambda x: contains(lower('#' || x), phrase))) > 0
), ex AS (
  SELECT *, row_number() OVER (ORDER BY CASE field WHEN 'title' THEN 0 WHEN 'alias' THEN 1 WHEN 'filename' THEN 2 WHEN 'path' THEN 3 WHEN 'text' THEN 4 ELSE 5 END, off, source_id, row_id NULLS FIRST, phrase) AS rank FROM exact_all QUALIFY rank <= 200
)
"""


def _exact_hits(spark: SparkSession, d: str) -> DataFrame:
    return exact.search(table(spark, d, "sources"), table(spark, d, "chunks"), [exact.Needle("the quiet index"), exact.Needle("Lantern")], 200)


@query("WITH " + _EXACT_SQL + "SELECT source_id, row_id, field, lower(phrase) AS phrase, CAST(off AS INT) AS \"offset\", CAST(rank AS INT) AS rank FROM ex")
def q_exact(spark: SparkSession, d: str) -> DataFrame:
    """Phrases in titles, aliases, file names, paths, tags and texts, verified against the raw values."""
    return _exact_hits(spark, d).select("source_id", "row_id", "field", F.lower("phrase").alias("phrase"), "offset", "rank")


# vectors of the active artifact; the stand-in embedder's vector of the query words, as a literal
_EMBED = semantic.hash_embedder(64)
VECTORS_SQL = """act AS (SELECT artifact_id, dimension FROM artifacts WHERE is_active),
enc AS (SELECT DISTINCT row_id, source_id, dimension, embedding_base64 AS x FROM chunks JOIN act USING (artifact_id) WHERE row_id IS NOT NULL AND length(embedding_base64) % 4 = 0 AND regexp_full_match(embedding_base64, '[A-Za-z0-9+/]+=*')),
hexed AS (SELECT *, hex(from_base64(x)) AS h FROM enc), bits AS (SELECT row_id, source_id, list_transform(range(len(h) // 8), lambda i: CAST('0x' || h[i*8+7:i*8+8] || h[i*8+5:i*8+6] || h[i*8+3:i*8+4] || h[i*8+1:i*8+2] AS BIGINT)) AS u FROM hexed WHERE len(h) = dimension * 8),
vecs AS (SELECT row_id, source_id, CAST(list_transform(u, lambda x: CASE WHEN x & 2147483647 = 0 THEN 0.0 ELSE (CASE WHEN x >= 2147483648 THEN -1 ELSE 1 END) * (1 + (x & 8388607) / 8388608.0) * pow(2, ((x >> 23) & 255) - 127) END) AS DOUBLE[]) AS v FROM bits)
"""


def _literal(vector: list[float]) -> str:
    return "CAST([" + ", ".join(map(repr, vector)) + "] AS DOUBLE[])"


def _cosine_sql(a: str, b: str) -> str:
    return f"CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 0 ELSE list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END"


_SEMANTIC_SQL = f"{VECTORS_SQL}, sem AS (SELECT row_id, source_id, row_number() OVER (ORDER BY {_cosine_sql(_literal(_EMBED([' '.join(_WORDS)])[0]), 'v')} DESC, row_id) AS rank FROM vecs QUALIFY rank <= 80)"


_FUSED_SQL = (
    _HITS_SQL
    + ", "
    + _EXACT_SQL
    + ", "
    + _SEMANTIC_SQL
    + """, owner AS (SELECT DISTINCT row_id, source_id FROM chunks),
e1 AS (SELECT coalesce(row_id, 'source:' || source_id) AS key, any_value(source_id) AS source_id, min(rank) AS rank FROM ex GROUP BY 1),
l1 AS (SELECT row_id AS key, owner.source_id, rank FROM lex JOIN owner USING (row_id)),
fused AS (
  SELECT key, coalesce(e1.source_id, l1.source_id, sem.source_id) AS source_id, 0 + coalesce(1.4 / (60.0 + e1.rank), 0) + coalesce(1.0 / (60.0 + l1.rank), 0) + coalesce(1.0 / (60.0 + sem.rank), 0) AS score
  FROM (SELECT key FROM e1 UNION SELECT key FROM l1 UNION SELECT row_id FROM sem) LEFT JOIN e1 USING (key) LEFT JOIN l1 USING (key) LEFT JOIN sem ON sem.row_id = key
)
"""
)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    near = semantic.search(_with_vectors(spark, d), _EMBED([" ".join(_WORDS)])[0], 80)
    return fusion.fuse(_exact_hits(spark, d), _lexical_hits(spark, d), near)


@query(_FUSED_SQL + "SELECT key, source_id, round(score, 9) AS score FROM fused")
def q_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of exact, lexical and semantic hits."""
    return _fused(spark, d).select("key", "source_id", F.round("score", 9).alias("score"))


@query(_FUSED_SQL + "SELECT key, source_id FROM fused QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, key) <= 2")
def q_diversify(spark: SparkSession, d: str) -> DataFrame:
    """At most two blocks of a source."""
    return fusion.diversify(_fused(spark, d), 2).select("key", "source_id")


@query(_FUSED_SQL + "SELECT source_id, round(max(score), 9) AS score, count(*) AS block_count FROM fused GROUP BY 1")
def q_sources_max(spark: SparkSession, d: str) -> DataFrame:
    """Sources by their best block."""
    return fusion.by_source(_fused(spark, d), "max").select("source_id", F.round("score", 9).alias("score"), "block_count")


@query(_FUSED_SQL + "SELECT source_id, round(avg(score), 9) AS score FROM (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, key) <= 3) GROUP BY 1")
def q_sources_top_mean(spark: SparkSession, d: str) -> DataFrame:
    """Sources by the mean of their best three blocks."""
    return fusion.by_source(_fused(spark, d), "top_mean").select("source_id", F.round("score", 9).alias("score"))


def _vector_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("row_id"), F.col("label").cast("string").alias("source_id"), "embedding")


def _vector_query(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _vector_rows(spark, d)
        asked = rows.where(F.col("row_id").cast("long") % 100 == 0).select(F.col("row_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("exclude_source_id"))
        return semantic.search_many(rows, asked, 50, metric=metric).select("query_id", "row_id", F.round("similarity", 5).alias("score"))

    run.__doc__ = f"The 50 nearest vectors by {metric} of every vector whose id is divisible by 100."
    return run


for _metric, _expr in (("cosine", "list_cosine_similarity(a, b)"), ("dot", "list_inner_product(a, b)"), ("l2", "-list_distance(a, b)")):
    query(
        f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings), q AS (SELECT vec_id AS q, b AS a FROM e WHERE vec_id % 100 = 0) SELECT CAST(q AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS row_id, round({_expr}, 5) AS score FROM q, e QUALIFY row_number() OVER (PARTITION BY q ORDER BY round({_expr}, 11) DESC, CAST(vec_id AS VARCHAR)) <= 50",
        name=f"q_vector_{_metric}",
    )(_vector_query(_metric))


_PAGE_SQL = """
WITH once AS (SELECT DISTINCT ON (row_id) c.* FROM chunks c JOIN artifacts a USING (artifact_id) WHERE row_id IS NOT NULL AND a.is_active),
""" + _POSTINGS_SQL.split("WHERE row_id IS NOT NULL),", 1)[1] + f", {_WEIGHTS_SQL}, g(field, weight) AS (SELECT * FROM w UNION ALL VALUES ('ngram', 1.0))"
_SOURCES_ONCE = ", src AS (SELECT DISTINCT ON (source_id) * FROM sources WHERE source_id IS NOT NULL)"


def _bm25_sql(words: list[str], grams: list[str], excluded: str, where: str) -> str:
    """Hits of words (grams in the n-gram field), best 80."""
    listed = lambda terms: ", ".join(f"'{t}'" for t in terms) or "NULL"
    return f""", hit AS (
  SELECT row_id, round(sum(CAST(weight AS DOUBLE) * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
  FROM p JOIN dfs USING (field, term) JOIN stats USING (field) JOIN g USING (field) WHERE (field <> 'ngram' AND term IN ({listed(words)}) OR field = 'ngram' AND term IN ({listed(grams)}))
  AND row_id NOT IN (SELECT row_id FROM p WHERE field IN ('body', 'ngram') AND term = '{excluded}') GROUP BY 1
), lex AS (SELECT row_id, source_id, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM hit JOIN once USING (row_id) WHERE {where} QUALIFY rank <= 80)"""


_BLOCKS_QUERY = 'hybrid: lantern "the quiet index" -harbor ext:md'


@query(
    _PAGE_SQL + _SOURCES_ONCE + _bm25_sql(["the", "quiet", "index", "lantern"], [], "harbor", "extension = 'md'")
    + f""", {VECTORS_SQL},
sem AS (SELECT row_id, vecs.source_id, row_number() OVER (ORDER BY {_cosine_sql(_literal(_EMBED(["the quiet index lantern"])[0]), "v")} DESC, row_id) AS rank FROM vecs JOIN once USING (row_id) WHERE extension = 'md' QUALIFY rank <= 80),
found AS (
  SELECT source_id, row_id, 4 AS prio, instr(lower(text_raw), 'the quiet index') - 1 AS off, 'exact_phrase' AS kind FROM once WHERE extension = 'md' AND contains(lower(text_raw), 'the quiet index')
  UNION ALL SELECT source_id, NULL, prio, 0, kind FROM (SELECT source_id, unnest([{{'prio': 0, 'kind': 'matched_title', 'ok': contains(lower(title_raw), 'the quiet index')}}, {{'prio': 1, 'kind': 'matched_alias', 'ok': len(list_filter(aliases, lambda x: contains(lower(x), 'the quiet index'))) > 0}},
    {{'prio': 2, 'kind': 'matched_filename', 'ok': contains(lower(filename_raw), 'the quiet index')}}, {{'prio': 3, 'kind': 'matched_path', 'ok': contains(lower(path_raw), 'the quiet index')}}, {{'prio': 5, 'kind': 'matched_tag', 'ok': len(list_filter(tags, lambda x: contains(lower('#' || x), 'the quiet index'))) > 0}}], recursive := true) FROM src WHERE extension = 'md') WHERE ok
), ex AS (SELECT *, row_number() OVER (ORDER BY prio, off, source_id, row_id NULLS FIRST) AS rank FROM found QUALIFY rank <= 50),
e1 AS (SELECT coalesce(row_id, 'source:' || source_id) AS key, any_value(source_id) AS source_id, min(rank) AS rank, arg_min(kind, rank) AS kind FROM ex GROUP BY 1),
fused AS (
  SELECT key, coalesce(e1.source_id, lex.source_id, sem.source_id) AS source_id, 0 + coalesce(1.4 / (60.0 + e1.rank), 0) + coalesce(1.0 / (60.0 + lex.rank), 0) + coalesce(1.0 / (60.0 + sem.rank), 0) AS score,
    concat_ws(' ', e1.kind, CASE WHEN lex.rank IS NOT NULL THEN 'lexical' END, CASE WHEN sem.rank IS NOT NULL THEN 'semantic' END, CASE WHEN CAST(e1.rank IS NOT NULL AS INT) + CAST(lex.rank IS NOT NULL AS INT) + CAST(sem.rank IS NOT NULL AS INT) >= 2 THEN 'hybrid' END) AS kinds
  FROM (SELECT key FROM e1 UNION SELECT row_id FROM lex UNION SELECT row_id FROM sem) LEFT JOIN e1 USING (key) LEFT JOIN lex ON lex.row_id = key LEFT JOIN sem ON sem.row_id = key
), seen AS (SELECT fused.* FROM fused LEFT JOIN once ON once.row_id = key WHERE text_raw IS NULL OR NOT contains(lower(text_raw), 'harbor')),
few AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, key) <= 2), page AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rank FROM few QUALIFY rank <= 20)
SELECT key AS id, source_id, path_raw AS path, title_raw AS title, round(score, 9) AS score, kinds, CAST(rank AS INT) AS rank FROM page JOIN src USING (source_id)"""
)
def q_search_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A whole search for blocks: parsing, exact, lexical and semantic retrieval, fusion, exclusion, diversity, reasons."""
    service = SearchService(table(spark, d, "sources"), _with_vectors(spark, d), embed=lambda t: _EMBED([t])[0])
    found = service.search(_BLOCKS_QUERY).results
    return found.select("id", "source_id", "path", "title", F.round("score", 9).alias("score"), F.array_join(F.transform("reasons", lambda x: x["kind"]), " ").alias("kinds"), "rank")


@query(
    _PAGE_SQL + _SOURCES_ONCE + _bm25_sql(["garden", "lantern", "索引"], ["索引"], "", "true")
    + """, best AS (SELECT source_id, 0 + 1.0 / (60.0 + min(rank)) AS score, count(*) AS block_count, arg_min(row_id, rank) AS id FROM lex GROUP BY 1)
SELECT id, source_id, path_raw AS path, title_raw AS title, round(score, 9) AS score, block_count, CAST(row_number() OVER (ORDER BY score DESC, source_id) AS INT) AS rank FROM best JOIN src USING (source_id) QUALIFY rank <= 20"""
)
def q_search_sources(spark: SparkSession, d: str) -> DataFrame:
    """A search for sources, in two scripts, by their best blocks."""
    service = SearchService(table(spark, d, "sources"), _with_vectors(spark, d))
    return service.search("lexical: garden lantern 索引", result_type="sources").results.select("id", "source_id", "path", "title", F.round("score", 9).alias("score"), "block_count", "rank")


_LINKS_SQL = r"""
WITH s AS (SELECT DISTINCT ON (source_id) * FROM sources),
names AS (SELECT DISTINCT source_id, unnest([lower(trim(regexp_replace(regexp_extract(path_raw, '[^/]*$'), '(.)\.[^.]+$', '\1'))), lower(trim(title_raw))]) AS name FROM s),
targets AS (SELECT DISTINCT source_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(link, '#.*$', '', 's'), '^.*/', '', 's'), '\.md$', '', 'i'))) AS name FROM (SELECT source_id, unnest(links) AS link FROM s) WHERE link IS NOT NULL),
g AS (SELECT DISTINCT t.source_id AS src, n.source_id AS dst FROM targets t JOIN names n USING (name) WHERE name <> '' AND t.source_id <> n.source_id)
"""


@query(_LINKS_SQL + "SELECT src, dst FROM g")
def c_link_graph(spark: SparkSession, d: str) -> DataFrame:
    """Links between notes, by file name or title."""
    return connections.link_graph(table(spark, d, "sources", "source_id", "path_raw", "title_raw", "links").dropDuplicates(["source_id"]))


@query(
    _LINKS_SQL
    + """, me AS (SELECT * FROM s ORDER BY source_id LIMIT 1)
SELECT dst AS source_id, 'wikilink' AS kind, CAST(0.2 AS DOUBLE) AS score FROM g JOIN me ON src = me.source_id
UNION ALL SELECT src, 'backlink', 0.15 FROM g JOIN me ON dst = me.source_id
UNION ALL SELECT source_id, 'shared_tag', CAST(0.05 AS DOUBLE) * least(count(*), 2) FROM (SELECT source_id, unnest(tags) AS t FROM s WHERE source_id <> (SELECT source_id FROM me)) WHERE lower(t) IN (SELECT lower(unnest(tags)) FROM me) GROUP BY 1"""
)
def c_link_signals(spark: SparkSession, d: str) -> DataFrame:
    """Link and tag signals of the first note."""
    sources = table(spark, d, "sources")
    me = sources.agg(F.min("source_id").alias("m")).first()["m"]
    return connections.link_signals(sources, me).select("source_id", "kind", "score")


def _with_vectors(spark: SparkSession, d: str) -> DataFrame:
    active = table(spark, d, "artifacts").where("is_active").select("artifact_id", "dimension")
    chunks = table(spark, d, "chunks").join(F.broadcast(active), "artifact_id").withColumn("embedding", vectors.decode_base64("embedding_base64"))
    return chunks.withColumn("embedding", F.when(F.size("embedding") == F.col("dimension"), F.col("embedding")))


_SIGNALS_SQL = """SELECT dst AS source_id, 'wikilink' AS kind, CAST(0.2 AS DOUBLE) AS score, NULL AS detail FROM g JOIN me ON src = me.source_id
UNION ALL SELECT src, 'backlink', 0.15, NULL FROM g JOIN me ON dst = me.source_id
UNION ALL SELECT source_id, 'shared_tag', CAST(0.05 AS DOUBLE) * least(count(*), 2), NULL FROM (SELECT source_id, unnest(tags) AS t FROM s WHERE source_id <> (SELECT source_id FROM me)) WHERE lower(t) IN (SELECT lower(unnest(tags)) FROM me) GROUP BY 1"""
_RELATED_SQL = """, total AS (SELECT source_id, round(sum(score), 9) AS score, string_agg(kind, ' ' ORDER BY kind) AS kinds, max(detail) AS evidence_row_id FROM signals GROUP BY 1)
SELECT source_id, path_raw AS path, round(score, 6) AS score, kinds, evidence_row_id, CAST(row_number() OVER (ORDER BY score DESC, source_id) AS INT) AS rank FROM total JOIN s USING (source_id) QUALIFY rank <= 20"""


def _related(found: connections.Related) -> DataFrame:
    return found.items.select("source_id", "path", F.round("score", 6).alias("score"), F.array_join(F.transform("edges", lambda e: e["kind"]), " ").alias("kinds"), "evidence_row_id", "rank")


@query(
    _LINKS_SQL
    + f""", {VECTORS_SQL}, ids AS (SELECT min(source_id) AS id FROM vecs), me AS (SELECT s.* FROM s, ids WHERE source_id = id),
blocks AS (SELECT v.row_id AS q, v.v AS qv FROM vecs v JOIN me USING (source_id) JOIN (SELECT DISTINCT row_id, length(text_raw) AS n, chunk_ordinal FROM chunks) c USING (row_id) ORDER BY n DESC, chunk_ordinal, v.row_id LIMIT 4),
near AS (SELECT source_id, row_id, {_cosine_sql("qv", "v")} AS sim FROM blocks, vecs WHERE source_id <> (SELECT id FROM ids) QUALIFY row_number() OVER (PARTITION BY q ORDER BY round({_cosine_sql("qv", "v")}, 11) DESC, row_id) <= 24),
signals AS (SELECT source_id, 'semantic' AS kind, least(1, max(sim)) AS score, arg_max(row_id, {{'a': round(sim, 11), 'b': row_id}}) AS detail FROM near WHERE sim > 0 GROUP BY 1 UNION ALL {_SIGNALS_SQL})"""
    + _RELATED_SQL
)
def c_connections(spark: SparkSession, d: str) -> DataFrame:
    """Notes related to the first one that has vectors: blocks, links and tags together."""
    sources, chunks = table(spark, d, "sources"), _with_vectors(spark, d)
    me = chunks.where("size(embedding) > 0 and row_id is not null").agg(F.min("source_id").alias("m")).first()["m"]
    return _related(connections.for_source(sources, chunks, me, 20))


@query(
    f"WITH s AS (SELECT DISTINCT ON (source_id) * FROM sources), {VECTORS_SQL}, ids AS (SELECT min(source_id) AS id FROM vecs),"
    + f"""near AS (SELECT source_id, row_id, {_cosine_sql("v", _literal(_EMBED(["how the lantern lights the garden"])[0]))} AS sim FROM vecs WHERE source_id <> (SELECT id FROM ids) QUALIFY row_number() OVER (ORDER BY round({_cosine_sql("v", _literal(_EMBED(["how the lantern lights the garden"])[0]))}, 11) DESC, row_id) <= 48),
signals AS (SELECT source_id, 'semantic' AS kind, least(1, max(sim)) AS score, arg_max(row_id, {{'a': round(sim, 11), 'b': row_id}}) AS detail FROM near WHERE sim > 0 GROUP BY 1)"""
    + _RELATED_SQL
)
def c_selection(spark: SparkSession, d: str) -> DataFrame:
    """Notes related to a selected text, by its vector; links don't count."""
    chunks = _with_vectors(spark, d)
    me = chunks.where("size(embedding) > 0 and row_id is not null").agg(F.min("source_id").alias("m")).first()["m"]
    return _related(connections.for_selection(table(spark, d, "sources"), chunks, "how the lantern lights the garden", me, embed=lambda t: _EMBED([t])[0]))


@query(
    _PAGE_SQL + ", s AS (SELECT DISTINCT ON (source_id) * FROM sources WHERE source_id IS NOT NULL)" + _bm25_sql(["garden", "lantern", "kiln"], [], "", "true").replace("QUALIFY rank <= 80", "QUALIFY rank <= 48").replace("source_id, row_number()", "source_id, score, row_number()")
    + ", signals AS (SELECT source_id, 'lexical' AS kind, 0.6 * max(score) / (SELECT max(score) FROM lex) AS score, arg_max(row_id, {'a': score, 'b': row_id}) AS detail FROM lex GROUP BY 1)"
    + _RELATED_SQL
)
def c_selection_words(spark: SparkSession, d: str) -> DataFrame:
    """The same without an embedder: by words."""
    return _related(connections.for_selection(table(spark, d, "sources"), _with_vectors(spark, d), "garden lantern kiln"))


@query("""SELECT artifact_id, source_id, m.status AS status, m.seen_revision AS seen_revision, m.indexed_revision AS indexed_revision FROM (
  SELECT artifact_id, source_id, arg_max({'status': status, 'seen_revision': seen_revision, 'indexed_revision': indexed_revision},
  {'a': coalesce(indexed_revision, 0), 'b': coalesce(seen_revision, 0), 'c': coalesce(updated_ms, 0), 'd': coalesce(retry_count, 0), 'e': coalesce(status, '')}) AS m FROM index_manifest GROUP BY 1, 2)""")
def m_manifest_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of each source of each artifact."""
    return mutations.manifest_state(table(spark, d, "index_manifest")).select("artifact_id", "source_id", "status", "seen_revision", "indexed_revision")


@query("""WITH m AS (SELECT arg_max(status, {'a': coalesce(indexed_revision, 0), 'b': coalesce(seen_revision, 0), 'c': coalesce(updated_ms, 0), 'd': coalesce(retry_count, 0), 'e': coalesce(status, '')}) AS status FROM index_manifest GROUP BY artifact_id, source_id)
SELECT (SELECT count(DISTINCT source_id) FROM sources) AS sources, (SELECT count(DISTINCT row_id) FROM chunks) AS chunks, (SELECT count(DISTINCT row_id) FROM chunks WHERE embedding_base64 IS NOT NULL) AS with_embedding,
count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'stale') AS stale FROM m""")
def m_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Size and health of the index."""
    return mutations.store_statistics(table(spark, d, "sources"), table(spark, d, "chunks"), table(spark, d, "index_manifest"), "embedding_base64")


_FEED_SQL = """WITH f AS (SELECT path_raw AS path, arg_max({'h': lower(raw_content_hash), 'm': mtime_ms, 's': size_bytes}, {'r': source_revision, 'q': seq}) AS x FROM vault_changes WHERE change_kind <> 'delete' GROUP BY 1),
c AS (SELECT path_raw AS path, min(lower(raw_content_hash)) AS h, min(mtime_ms) AS m, min(size_bytes) AS s FROM sources GROUP BY 1)
"""


@query(_FEED_SQL + """SELECT outcome, count(*) AS paths FROM (SELECT CASE WHEN c.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'removed' WHEN f.x.h IS DISTINCT FROM c.h THEN 'changed'
  WHEN f.x.m IS DISTINCT FROM c.m OR f.x.s IS DISTINCT FROM c.s THEN 'touched' ELSE 'unchanged' END AS outcome FROM f FULL JOIN c ON f.path = c.path) GROUP BY 1""")
def m_scan_diff(spark: SparkSession, d: str) -> DataFrame:
    """A full scan: the files the feed tells of against the catalog, by outcome."""
    feed = table(spark, d, "vault_changes").where("change_kind <> 'delete'")
    files = feed.groupBy(F.col("path_raw").alias("path")).agg(F.max_by(F.struct("raw_content_hash", "mtime_ms", "size_bytes"), F.struct("source_revision", "seq")).alias("x")).select("path", "x.*")
    catalog = table(spark, d, "sources").groupBy("path_raw").agg(F.min(F.lower("raw_content_hash")).alias("raw_content_hash"), F.min("mtime_ms").alias("mtime_ms"), F.min("size_bytes").alias("size_bytes"))
    return indexing.scan_diff(files, catalog).groupBy("outcome").agg(F.count("*").alias("paths"))


@query("SELECT path_raw AS path, max(source_revision) AS generation, arg_max(change_kind, {'a': source_revision, 'b': change_kind}) AS kind FROM vault_changes WHERE path_raw IS NOT NULL GROUP BY 1")
def r_latest_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The task with the highest generation of each path."""
    tasks = table(spark, d, "vault_changes").where("path_raw is not null").select(F.col("path_raw").alias("path"), F.col("change_kind").alias("kind"), F.col("source_revision").alias("generation"))
    return coalescer.latest_tasks(tasks)


@query("""WITH e AS (SELECT DISTINCT ON (seq, change_kind, path_raw) seq, change_kind AS k, path_raw AS p, old_path_raw AS o FROM vault_changes WHERE path_raw IS NOT NULL AND change_kind IN ('create', 'modify', 'delete', 'rename')),
l AS (SELECT list({'k': k, 'p': p, 'o': o} ORDER BY seq NULLS FIRST, k, p) AS events FROM e),
f AS (SELECT list_reduce(events, lambda s, x: {
  'e': s.e,
  'm': CASE WHEN x.k = 'delete' AND s.m[x.p].origin IS NOT NULL THEN map_concat(map_from_entries(list_filter(map_entries(s.m), lambda y: y.key <> x.p)), MAP {s.m[x.p].origin: {'deleted': true, 'origin': NULL::VARCHAR, 'dirty': false}})
        WHEN x.k = 'delete' THEN map_concat(s.m, MAP {x.p: {'deleted': true, 'origin': NULL::VARCHAR, 'dirty': false}})
        WHEN x.k = 'rename' AND x.o IS NOT NULL THEN map_concat(map_from_entries(list_filter(map_entries(s.m), lambda y: y.key <> x.o)), MAP {x.p: {'deleted': false, 'origin': coalesce(s.m[x.o].origin, x.o), 'dirty': coalesce(s.m[x.o].dirty, false)}})
        ELSE map_concat(s.m, MAP {x.p: {'deleted': false, 'origin': s.m[x.p].origin, 'dirty': true}}) END,
  'g': map_concat(CASE WHEN x.k = 'delete' AND s.m[x.p].origin IS NOT NULL THEN map_concat(s.g, MAP {s.m[x.p].origin: coalesce(s.g[s.m[x.p].origin], 0) + 1}) ELSE s.g END,
       MAP {x.p: CASE WHEN x.k = 'rename' AND x.o IS NOT NULL THEN greatest(coalesce(s.g[x.o], 0), coalesce(s.g[x.p], 0)) + 1
                      WHEN x.k = 'delete' AND s.m[x.p].origin = x.p THEN coalesce(s.g[x.p], 0) + 2 ELSE coalesce(s.g[x.p], 0) + 1 END})
  }, {'e': 0, 'm': MAP {'': {'deleted': false, 'origin': NULL::VARCHAR, 'dirty': false}}, 'g': MAP {'': 0}}) AS s FROM l),
t AS (SELECT s.g AS g, unnest(map_entries(s.m)) AS m FROM f)
SELECT CASE WHEN m.value.deleted THEN 'delete' WHEN m.value.origin IS NOT NULL AND m.value.origin <> m.key THEN 'rename' ELSE 'upsert' END AS kind, m.key AS path, CASE WHEN NOT m.value.deleted AND m.value.origin <> m.key THEN m.value.origin END AS old_path, CAST(g[m.key] AS BIGINT) AS generation,
  CASE WHEN m.value.deleted THEN false WHEN m.value.origin IS NOT NULL AND m.value.origin <> m.key THEN m.value.dirty ELSE true END AS dirty FROM t WHERE m.key <> ''""")
def r_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """The change feed as one batch of events, coalesced to tasks."""
    events = table(spark, d, "vault_changes").select("seq", F.col("change_kind").alias("kind"), F.col("path_raw").alias("path"), F.col("old_path_raw").alias("old_path"))
    return coalescer.coalesce_batch(events, spark.createDataFrame([], "path string, generation long"))[0]


def _notes(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), "path_raw").alias("path"), F.col("text").alias("content"), F.col("mtime_ms").alias("ctime_ms"), "mtime_ms", F.octet_length("text").cast("long").alias("size_bytes"))
    return indexing.extract_notes(files.where(indexing.in_scope("path")))


@query()
def i_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes: structure, chunks, terms and hashes, without long arrays."""
    return indexing.chunk_rows(_notes(spark, d)).select("row_id", "source_id", "structural_anchor", "chunk_ordinal", "block_type", "line_start", "line_end", "char_start", "char_end", F.size("lexical_terms").alias("terms"), "raw_chunk_hash", "lexical_input_hash", "embedding_input_hash")


@query("SELECT CAST(doc_id AS VARCHAR) || '/' || path_raw AS path_raw, sha256(text) AS raw_content_hash, strlen(text) AS size_bytes FROM documents WHERE regexp_matches(path_raw, '\\.(md|txt)$', 'i')")
def i_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes: the catalog rows."""
    return indexing.source_rows(_notes(spark, d)).select("path_raw", "raw_content_hash", "size_bytes")


@query()
def i_embed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks embedded by the stand-in embedder, in batches within limits, and attached by their input hash."""
    rows = indexing.chunk_rows(_notes(spark, d))
    done = semantic.embed_column(rows, lambda: semantic.hash_embedder(32))
    return semantic.attach(rows.select("row_id", "embedding_input_hash", "embedding"), done).select("row_id", F.size("embedding").alias("dimension"), F.round(vectors.norm(F.col("embedding")), 3).alias("norm"))


@query("""WITH c AS (SELECT DISTINCT row_id, source_id, chunk_ordinal, block_type FROM chunks), r AS (SELECT source_id AS query_id, row_id AS target_id, row_number() OVER (PARTITION BY source_id ORDER BY chunk_ordinal DESC, row_id) AS rank FROM c),
e AS (SELECT DISTINCT source_id AS query_id, row_id AS target_id, block_type AS grp FROM c WHERE chunk_ordinal = 1),
q AS (SELECT e.query_id, grp, min(r.rank) AS first FROM e LEFT JOIN r ON r.query_id = e.query_id AND r.target_id = e.target_id GROUP BY 1, 2)
SELECT grp AS "group", count(*) AS queries, round(avg(CASE WHEN first <= 2 THEN 1 ELSE 0 END), 6) AS recall, round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END), 6) AS mrr, CAST(0 AS DOUBLE) AS zero_rate FROM q GROUP BY 1""")
def e_quality(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank and zero results by group; ranked lists are the chunks of a source, last first."""
    from pyspark.sql import Window

    c = table(spark, d, "chunks", "row_id", "source_id", "chunk_ordinal", "block_type").distinct()
    order = Window.partitionBy("source_id").orderBy(F.desc("chunk_ordinal"), "row_id")
    results = c.select(F.col("source_id").alias("query_id"), F.col("row_id").alias("target_id"), F.row_number().over(order).alias("rank"))
    expected = c.where("chunk_ordinal = 1").select(F.col("source_id").alias("query_id"), F.col("row_id").alias("target_id"), F.col("block_type").alias("group"))
    return evaluation.quality(results, expected, 2, 10).select("group", "queries", *[F.round(x, 6).alias(x) for x in ("recall", "mrr", "zero_rate")])


@query("SELECT event_type, list_sort(list(value))[CAST(least(count(*) - 1, floor(count(*) * 0.95)) AS INT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def e_percentile(spark: SparkSession, d: str) -> DataFrame:
    """The 95th percentile of event values by type, as latency gates take it."""
    return evaluation.percentiles(table(spark, d, "events", "event_type", "value"), "event_type", "value", 0.95).withColumnRenamed("value", "p95")


@query("SELECT DISTINCT source_id, strip_accents(lower(title_raw)) AS title FROM sources")
def x_fold_accents(spark: SparkSession, d: str) -> DataFrame:
    """Titles without accents."""
    return table(spark, d, "sources", "source_id", "title_raw").distinct().select("source_id", tx.fold_accents(F.lower("title_raw")).alias("title"))


@query(r"""SELECT DISTINCT source_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(filename_raw, '::|[./\-_]', '|', 'g'),
  '([\p{Ll}\p{N}])(\p{Lu})', '\1|\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1|\2', 'g'), '\|+', '|', 'g'), '|'), lambda p: p <> ''), '|') AS parts FROM sources""")
def x_identifier_parts(spark: SparkSession, d: str) -> DataFrame:
    """File names cut at separators and camel-case boundaries."""
    return table(spark, d, "sources", "source_id", "filename_raw").distinct().select("source_id", F.array_join(tx.split_identifier("filename_raw"), "|").alias("parts"))


@query(r"""WITH s AS (SELECT DISTINCT source_id, lower(path_raw) AS p FROM sources), n AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS seg FROM s)
SELECT source_id, array_to_string(list_sort(list_distinct(seg || [p] || CASE WHEN regexp_matches(seg[-1], '^.+\.[^.]*$') THEN [regexp_extract(seg[-1], '^(.+)\.([^.]*)$', 1), regexp_extract(seg[-1], '^(.+)\.([^.]*)$', 2)] ELSE [] END)), '|') AS terms FROM n""")
def x_path_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the paths of sources."""
    return table(spark, d, "sources", "source_id", "path_raw").distinct().select("source_id", F.array_join(F.array_sort(tx.path_terms("path_raw")), "|").alias("terms"))


@query(r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text_raw), '[\p{L}\p{N}_]+')) AS w FROM (SELECT DISTINCT row_id, text_raw FROM chunks)) GROUP BY 1")
def x_words(spark: SparkSession, d: str) -> DataFrame:
    """Word counts over all chunks."""
    own = table(spark, d, "chunks", "row_id", "text_raw").distinct()
    return own.select(F.explode(tx.words(F.lower("text_raw"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(r"""WITH c AS (SELECT DISTINCT row_id, lower(text_raw) AS t FROM chunks), r AS (SELECT unnest(regexp_extract_all(t, '[\p{Han}\p{Hiragana}\p{Katakana}]+') || regexp_extract_all(t, '\p{Hangul}+')) AS run FROM c),
g AS (SELECT run AS ngram FROM r WHERE length(run) < 2 UNION ALL SELECT substr(run, i, 2) FROM (SELECT run, unnest(range(1, length(run))) AS i FROM r WHERE length(run) >= 2) UNION ALL SELECT substr(run, i, 3) FROM (SELECT run, unnest(range(1, length(run) - 1)) AS i FROM r WHERE length(run) >= 3))
SELECT ngram, count(*) AS n FROM g GROUP BY 1""")
def x_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Character n-grams over all chunks."""
    own = table(spark, d, "chunks", "row_id", "text_raw").distinct()
    return own.select(F.explode(tx.ngrams(F.lower("text_raw"))).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


@query(r"""WITH c AS (SELECT row_id, length(regexp_replace(text_raw, '[^\p{Hiragana}\p{Katakana}]', '', 'g')) AS kana, length(regexp_replace(text_raw, '[^\p{Han}]', '', 'g')) AS han, length(regexp_replace(text_raw, '[^\p{Hangul}]', '', 'g')) AS hangul FROM (SELECT DISTINCT row_id, text_raw FROM chunks)),
o AS (SELECT row_id, CASE WHEN kana > 0 THEN kana + han ELSE 0 END AS ja, hangul AS ko, CASE WHEN kana = 0 THEN han ELSE 0 END AS zh FROM c)
SELECT row_id, CASE WHEN ja > 0 AND ja >= ko THEN 'ja' WHEN ko > 0 AND ko >= zh THEN 'ko' WHEN zh > 0 THEN 'zh' ELSE 'und' END AS primary_language FROM o""")
def x_primary_language(spark: SparkSession, d: str) -> DataFrame:
    """The language that scripts alone tell, of each chunk."""
    own = table(spark, d, "chunks", "row_id", "text_raw").select("row_id", tx.script_counts("text_raw").alias("s")).distinct().withColumn("l", tx.language_of("s"))
    return own.select("row_id", "l.primary_language")


@query("""WITH h AS (SELECT row_id, text_raw AS t, instr(lower(text_raw), 'lantern') - 1 AS o FROM (SELECT DISTINCT row_id, text_raw FROM chunks) WHERE contains(lower(text_raw), 'lantern')),
s AS (SELECT *, greatest(0, o - 60) AS a FROM h), e AS (SELECT *, least(length(t), a + 240) AS b FROM s)
SELECT row_id, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(t, a + 1, b - a) || CASE WHEN b < length(t) THEN '…' ELSE '' END AS snippet, CAST(o - a + CASE WHEN a > 0 THEN 1 ELSE 0 END AS INT) AS highlight_start, CAST(length(t[1:o]) - length(replace(t[1:o], chr(10), '')) AS INT) AS line FROM e""")
def x_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Snippets around a word, with the place of the highlight and the line."""
    own = table(spark, d, "chunks", "row_id", "text_raw").distinct().withColumn("o", tx.find_verified("text_raw", F.lit("Lantern"))).where("o is not null")
    made = own.withColumn("s", tx.snippet("text_raw", F.col("o"), F.lit(7)))
    return made.select("row_id", "s.snippet", "s.highlight_start", tx.count_lines("text_raw", F.col("o")).alias("line"))


@query("SELECT vec_id, abs(sqrt(list_inner_product(v, v)) - 1) < 0.01 AS is_unit FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def x_is_unit(spark: SparkSession, d: str) -> DataFrame:
    """Which vectors are normalised."""
    return table(spark, d, "embeddings").select("vec_id", vectors.is_unit(F.col("embedding")).alias("is_unit"))


@query(r"SELECT DISTINCT path_raw AS path FROM sources WHERE regexp_matches(lower(path_raw), '\.md$') AND (starts_with(path_raw, 'notes/') OR path_raw = 'notes' OR regexp_matches(path_raw, '^projects/.*/.*$')) AND NOT (starts_with(path_raw, 'notes/daily/') OR path_raw = 'notes/daily')")
def s_scope(spark: SparkSession, d: str) -> DataFrame:
    """Paths in a corpus scope with folders, a pattern and an exclusion."""
    paths = table(spark, d, "sources").select(F.col("path_raw").alias("path")).distinct()
    return paths.where(indexing.in_scope("path", ("md",), ("notes", "projects/*/*"), ("notes/daily",)))


@query("""SELECT source_id, row_id FROM (SELECT DISTINCT source_id, row_id, chunk_ordinal, length(text_raw) AS n FROM chunks WHERE embedding_base64 IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, chunk_ordinal, row_id) <= 4""")
def c_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The four longest chunks with vectors of each source."""
    own = table(spark, d, "chunks").withColumn("embedding", F.when(F.col("embedding_base64").isNotNull(), F.array(F.lit(1.0))))
    return connections.representative_blocks(own).select("source_id", "row_id")


@query("""WITH t AS (SELECT source_id, path_raw AS path, max(source_revision) OVER (PARTITION BY source_id) AS latest, source_revision AS revision, lower(raw_content_hash) AS h FROM (SELECT DISTINCT source_id, path_raw, source_revision, raw_content_hash FROM vault_changes)),
m AS (SELECT source_id, max(indexed_revision) AS held FROM index_manifest WHERE artifact_id = (SELECT min(artifact_id) FROM artifacts WHERE is_active) GROUP BY 1), s AS (SELECT source_id, min(lower(raw_content_hash)) AS old FROM sources GROUP BY 1)
SELECT CASE WHEN h IS NULL THEN 'removed' WHEN revision < latest OR revision <= coalesce(held, 0) THEN 'superseded' WHEN h = old THEN 'skipped' ELSE 'index' END AS outcome, count(*) AS tasks FROM t LEFT JOIN m USING (source_id) LEFT JOIN s USING (source_id) GROUP BY 1""")
def m_decide(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each delivered revision: removed, superseded, skipped or indexed."""
    from pyspark.sql import Window

    feed = table(spark, d, "vault_changes", "source_id", "path_raw", "source_revision", "raw_content_hash").distinct()
    tasks = feed.select("source_id", F.col("path_raw").alias("path"), F.col("source_revision").alias("revision"), F.max("source_revision").over(Window.partitionBy("source_id")).alias("latest_revision"), "raw_content_hash")
    catalog = table(spark, d, "sources").groupBy("source_id").agg(F.min(F.lower("raw_content_hash")).alias("raw_content_hash"))
    return mutations.decide_upsert(tasks, table(spark, d, "index_manifest"), catalog, _active_id(spark, d)).groupBy("outcome").agg(F.count("*").alias("tasks"))


@query("""WITH s AS (SELECT DISTINCT source_id, path_raw, filename_raw, source_revision, folder_norm, extension FROM sources)
SELECT source_id, CASE WHEN extension = 'txt' THEN 'Moved/' || filename_raw ELSE path_raw END AS path_raw, CASE WHEN extension = 'txt' THEN 'moved' ELSE folder_norm END AS folder_norm, CAST(source_revision + CASE WHEN extension = 'txt' THEN 1 ELSE 0 END AS INT) AS source_revision FROM s""")
def m_rename(spark: SparkSession, d: str) -> DataFrame:
    """The catalog after moving all text files to another folder."""
    sources = table(spark, d, "sources").dropDuplicates(["source_id"])
    moves = sources.where("extension = 'txt'").select("source_id", F.concat(F.lit("Moved/"), "filename_raw").alias("new_path"))
    return mutations.rename_sources(sources, table(spark, d, "chunks"), moves)[0].select("source_id", "path_raw", "folder_norm", "source_revision")


_STATE_SQL = """WITH act AS (SELECT min(artifact_id) AS id FROM artifacts WHERE is_active),
st AS (SELECT artifact_id, source_id, arg_max({'status': status, 'seen': seen_revision, 'retries': retry_count}, {'a': coalesce(indexed_revision, 0), 'b': coalesce(seen_revision, 0), 'c': coalesce(updated_ms, 0), 'd': coalesce(retry_count, 0), 'e': coalesce(status, '')}) AS m FROM index_manifest GROUP BY 1, 2),
src AS (SELECT DISTINCT source_id, extension, source_revision, mtime_ms, size_bytes FROM sources WHERE source_id IS NOT NULL)
"""


def _active_id(spark: SparkSession, d: str) -> str:
    return table(spark, d, "artifacts").where("is_active").agg(F.min("artifact_id").alias("id")).first()["id"]


def _states(manifest: DataFrame) -> DataFrame:
    return mutations.manifest_state(manifest).groupBy("artifact_id", "status").agg(F.count("*").alias("sources"), F.sum("seen_revision").alias("seen"), F.sum("retry_count").alias("retries"))


@query(
    _STATE_SQL
    + """, own AS (SELECT * FROM src WHERE extension = 'txt' OR source_revision % 2 = 0), held AS (SELECT source_id, max(indexed_revision) AS held FROM index_manifest WHERE artifact_id = (SELECT id FROM act) GROUP BY 1),
fresh AS (SELECT source_id, source_revision + 1 AS revision FROM own LEFT JOIN held USING (source_id) WHERE held IS NULL OR source_revision + 1 > held), c AS (SELECT DISTINCT row_id, source_id, chunk_ordinal FROM chunks)
SELECT 'sources' AS kind, count(*) AS n, CAST(sum(coalesce(revision, source_revision)) AS BIGINT) AS revisions FROM src LEFT JOIN fresh USING (source_id)
UNION ALL SELECT 'chunks', count(*) FILTER (fresh.source_id IS NULL OR chunk_ordinal = 0), NULL FROM c LEFT JOIN fresh USING (source_id)
UNION ALL SELECT 'indexed', count(*) FILTER (m.status = 'indexed') + (SELECT count(*) FROM fresh), NULL FROM st WHERE NOT (artifact_id = (SELECT id FROM act) AND source_id IN (SELECT source_id FROM fresh))"""
)
def m_commit(spark: SparkSession, d: str) -> DataFrame:
    """A commit of new revisions of many sources, each cut down to its first chunk, into the whole catalog: stale ones change nothing."""
    sources, chunks = table(spark, d, "sources").where("source_id is not null").dropDuplicates(["source_id"]), table(spark, d, "chunks").dropDuplicates(["row_id"])
    new = sources.where("extension = 'txt' or source_revision % 2 = 0").withColumn("source_revision", F.col("source_revision") + 1)
    s, c, m = mutations.commit_sources(sources, chunks, table(spark, d, "index_manifest"), new, chunks.where("chunk_ordinal = 0"), _active_id(spark, d))
    counted = s.agg(F.lit("sources").alias("kind"), F.count("*").alias("n"), F.sum("source_revision").alias("revisions"))
    return counted.unionByName(c.agg(F.lit("chunks").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("long").alias("revisions"))).unionByName(mutations.manifest_state(m).agg(F.lit("indexed").alias("kind"), F.count_if(F.col("status") == "indexed").alias("n"), F.lit(None).cast("long").alias("revisions")))


@query(
    _STATE_SQL
    + """, now AS (SELECT (SELECT id FROM act) AS artifact_id, source_id, max(source_revision) AS rev FROM vault_changes WHERE source_id IS NOT NULL GROUP BY source_id),
r AS (SELECT coalesce(st.artifact_id, now.artifact_id) AS artifact_id, CASE WHEN rev IS NOT NULL AND (m.seen IS NULL OR rev > m.seen) THEN {'status': 'pending', 'seen': rev, 'retries': coalesce(m.retries, 0)} ELSE {'status': m.status, 'seen': m.seen, 'retries': m.retries} END AS x FROM st FULL JOIN now ON st.artifact_id = now.artifact_id AND st.source_id = now.source_id)
SELECT artifact_id, x.status AS status, count(*) AS sources, CAST(sum(x.seen) AS BIGINT) AS seen, CAST(sum(x.retries) AS BIGINT) AS retries FROM r GROUP BY 1, 2"""
)
def m_seen(spark: SparkSession, d: str) -> DataFrame:
    """The states after the feed's latest revisions were seen."""
    seen = table(spark, d, "vault_changes").where("source_id is not null").select("source_id", F.col("source_revision").alias("revision"))
    return _states(mutations.mark_seen(table(spark, d, "index_manifest"), seen, _active_id(spark, d)))


@query(
    _STATE_SQL
    + """, now AS (SELECT (SELECT id FROM act) AS artifact_id, source_id, max(source_revision) AS rev FROM src WHERE extension = 'txt' GROUP BY source_id),
r AS (SELECT coalesce(st.artifact_id, now.artifact_id) AS artifact_id, CASE WHEN rev IS NOT NULL THEN {'status': 'failed', 'seen': greatest(rev, coalesce(m.seen, 0)), 'retries': coalesce(m.retries, 0) + 1} ELSE {'status': m.status, 'seen': m.seen, 'retries': m.retries} END AS x FROM st FULL JOIN now ON st.artifact_id = now.artifact_id AND st.source_id = now.source_id)
SELECT artifact_id, x.status AS status, count(*) AS sources, CAST(sum(x.seen) AS BIGINT) AS seen, CAST(sum(x.retries) AS BIGINT) AS retries FROM r GROUP BY 1, 2"""
)
def m_failed(spark: SparkSession, d: str) -> DataFrame:
    """The states after all text files have failed."""
    failed = table(spark, d, "sources").where("source_id is not null and extension = 'txt'").select("source_id", F.col("source_revision").alias("revision"), F.lit("READ_FAILED").alias("code"), F.lit("error.read.failed").alias("message"))
    return _states(mutations.mark_failed(table(spark, d, "index_manifest"), failed, _active_id(spark, d)))


@query(
    _STATE_SQL
    + """, gone AS (SELECT source_id FROM src WHERE extension = 'txt')
SELECT 'sources' AS kind, count(DISTINCT source_id) AS n FROM src WHERE source_id NOT IN (SELECT source_id FROM gone) UNION ALL SELECT 'chunks', count(DISTINCT row_id) FROM chunks WHERE source_id NOT IN (SELECT source_id FROM gone)
UNION ALL SELECT 'states', count(*) FROM st WHERE source_id NOT IN (SELECT source_id FROM gone)"""
)
def m_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left when all text files are deleted, with their chunks and states."""
    sources = table(spark, d, "sources").where("source_id is not null")
    s, c, m = mutations.delete_sources(sources, table(spark, d, "chunks"), mutations.manifest_state(table(spark, d, "index_manifest")), sources.where("extension = 'txt'"))
    return s.agg(F.lit("sources").alias("kind"), F.count_distinct("source_id").alias("n")).unionByName(c.agg(F.lit("chunks").alias("kind"), F.count_distinct("row_id").alias("n"))).unionByName(m.agg(F.lit("states").alias("kind"), F.count("*").alias("n")))


@query(_STATE_SQL + "SELECT source_id, mtime_ms + CASE WHEN extension = 'txt' THEN 1000 ELSE 0 END AS mtime_ms, CASE WHEN extension = 'txt' THEN 7 ELSE size_bytes END AS size_bytes, CAST(source_revision + CASE WHEN extension = 'txt' THEN 1 ELSE 0 END AS INT) AS source_revision FROM src")
def m_touch(spark: SparkSession, d: str) -> DataFrame:
    """The catalog after all text files were touched: times and sizes only."""
    sources = table(spark, d, "sources").where("source_id is not null").dropDuplicates(["source_id"])
    touched = sources.where("extension = 'txt'").select("source_id", (F.col("mtime_ms") + 1000).alias("mtime_ms"), F.lit(7).cast("long").alias("size_bytes"))
    return mutations.touch_sources(sources, touched).select("source_id", "mtime_ms", "size_bytes", "source_revision")


@query(
    _STATE_SQL
    + """SELECT 'failed' AS kind, source_id AS id, CAST(m.seen AS INT) AS revision FROM st WHERE artifact_id = (SELECT id FROM act) AND m.status = 'failed'
UNION ALL SELECT 'missing', row_id, NULL FROM (SELECT DISTINCT row_id, embedding_input_hash FROM chunks WHERE artifact_id = (SELECT id FROM act) AND embedding_base64 IS NULL AND row_id IS NOT NULL AND embedding_input_hash NOT IN (SELECT embedding_input_hash FROM chunks WHERE chunk_ordinal = 1 AND embedding_base64 IS NULL))"""
)
def m_retry(spark: SparkSession, d: str) -> DataFrame:
    """What to try again: failed sources, and chunks without vector that aren't dead letters (here those of second chunks)."""
    chunks = table(spark, d, "chunks", "row_id", "artifact_id", "embedding_input_hash", "chunk_ordinal", F.col("embedding_base64").alias("embedding")).where("row_id is not null")
    dead = chunks.where("chunk_ordinal = 1 and embedding is null").select("embedding_input_hash").distinct()
    failed, missing = mutations.retry_candidates(table(spark, d, "index_manifest"), chunks, chunks.join(dead, "embedding_input_hash", "left_semi"), _active_id(spark, d))
    return failed.select(F.lit("failed").alias("kind"), F.col("source_id").alias("id"), F.col("seen_revision").cast("int").alias("revision")).unionByName(missing.select(F.lit("missing").alias("kind"), F.col("row_id").alias("id"), F.lit(None).cast("int").alias("revision")))


@query("""SELECT source_id, count(*) AS bursts, max(n) AS largest FROM (SELECT source_id, b, count(*) AS n FROM (
  SELECT source_id, sum(new) OVER (PARTITION BY source_id ORDER BY arrived_at, seq ROWS UNBOUNDED PRECEDING) AS b FROM (
    SELECT source_id, arrived_at, seq, CASE WHEN lag(arrived_at) OVER (PARTITION BY source_id ORDER BY arrived_at, seq) > arrived_at - INTERVAL 7 DAY THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT seq, source_id, arrived_at FROM vault_changes WHERE arrived_at IS NOT NULL))) GROUP BY 1, 2) GROUP BY 1""")
def r_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of events of each source: a burst ends when a week passes without any (event-time sessions)."""
    events = table(spark, d, "vault_changes", "seq", "source_id", "arrived_at").distinct().where("arrived_at is not null")
    bursts = events.groupBy("source_id", F.session_window("arrived_at", "7 days")).agg(F.count("*").alias("n"))
    return bursts.groupBy("source_id").agg(F.count("*").alias("bursts"), F.max("n").alias("largest"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), t AS (SELECT list_cosine_similarity(a.v, b.v) > list_cosine_similarity(a.v, c.v) AS ok FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2)
SELECT count(*) AS pairs, count(*) FILTER (ok) AS passed, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS score, bool_and(ok) AS verified FROM t""")
def e_cross_language(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that are nearer to each other than to a distractor."""
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("translation"))
    c = e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("distractor"))
    triples = e.select("vec_id", F.col("embedding").alias("anchor")).join(b, "vec_id").join(c, "vec_id")
    return evaluation.cross_language(triples).withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv, label AS ql FROM e WHERE vec_id % 100 = 0),
truth AS (SELECT query_id, vec_id, ql, label FROM q, e WHERE vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(qv, v) DESC, CAST(vec_id AS VARCHAR)) <= 10)
SELECT CAST(query_id AS VARCHAR) AS query_id, round(count(*) FILTER (ql = label) / 10.0, 6) AS recall FROM truth GROUP BY 1""")
def e_overlap_recall(spark: SparkSession, d: str) -> DataFrame:
    """The share of the ten nearest vectors that a search within the same label finds."""
    rows = _vector_rows(spark, d).select("row_id", F.col("row_id").alias("source_id"), "embedding", F.col("source_id").alias("label"))
    asked = rows.where(F.col("row_id").cast("long") % 100 == 0).select(F.col("row_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("row_id").alias("exclude_source_id"))
    truth = semantic.search_many(rows, asked, 10).select("query_id", F.col("row_id").alias("id"))
    labels = rows.select("row_id", "label")
    same = truth.join(labels.toDF("query_id", "ql"), "query_id").join(labels.toDF("id", "label"), "id").where("ql = label").select("query_id", "id")
    return evaluation.overlap_recall(same, truth, 10).select("query_id", F.round("recall", 6).alias("recall"))

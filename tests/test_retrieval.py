import math

import pytest
from pyspark.sql import functions as F

from inkwell.operators import connections, evaluation, exact, fusion, indexing, lexical, mutations, semantic
from inkwell.operators.filters import RowFilter, predicate
from inkwell.plans.search import SearchService

S = "source_id string, path_raw string, path_norm string, filename_raw string, folder_raw string, folder_norm string, extension string, title_raw string, aliases array<string>, tags array<string>, links array<string>, languages array<string>, mtime_ms long"
C = "row_id string, source_id string, chunk_ordinal int, text_raw string, lexical_terms array<string>, lexical_ngrams array<string>, identifier_terms array<string>, title_terms array<string>, alias_terms array<string>, heading_terms array<string>, tag_terms array<string>, path_terms array<string>, line_start int, line_end int, char_start int, char_end int, heading_path array<string>, language_codes array<string>, embedding array<float>, folder_norm string, path_norm string, extension string, tags array<string>, mtime_ms long"


@pytest.fixture(scope="module")
def vault(spark):
    def source(i, folder, title, tags=(), links=()):
        path = f"{folder}/{title}.md"
        return (i, path, path.lower(), f"{title}.md", folder, folder.lower(), "md", title, [f"alias {i}"], list(tags), list(links), ["en"], 500)

    def chunk(r, s, n, text, vec, folder="notes", tags=()):
        words = text.lower().split()
        return (r, s, n, text, words, [], [], [s], [], [], [t.lower() for t in tags], [folder, "x.md", f"{folder}/x.md"], 0, 3, 0, len(text), ["H"], ["en"], vec, folder, f"{folder}/x", "md", list(tags), 500)

    sources = spark.createDataFrame([source("s1", "notes", "Vector Database", ["AI/ML"], ["Misc", "Gone"]), source("s2", "notes", "Storage", ["ai/ml"], ["notes/Vector Database.md#x"]), source("s3", "other", "Misc", ["cooking"]), source("s3", "other", "Misc", ["cooking"])], S)
    chunks = spark.createDataFrame(
        [chunk("r1", "s1", 0, "vector database design with embeddings", [1.0, 0.0, 0.0]), chunk("r2", "s1", 1, "vector notes\nsecond Vector line", [0.9, 0.2, 0.0]), chunk("r3", "s2", 0, "storage of vector data", [0.8, 0.3, 0.0]), chunk("r4", "s3", 0, "unrelated content about cooking", [0.0, 1.0, 0.0], "other"), chunk("r5", "s3", 1, "no vector at all", None, "other"), chunk("r1", "s1", 0, "vector database design with embeddings", [1.0, 0.0, 0.0])],
        C,
    )
    return sources, chunks


@pytest.mark.parametrize(
    ("f", "hit"),
    [
        (RowFilter(folders=("Projects",)), True), (RowFilter(folders=("projects/ai/",)), True), (RowFilter(tags=("ai",)), True), (RowFilter(tags=("#ai/ml",)), True), (RowFilter(path_contains=("AI/note",)), True), (RowFilter(mtime_after=400), True), (None, True), (RowFilter(source_ids=("s",)), True),
        (RowFilter(folders=("other",)), False), (RowFilter(tags=("ml",)), False), (RowFilter(extensions=("txt",)), False), (RowFilter(mtime_before=400), False), (RowFilter(mtime_before=500), False), (RowFilter(mtime_after=500), False), (RowFilter(exclude_source_ids=("s",)), False), (RowFilter(folders=("",)), False), (RowFilter(tags=("ai", "nope")), False), (RowFilter(source_ids=()), False),
    ],
)
def test_filters(spark, f, hit):
    df = spark.createDataFrame([("s", "projects/ai", "projects/ai/note.md", ["AI/ML"], "md", 500)], "source_id string, folder_norm string, path_norm string, tags array<string>, extension string, mtime_ms long")
    assert df.where(predicate(f)).count() == int(hit)


def test_bm25(spark):
    rows = [("d1", ["vector", "database", "vector"]), ("d2", ["vector", "notes"]), ("d3", ["unrelated", "content"]), ("d4", [])]
    terms = {c: "array()" for c in ("title_terms", "alias_terms", "heading_terms", "tag_terms", "path_terms", "identifier_terms", "lexical_ngrams")}
    df = spark.createDataFrame(rows, "row_id string, lexical_terms array<string>").selectExpr("*", *[f"cast({v} as array<string>) {k}" for k, v in terms.items()])
    post, stats = lexical.build_postings(df), lexical.field_statistics(df)
    got = {r["row_id"]: r for r in lexical.bm25(post, stats, lexical.query_terms(spark, ["vector", "vector"])).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert set(got) == {"d1", "d2"} and got["d1"]["score"] > got["d2"]["score"]
    assert abs(got["d2"]["score"] - idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / (7 / 3)))) < 1e-9
    notes = lexical.bm25(post, stats, lexical.query_terms(spark, ["notes"])).first()
    assert notes["score"] > got["d2"]["score"] and list(notes["matched_fields"]) == ["body"]
    assert lexical.bm25(post, stats, lexical.query_terms(spark, [])).count() == 0


def test_lexical_search_excludes_and_filters(spark, vault):
    _, chunks = vault
    post, stats = lexical.build_postings(chunks), lexical.field_statistics(chunks)
    want = lexical.query_terms(spark, ["vector"])
    assert [r["row_id"] for r in lexical.search(chunks, post, stats, want, excluded=["design"], row_filter=RowFilter(folders=("notes",))).collect()] in (["r2", "r3"], ["r3", "r2"])
    assert lexical.search(chunks, post, stats, want, limit=1).count() == 1


def test_vector_search(spark, vault):
    _, chunks = vault
    got = semantic.search(chunks, [1.0, 0.0, 0.0], 2).collect()
    assert [(r["row_id"], r["rank"]) for r in got] == [("r1", 1), ("r2", 2)] and abs(got[0]["raw_value"]) < 1e-9 and abs(got[0]["rank_score"] - 1) < 1e-9
    assert semantic.search(chunks, [0.0, 1.0, 0.0], 1, "l2").first()["row_id"] == "r4"
    assert semantic.search(chunks, [1.0], 5).count() == 0 and semantic.search(chunks, [], 5).count() == 0
    q = spark.createDataFrame([("q1", [1.0, 0.0, 0.0], "s1"), ("q2", [0.0, 1.0, 0.0], None)], "query_id string, vector array<double>, exclude_source_id string")
    many = {(r["query_id"], r["rank"]): r["row_id"] for r in semantic.search_many(chunks, q, 2).collect()}
    assert many["q1", 1] == "r3" and many["q2", 1] == "r4"


def test_many_queries_and_phrases_are_worked_off_in_blocks(spark, vault, monkeypatch):
    sources, chunks = vault
    q = spark.createDataFrame([(f"q{i}", [1.0, float(i), 0.0], None) for i in range(5)], "query_id string, vector array<double>, exclude_source_id string")
    needles = [exact.Needle(p) for p in ("vector", "storage", "cooking", "misc", "second")]
    many, found = (sorted(map(str, x.collect())) for x in (semantic.search_many(chunks, q, 2), exact.hits(sources, chunks, needles)))
    monkeypatch.setattr(semantic, "MAX_QUERIES", 2)
    monkeypatch.setattr(exact, "MAX_NEEDLES", 2)
    assert len(many) == 10 and sorted(map(str, semantic.search_many(chunks, q, 2).collect())) == many
    assert {p for p in ("cooking", "second") if any(p in x for x in found)} == {"cooking", "second"}
    assert sorted(map(str, exact.hits(sources, chunks, needles).collect())) == found
    assert semantic.search_many(chunks, q.limit(0), 2).count() == 0


def test_fusion(spark):
    exact = spark.createDataFrame([("r1", "s1", 1, "text", "p", 0, 0, 1)], "row_id string, source_id string, rank int, field string, phrase string, offset int, line int, match_length int")
    ranks = lambda *ids: spark.createDataFrame([(r, "s1", i + 1, ["body"], ["t"]) for i, r in enumerate(ids)], "row_id string, source_id string, rank int, matched_fields array<string>, matched_terms array<string>")
    fused = fusion.fuse(exact, ranks("r1", "r2"), ranks("r2", "r1"))
    got = {r["key"]: r["score"] for r in fused.collect()}
    assert abs(got["r1"] - (1.4 / 61 + 1 / 61 + 1 / 62)) < 1e-12 and abs(got["r2"] - (1 / 62 + 1 / 61)) < 1e-12
    two = fusion.fuse(None, ranks("a", "b"), None)
    assert abs(fusion.by_source(two, "max").first()["score"] - 1 / 61) < 1e-12 and abs(fusion.by_source(two, "top_mean").first()["score"] - (1 / 61 + 1 / 62) / 2) < 1e-12
    assert fusion.by_source(two).first()["block_count"] == 2 and fusion.diversify(fused, 1).count() == 1


def test_search_service(spark, vault):
    sources, chunks = vault
    service = SearchService(sources, chunks, embed=semantic_stub)
    hit = service.search('"vector line"').results.collect()
    assert hit[0]["row_id"] == "r2" and hit[0]["snippet"][hit[0]["highlight_start"] : hit[0]["highlight_end"]] == "Vector line"
    assert {x["kind"] for x in hit[0]["reasons"]} >= {"exact_phrase", "lexical", "hybrid"}
    r = service.search("vector -design")
    assert r.plan.label == "hybrid" and "r1" not in {x["row_id"] for x in r.results.collect()}
    by_source = service.search("vector", result_type="sources").results.collect()
    assert by_source[0]["source_id"] == "s1" and by_source[0]["block_count"] == 2 and len({x["source_id"] for x in by_source}) == len(by_source)
    assert [x["source_id"] for x in service.search("folder:other").results.collect()] == ["s3"]
    assert SearchService(sources, chunks).search("semantic:vector").degraded == ("semantic_unavailable",)
    assert service.search("").results.count() == 0
    assert service.search("title:misc").results.first()["id"] == "source:s3"
    asked = []
    from inkwell.plans.search import Profile

    SearchService(sources, chunks, embed=lambda t: asked.append(t) or [1.0, 0.0, 0.0], profile=Profile(query_template="q: {{content}} {{title}}")).search('semantic:data "vector line"')
    assert asked == ["q: vector line data "]
    assert SearchService(sources, chunks).search("semantic:storage").results.first()["source_id"] == "s2"  # words become terms, no needles
    empty = SearchService(sources.limit(0), chunks.limit(0), embed=semantic_stub)
    assert empty.search("vector").results.count() == 0


def test_saved_index(spark, vault, tmp_path):
    from inkwell.plans.search import open_index, save_index
    from inkwell.sources.vault import ArtifactStore

    store = ArtifactStore(spark, f"file://{tmp_path}", "main", "f")
    with pytest.raises(LookupError):
        open_index(store)
    save_index(store, *vault)
    keys = lambda s: [(r["id"], round(r["score"], 9)) for r in s.search("vector data -design").results.orderBy("rank").collect()]
    assert keys(open_index(store)) == keys(SearchService(*vault)) != []


@pytest.mark.parametrize(("raw", "kind", "method"), [('"vector line" data -design', "blocks", "max"), ("hybrid: vector storage", "sources", "top_mean"), ("folder:other", "blocks", "max"), ("", "blocks", "max")])
def test_eager_search_finds_the_same(vault, raw, kind, method):
    from inkwell.plans.search import Profile

    service = SearchService(*vault, embed=semantic_stub, profile=Profile(max_per_source=1, aggregation=method))
    lazy, eager = service.search(raw, result_type=kind), service.search_now(raw, result_type=kind)
    assert sorted(map(str, eager.results.collect())) == sorted(map(str, lazy.results.collect())) and eager.degraded == lazy.degraded


def semantic_stub(_):
    return [1.0, 0.0, 0.0]


def test_connections(spark, vault):
    sources, chunks = vault
    got = {r["source_id"]: r for r in connections.for_source(sources, chunks, "s1").items.collect()}
    kinds = {k: {e["kind"] for e in r["edges"]} for k, r in got.items()}
    assert kinds == {"s2": {"semantic", "backlink", "shared_tag"}, "s3": {"wikilink", "semantic"}} or kinds == {"s2": {"semantic", "backlink", "shared_tag"}, "s3": {"wikilink"}}
    assert got["s2"]["rank"] == 1 and got["s2"]["evidence_row_id"] == "r3"
    fb = spark.createDataFrame([("s3", True, False), ("s2", False, True)], "source_id string, pinned boolean, hidden boolean")
    assert [(r["source_id"], r["pinned"]) for r in connections.for_source(sources, chunks, "s1", feedback=fb).items.collect()] == [("s3", True)]
    assert {tuple(r) for r in connections.link_graph(sources).collect()} == {("s1", "s3"), ("s2", "s1")}
    cut, was = connections.truncate_selection("word " * 5000)
    assert was and cut and connections.truncate_selection("a b") == ("a b", False)


def test_connection_modes(spark, vault):
    sources, chunks = vault
    assert connections.for_source(sources, chunks, "s1").mode == "semantic"
    bare = connections.for_source(sources.withColumn("headings", F.array(F.lit("vector storage"))), chunks.withColumn("embedding", F.lit(None).cast("array<float>")), "s1")
    got = {r["source_id"]: {e["kind"]: e["score"] for e in r["edges"]} for r in bare.items.collect()}
    assert bare.mode == "lexical_fallback" and got["s2"]["lexical"] == 0.6 and "s1" not in got and "wikilink" in got["s3"]
    dumb = connections.for_source(sources.withColumn("title_raw", F.lit("!!")), chunks.withColumn("embedding", F.lit(None).cast("array<float>")), "s1")
    assert dumb.mode == "links_only" and all(e["kind"] in ("wikilink", "backlink", "shared_tag") for r in dumb.items.collect() for e in r["edges"])
    gone = connections.for_source(sources, chunks, "nobody")
    assert gone.mode == "links_only" and gone.items.count() == 0


def test_connections_of_a_selection(spark, vault):
    sources, chunks = vault
    asked = []

    def embed(t):
        asked.append(t)
        return [1.0, 0.0, 0.0]

    found = connections.for_selection(sources, chunks, "vector things", "s1", embed=embed, template="query: {{content}}")
    assert (found.mode, found.truncated, asked) == ("semantic", False, ["query: vector things"])
    rows = found.items.collect()
    assert [r["source_id"] for r in rows] == ["s2"] and {e["kind"] for r in rows for e in r["edges"]} == {"semantic"}
    words = connections.for_selection(sources, chunks, "cooking " * 3000, embed=lambda t: None)
    assert words.mode == "lexical_fallback" and words.truncated and [(r["source_id"], r["score"]) for r in words.items.collect()] == [("s3", 0.6)]
    assert connections.for_selection(sources, chunks, "!!").items.count() == 0


def test_evaluation(spark):
    results = spark.createDataFrame([("q1", 1, "z"), ("q1", 2, "x")], "query_id string, rank int, target_id string")
    expected = spark.createDataFrame([("q1", "x", "g"), ("q2", "y", "g")], "query_id string, target_id string, group string")
    r = evaluation.quality(results, expected, 5).first()
    assert (r["recall"], r["mrr"], r["zero_rate"]) == (0.5, 0.25, 0.5)
    recalls = spark.createDataFrame([(str(i), 1.0) for i in range(600)], "query_id string, recall double")
    ms = spark.createDataFrame([("flat", 60.0), ("ann", 20.0)], "kind string, ms double")
    assert evaluation.ann_gate(recalls, ms).first()["passed"] and not evaluation.ann_gate(recalls.limit(10), ms).first()["passed"]
    values = spark.createDataFrame([(float(i),) for i in range(20)], "v double")
    assert values.agg(evaluation.percentile(F.col("v"), 0.95).alias("p")).first()["p"] == 19.0
    t = spark.createDataFrame([([1.0, 0.0], [1.0, 0.1], [0.0, 1.0]), ([1.0, 0.0], [0.0, 1.0], [1.0, 0.0])], "anchor array<double>, translation array<double>, distractor array<double>")
    assert tuple(evaluation.cross_language(t).first()) == (2, 1, 0.5, False)


def test_index_build_and_mutations(spark):
    files = spark.createDataFrame([("a/One.md", "# One\nSome text with snake_case.\n\n## Two\n検索エンジン", 1, 2, 3), ("b.txt", None, 1, 2, 0)], "path string, content string, ctime_ms long, mtime_ms long, size_bytes long")
    recipe = indexing.Recipe(frontmatter_fields=("title",))
    notes = indexing.extract_notes(files, recipe)
    src, rows = indexing.source_rows(notes, recipe), indexing.chunk_rows(notes, recipe)
    got = rows.orderBy("chunk_ordinal").collect()
    assert len(got) >= 1 and len(got[0]["row_id"]) == 32 and "snake_case" in got[0]["identifier_terms"] and "検索" in [x for r in got for x in r["lexical_ngrams"]]
    assert {r["row_id"] for r in rows.collect()} == {r["row_id"] for r in indexing.chunk_rows(indexing.extract_notes(files, recipe), recipe).collect()}
    done = semantic.embed_column(rows, lambda: semantic.hash_embedder(8))
    with_vectors = semantic.attach(rows, done)
    assert with_vectors.where("size(embedding) = 8").count() == len(got)
    assert semantic.carry_over(rows, with_vectors).where("embedding is not null").count() == len(got)
    manifest = spark.createDataFrame([], "artifact_id string, source_id string, seen_revision int, indexed_revision int, status string, last_error_code string, last_error_message string, retry_count int, last_attempt_ms long, updated_ms long")
    s1, c1, m1 = mutations.commit_sources(src.limit(0), rows.limit(0), manifest, src, rows, "main")
    assert s1.count() == 2 and c1.count() == len(got) and {r["status"] for r in m1.collect()} == {"indexed"}
    assert mutations.commit_sources(s1, c1, m1, src, rows.limit(0), "main")[1].count() == len(got)  # the same revision again changes nothing
    m2 = mutations.mark_seen(m1, s1.select("source_id", F.lit(5).alias("revision")), "main")
    assert {(r["status"], r["seen_revision"], r["indexed_revision"]) for r in m2.collect()} == {("pending", 5, 1)}
    m3 = mutations.mark_failed(m2, s1.select("source_id", F.lit(4).alias("revision"), F.lit("E").alias("code"), F.lit("m").alias("message")), "main")
    assert {(r["status"], r["seen_revision"], r["retry_count"]) for r in m3.collect()} == {("failed", 5, 1)}
    one = s1.where("path_raw = 'a/One.md'").select("source_id")
    s4, c4 = mutations.rename_sources(s1, c1, one.withColumn("new_path", F.lit("C/New.md")))
    assert {r["path_raw"] for r in s4.collect()} == {"C/New.md", "b.txt"} and s4.where("source_revision = 2").count() == 1 and c4.where("array_contains(path_terms, 'new')").count() == len(got)
    s5, c5, m5 = mutations.delete_sources(s4, c4, m3, one)
    assert (s5.count(), c5.count(), m5.count()) == (1, 0, 1)
    diff = indexing.scan_diff(spark.createDataFrame([("a/One.md", "x", 1, 1), ("n", "h", 1, 1)], "path string, raw_content_hash string, mtime_ms long, size_bytes long"), s1)
    assert {r["path"]: r["outcome"] for r in diff.collect()} == {"a/One.md": "changed", "n": "added", "b.txt": "removed"}


def test_scope(spark):
    paths = ["a/x.md", "a/b/y.txt", "c/z.md", "d.pdf", "noext", "a.c/w.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    of = lambda **k: {r[0] for r in df.where(indexing.in_scope("path", **k)).collect()}
    assert of() == {"a/x.md", "a/b/y.txt", "c/z.md", "a.c/w.md"} and of(include=("a",)) == {"a/x.md", "a/b/y.txt"} and of(exclude=("a/*",)) == {"c/z.md", "a.c/w.md"} and of(include=("a",), exclude=("a/b",), extensions=("md",)) == {"a/x.md"}


def test_embedding_failures():
    limits = semantic.Batching(items=4, attempts=3, base_delay=0)
    calls = []

    def picky(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise semantic.status_error(413)
        return [[1.0]] * len(texts)

    assert semantic.embed_batch(picky, ["a", "bad", "b", "c"], limits) == [([1.0], None), (None, "input"), ([1.0], None), ([1.0], None)]
    tries = []

    def flaky(texts):
        tries.append(1)
        if len(tries) < 3:
            raise semantic.status_error(429, "0")
        return [[1.0]] * len(texts)

    assert semantic.embed_batch(flaky, ["a"], limits, lambda s: None) == [([1.0], None)]
    assert semantic.embed_batch(lambda t: [], ["a"], limits) == [(None, "response")]
    assert semantic.plan_batches(["a"] * 10, [1] * 10, limits) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]] and semantic.plan_batches([], [], limits) == []

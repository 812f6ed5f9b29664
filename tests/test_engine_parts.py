import json

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text, vectors
from inkwell.operators import evaluation, mutations, semantic
from inkwell.plans import profiles as pf
from inkwell.plans.errors import EngineError, SafeError, to_safe
from inkwell.plans.lifecycle import Lifecycle
from inkwell.sources import embedding_http as eh
from inkwell.sources import readers, reports
from inkwell.sources.feedback import FeedbackStore
from inkwell.sources.vault import ArtifactStore
from inkwell.streaming import coalescer as co


def _service(**answers):
    def transport(url, body, headers, timeout):
        path = url.split("/v1")[-1] if "/v1" in url else url
        if path != "/embeddings":
            return (200, None, b"{}") if path in answers.get("known", ()) else (404, None, b"")
        texts = json.loads(body)["input"]
        return answers["reply"](texts)

    return transport


def _reply(vector=(0.6, 0.8), model="m-1", order=1, **more):
    def reply(texts):
        rows = [{"index": i, "embedding": [x + i for x in vector] if not more.get("same") else list(vector)} for i in range(len(texts))][::order]
        return 200, None, json.dumps({"data": rows, "model": model}).encode()

    return reply


def test_http_embedder_orders_and_checks():
    make = lambda reply, **k: eh.HttpEmbedder("http://localhost:1/v1", "m", transport=_service(reply=reply), **k)
    assert make(_reply((1.0, 2.0), order=-1))(["a", "b"]) == [[1.0, 2.0], [2.0, 3.0]]
    for reply, why in ((_reply(model="other"), "model"), (lambda t: (200, None, b"no"), "response"), (lambda t: (200, None, b'{"data": []}'), "response"), (_reply((1.0, float("nan"))), "response"), (lambda t: (429, "2", b""), "rate_limit"), (lambda t: (403, None, b""), "auth"), (lambda t: (503, None, b""), "provider")):
        with pytest.raises(semantic.EmbedError) as e:
            make(reply)(["a"])
        assert e.value.category == why and e.value.retryable == (why in ("rate_limit", "provider"))
    for texts in ([], [""], ["x" * 40_000], ["x"] * 600):
        with pytest.raises(semantic.EmbedError, match="input"):
            make(_reply())(texts)
    with pytest.raises(semantic.EmbedError, match="response"):
        make(_reply(), dimension=3)(["a"])

    def broken(texts):
        raise TimeoutError

    with pytest.raises(semantic.EmbedError, match="timeout"):
        make(broken)(["a"])


def test_strict_embedder():
    make = lambda reply: eh.HttpEmbedder("http://127.0.0.1:1/v1", "m-1", 2, "key", strict=True, transport=_service(reply=reply))
    assert make(_reply(same=True))(["a"]) == [[0.6, 0.8]]
    with pytest.raises(semantic.EmbedError, match="model"):
        make(_reply(model="m-12"))(["a"])
    with pytest.raises(semantic.EmbedError, match="input"):
        make(_reply())(["a"] * 129)
    for bad in (dict(base="http://far.invalid/v1", model="m", dimension=2, key="k", strict=True), dict(base="https://x.invalid/v2"), dict(base="https://u:p@x.invalid/v1"), dict(base="https://x.invalid/v1", strict=True)):
        with pytest.raises(ValueError):
            eh.HttpEmbedder(**bad)


def test_probe():
    make = lambda reply, **k: eh.HttpEmbedder("http://localhost:1/v1", transport=_service(reply=reply, known=("/models", "http://localhost:1/health")), **k)
    got = eh.probe(make(_reply(same=True), health_path="/health"))
    assert got == eh.Probe(True, True, 2, "l2", "m-1", True, "ok")
    single = eh.probe(make(lambda t: _reply((3.0, 4.0))(t) if len(t) == 1 else (413, None, b"")))
    assert single == eh.Probe(True, False, 2, "none", "m-1", True, "unsupported")
    assert eh.probe(make(lambda t: (500, None, b""), health_path="/nope")) == eh.Probe(False, models_listed=True, health="unavailable", error="provider")


def test_safe_errors_tell_nothing():
    e = EngineError(SafeError("STORE_BROKEN", "storage", "error.store.broken", True))
    assert to_safe(e).code == "STORE_BROKEN" and str(e) == "error.store.broken"
    assert to_safe(ValueError("/home/me/secret")) == SafeError("INTERNAL_FAILURE") and to_safe(TimeoutError()).retryable
    for bad in (dict(code="x"), dict(code="OK_CODE", category="odd"), dict(code="OK_CODE", message_key="No key"), dict(code="OK_CODE", operation_id="a b"), dict(code="OK_CODE", retry_after=-1)):
        with pytest.raises(ValueError):
            SafeError(**bad)


def test_lifecycle_closes_all_in_reverse():
    done = []
    life = Lifecycle()
    life.add("a", lambda: done.append("a"))
    life.add("b", lambda: 1 / 0)
    undo = life.add("c", lambda: done.append("c"))
    life.add("d", lambda: done.append("d"))
    undo()
    assert [(n, e.code) for n, e in life.close()] == [("b", "CLEANUP_FAILURE")] and done == ["d", "a"] and life.close() == []
    life.add("late", lambda: done.append("late"))
    assert done[-1] == "late"


def test_feedback_store(spark, tmp_path):
    path = f"{tmp_path}/feedback.json"
    store = FeedbackStore(path)
    store.mark("a", pinned=True)
    store.mark("b", hidden=True)
    store.mark("a", hidden=True, pinned=False)
    again = FeedbackStore(path)
    assert (again.pinned, again.hidden, again.was_reset) == (set(), {"a", "b"}, False)
    assert {tuple(r) for r in again.table(spark).collect()} == {("a", False, True), ("b", False, True)}
    for broken in ("{", '{"version": 2, "pinned": [], "hidden": []}', "[]", '{"version": 1, "pinned": [1], "hidden": []}'):
        (tmp_path / "feedback.json").write_text(broken)
        lost = FeedbackStore(path)
        assert lost.was_reset and not lost.pinned | lost.hidden and lost.table(spark).count() == 0


def test_reports(tmp_path):
    record = {"model": "m", "secret": "s", "groups": [{"name": "g", "path": "/p"}], "docs": [1, 2, 3], "deep": {"a": 1, "b": 2}}
    safe = reports.project(record, {"model": True, "groups": {"name": True}, "docs": len, "deep": {"a": True}, "absent": True})
    assert safe == {"model": "m", "groups": [{"name": "g"}], "docs": 3, "deep": {"a": 1}}
    paths = reports.write(f"{tmp_path}/out", "gate", safe, [("recall", True, ""), ("p95 <ms>", False, 'was "9" | 5')])
    assert json.load(open(paths["json"])) == safe and 'failures="1"' in open(paths["xml"]).read() and "\\|" in open(paths["md"]).read()
    with pytest.raises(ValueError):
        reports.canonical_json({"x": float("nan")})


def test_readers(spark):
    chunks = spark.createDataFrame([("r2", "s", 1), ("r1", "s", 0), ("r1", "s", 0), ("r3", "t", 0)], "row_id string, source_id string, chunk_ordinal int")
    sources = spark.createDataFrame([("s", "b.md"), ("t", "a.md"), ("t", "a.md"), (None, "x")], "source_id string, path_raw string")
    manifest = spark.createDataFrame([("act", "s", 1, 0, "pending", 0, 1), ("act", "s", 1, 1, "indexed", 0, 2), ("act", "t", 1, 0, "failed", 1, 1), ("old", "t", 1, 1, "indexed", 0, 1)], "artifact_id string, source_id string, seen_revision int, indexed_revision int, status string, retry_count int, updated_ms long")
    assert [r["row_id"] for r in readers.chunks_of(chunks, "s").collect()] == ["r1", "r2"] and readers.chunk(chunks, "r1").count() == 1 and readers.chunk(chunks, "no").count() == 0
    assert [r["source_id"] for r in readers.list_sources(sources).collect()] == ["t", "s"] and readers.source_by_path(sources, "a.md").first()["source_id"] == "t" and readers.source(sources, "s").first()["path_raw"] == "b.md"
    assert readers.manifest_of(manifest, "act", "s").first()["status"] == "indexed"
    assert [(r["source_id"], r["status"]) for r in readers.list_manifest(manifest, "act").collect()] == [("s", "indexed"), ("t", "failed")] and [r["source_id"] for r in readers.list_manifest(manifest, "act", "failed").collect()] == ["t"]
    assert readers.list_manifest(manifest, "act", "pending").count() == 0


def _registry(**k):
    base = dict(retrievals=(pf.RetrievalProfile("r", "act"),), active="r", artifacts=(pf.Artifact("act", "c2", "l", "e"),), corpora=(pf.CorpusProfile("c1"), pf.CorpusProfile("c2", chunk_tokens=64)), lexicals=(pf.LexicalProfile("l"),), recipes=(pf.EmbeddingRecipe("e", "p"),), providers=(pf.ProviderProfile("p", "http://localhost:1/v1"),))
    return pf.Registry(**(base | k))


def test_profiles():
    c = _registry().check().configuration()
    assert (c.corpus.id, c.recipe.id, c.provider.id, c.artifact.id) == ("c2", "e", "p", "act")
    bare = _registry(retrievals=(pf.RetrievalProfile("r"),), artifacts=(), recipes=(pf.EmbeddingRecipe("e"),)).check().configuration()
    assert (bare.corpus.id, bare.artifact, bare.provider) == ("c1", None, None)
    for bad in (dict(active="x"), dict(artifacts=(pf.Artifact("act", "gone", "l", "e"),)), dict(recipes=(pf.EmbeddingRecipe("e", "gone"),)), dict(corpora=(pf.CorpusProfile("c2"), pf.CorpusProfile("c2"))), dict(retrievals=(pf.RetrievalProfile("r", "act", limit=0),)), dict(lexicals=(pf.LexicalProfile("l", ngram_min=4, ngram_max=3),)), dict(providers=(pf.ProviderProfile("p", "ftp://x/v1"),)), dict(corpora=(pf.CorpusProfile("c2", strategy="odd"),))):
        with pytest.raises(ValueError):
            _registry(**bad).check()


def test_fingerprints_cover_rows_alone():
    e = pf.EmbeddingRecipe("e", "p", "m", 8)
    assert pf.fingerprint(e) == pf.fingerprint(pf.EmbeddingRecipe("other", "q", "m", 8, query_template="x")) != pf.fingerprint(pf.EmbeddingRecipe("e", "p", "m", 8, document_template="x"))
    assert e.space() == pf.EmbeddingRecipe("e", "p", "m", 8, document_template="x").space() != pf.EmbeddingRecipe("e", "p", "m", 9).space()
    assert pf.fingerprint(pf.CorpusProfile("a", frontmatter_fields=("x", "y"))) == pf.fingerprint(pf.CorpusProfile("b", frontmatter_fields=("y", "x"), includes=("f",)))


def test_swap():
    done = []
    go = lambda a, b: pf.swap(a, b, lambda c: done.append("rebuild"), lambda c: done.append("apply"))
    one = _registry().configuration()
    assert go(one, one) == "unchanged" and done == []
    assert go(one, _registry(retrievals=(pf.RetrievalProfile("r", "act", limit=5),)).configuration()) == "applied"
    assert go(one, _registry(lexicals=(pf.LexicalProfile("l", nfkc=False),)).configuration()) == "rebuilt" and done == ["apply", "rebuild"]


def test_optimize_and_rebuild(spark, tmp_path):
    store = ArtifactStore(spark, f"file://{tmp_path}", "main", "f")
    with pytest.raises(LookupError):
        mutations.optimize(store)
    store.save(chunks=spark.range(100).selectExpr("cast(99 - id as string) as row_id"))
    assert store.times()[0] and store.times()[1] is None
    assert mutations.optimize(store, chunks="row_id") == 2 and store.times()[1] and store.load()[1]["chunks"].count() == 100
    assert store.save(chunks=spark.range(1)) == 3 and store.times()[1]
    assert mutations.rebuild_all(store, lambda files: {"chunks": files}, spark.range(7)) == 1 and store.load()[1]["chunks"].count() == 7


def test_embedding_last_input_remainder_and_jitter(spark):
    df = spark.createDataFrame([("a", "h1", "old", 1), ("a", "h2", "new", 2), ("b", "h3", "x", 1), ("b", "h3", "x", 1)], "row_id string, embedding_input_hash string, embedding_input string, updated_ms long")
    done = semantic.embed_column(df, lambda: semantic.hash_embedder(4), order="updated_ms")
    assert {(r["row_id"], r["embedding_input_hash"]) for r in done.collect()} == {("a", "h2"), ("b", "h3")}
    none = semantic.embed_column(df, lambda: semantic.hash_embedder(4), order="updated_ms", cancelled=lambda: True)
    assert none.count() == 0 and {r["row_id"] for r in semantic.remainder(df, none).collect()} == {"a", "b"} and {tuple(r) for r in semantic.remainder(df, done).collect()} == {("a", "h1")}
    slept = []

    def busy(texts):
        raise semantic.status_error(503)

    semantic.embed_batch(busy, ["a"], semantic.Batching(attempts=3, base_delay=1), slept.append, lambda: 0.5)
    assert slept == [0.75, 1.5]
    assert semantic.no_rerank("q", df) is df


def test_base64(spark):
    import base64

    import numpy as np

    enc = lambda *x: base64.b64encode(np.array(x, "<f4").tobytes()).decode()
    df = spark.createDataFrame([(1, enc(1, 2)), (2, None), (3, "!!"), (4, ""), (5, "AAA="), (6, enc(3))], "id int, v string")
    got = {r["id"]: r["e"] for r in df.select("id", vectors.decode_base64("v").alias("e")).collect()}
    assert got == {1: [1.0, 2.0], 2: None, 3: None, 4: None, 5: None, 6: [3.0]}
    assert df.where("id = 1").select(vectors.encode_base64(vectors.decode_base64("v")).alias("e")).first()["e"] == enc(1, 2)


def test_percentiles_without_arrays(spark):
    rows = [("a", float(i % 37)) for i in range(500)] + [("b", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for p in (0.0, 0.5, 0.95, 1.0):
        want = {}
        for g in ("a", "b"):
            own = sorted(v for x, v in rows if x == g)
            want[g] = own[min(len(own) - 1, int(len(own) * p))]
        assert {r["g"]: r["v"] for r in evaluation.percentiles(df, "g", "v", p).collect()} == want
    assert evaluation.percentiles(df.limit(0), "g", "v", 0.5).count() == 0


def test_fixtures(spark):
    a, b = (evaluation.unit_vectors(spark, 50, 8).collect() for _ in range(2))
    assert a == b and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-5 for r in a) and len({tuple(r["vector"]) for r in a}) == 50
    assert evaluation.full_width("Ab 1") == "Ａｂ　１"
    df = text.with_analysis(spark.createDataFrame([("Old snake_case",)], "t string"), "t", "a")
    assert df.select(text.join_terms("a").alias("j")).first()["j"].startswith("old snake_case snake_case snake case")


def test_unsettled_chains_are_an_error(spark):
    events = spark.createDataFrame([(i, "rename", f"p{i + 1}", f"p{i}") for i in range(20)], "seq long, kind string, path string, old_path string")
    with pytest.raises(RuntimeError, match="settled"):
        co.chains(events, rounds=1)
    assert {r["chain"] for r in co.chains(events).collect()} == {"p0"}


def test_debounce_and_runner(spark, tmp_path):
    import time

    schema = "seq long, kind string, path string, old_path string"
    put = lambda n, *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{tmp_path}/events/{n}")
    put(1, (1, "modify", "a", None))
    got = []

    def start():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/events")
        return co.debounce(stream, 3000).writeStream.foreachBatch(lambda df, n: got.append([tuple(r) for r in df.collect()])).option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(processingTime="200 milliseconds").start()

    runner = co.Runner(start)
    assert runner.progress() == {"running": False, "batch": None, "rows": None}
    runner.resume()
    runner.resume()
    try:
        put(2, (2, "rename", "b", "a"), (2, "rename", "b", "a"))
        end = time.time() + 60
        while not any(got) and time.time() < end:
            time.sleep(0.2)
        assert runner.running and [x for x in got if x] == [[(1, "modify", "a", None), (2, "rename", "b", "a")]] and runner.progress()["batch"] is not None
        runner.pause()
        assert not runner.running
        put(3, (3, "delete", "b", None))
        runner.resume()
        while len([x for x in got if x]) < 2 and time.time() < end + 60:
            time.sleep(0.2)
        assert [x for x in got if x][1] == [(3, "delete", "b", None)]
    finally:
        runner.close()
    with pytest.raises(RuntimeError, match="closed"):
        runner.resume()
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_files(spark, tmp_path):
    from inkwell.sources.files import FolderFiles, MemoryFiles

    for files in (MemoryFiles(), FolderFiles(spark, f"file://{tmp_path}/artifact")):
        assert files.read("a.json") is None and files.names() == []
        files.write("a.json", "ü")
        files.write("a.json", "é")
        files.write("b", "")
        assert files.read("a.json") == "é" and files.read("b") == "" and files.names() == ["a.json", "b"]
        files.remove("b")
        files.remove("b")
        assert files.names() == ["a.json"]
        for bad in ("../x", "a/b", "", "..", ".hidden", "/etc/passwd", "a..b"):
            with pytest.raises(ValueError):
                files.write(bad, "x")


def test_long_source_lists_are_joined(spark):
    from inkwell.operators.filters import MAX_LITERALS, RowFilter, apply_filter

    df = spark.range(5000).select(F.concat(F.lit("s"), F.col("id")).alias("source_id"), F.lit("md").alias("extension"))
    many = tuple(f"s{i}" for i in range(MAX_LITERALS + 500))
    assert apply_filter(df, RowFilter(source_ids=many, extensions=("md",))).count() == len(many)
    assert apply_filter(df, RowFilter(exclude_source_ids=many)).count() == 5000 - len(many) and apply_filter(df, RowFilter(source_ids=many, exclude_source_ids=("s3",))).count() == len(many) - 1


def test_diagnostics_tell_no_names():
    told = json.dumps(pf.diagnostics(_registry(corpora=(pf.CorpusProfile("c1"), pf.CorpusProfile("c2", includes=("secret folder",)))).configuration(), {"sources": 3}, {"failed": 1, "odd": 2}))
    assert "secret" not in told and "localhost" not in told and json.loads(told)["endpoint"] == "local" and json.loads(told)["states"] == {"failed": 1}


def test_event_reader(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.json").write_text('{"seq": 1, "kind": "metadata-changed", "path": "a"}\n{"seq": 2, "kind": "Rename", "path": "b", "old_path": "a"}\n{"seq": 3, "kind": "odd", "path": "a"}\n{"seq": 4, "kind": "delete"}\n')
    got = []
    q = co.read_events(spark, f"{tmp_path}/log").writeStream.foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(got) == [(1, "modify", "a", None), (2, "rename", "b", "a")]

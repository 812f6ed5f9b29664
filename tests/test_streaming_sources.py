import json

import pytest

from inkwell.operators import indexing
from inkwell.plans import settings as st
from inkwell.sources.vault import ArtifactStore, read_vault
from inkwell.streaming import coalescer as co


@pytest.mark.parametrize(
    ("events", "tasks"),
    [
        ([("modify", "a", None)] * 3, [("upsert", "a", None, 3, True)]), ([("rename", "b", "a"), ("rename", "c", "b")], [("rename", "c", "a", 2, False)]), ([("modify", "a", None), ("rename", "b", "a")], [("rename", "b", "a", 2, True)]),
        ([("rename", "b", "a"), ("delete", "b", None)], [("delete", "a", None, 1, False)]), ([("delete", "a", None), ("create", "a", None)], [("upsert", "a", None, 2, True)]), ([("rename", "b", "a"), ("rename", "a", "b")], [("upsert", "a", None, 2, True)]), ([], []),
    ],
)
def test_fold(events, tasks):
    assert co.fold(events, {}) == tasks


def test_batch_equals_one_fold(spark):
    events = [(1, "modify", "a", None), (2, "rename", "b", "a"), (3, "create", "x", None), (4, "rename", "c", "b"), (5, "delete", "y", None), (6, "rename", "z", "x"), (7, "delete", "z", None), (3, "create", "x", None), (8, "odd", "q", None), (9, "modify", None, None)]
    df = spark.createDataFrame(events, "seq long, kind string, path string, old_path string")
    tasks, state = co.coalesce_batch(df, spark.createDataFrame([("a", 5), ("kept", 1)], "path string, generation long"))
    generations = {"a": 5, "kept": 1}
    want = co.fold([e[1:] for e in events[:7]], generations)
    assert sorted(map(tuple, tasks.collect())) == sorted(want)
    assert {r["path"]: r["generation"] for r in state.collect()} == generations
    assert co.coalesce_batch(df.limit(0), state)[0].count() == 0


def test_stream(spark, tmp_path):
    schema = "seq long, kind string, path string, old_path string"
    spark.createDataFrame([(1, "modify", "a", None), (2, "rename", "b", "a")], schema).coalesce(1).write.parquet(f"{tmp_path}/events/1")
    got = {}
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/events")
    q = co.stream_tasks(spark, stream, f"file://{tmp_path}/state", f"{tmp_path}/checkpoint", lambda df, n: got.update({n: [tuple(r) for r in df.collect()]}), "100 milliseconds")
    try:
        q.processAllAvailable()
        spark.createDataFrame([(3, "modify", "b", None)], schema).coalesce(1).write.parquet(f"{tmp_path}/events/2")
        q.processAllAvailable()
    finally:
        q.stop()
    assert got == {0: [("rename", "b", "a", 2, True)], 1: [("upsert", "b", None, 3, True)]}


def test_latest_tasks(spark):
    df = spark.createDataFrame([("a", "upsert", 1), ("a", "delete", 2), ("b", "upsert", 1)], "path string, kind string, generation long")
    assert {(r["path"], r["kind"]) for r in co.latest_tasks(df).collect()} == {("a", "delete"), ("b", "upsert")}


def test_vault_and_artifacts(spark, tmp_path):
    (tmp_path / "vault/sub").mkdir(parents=True)
    (tmp_path / "vault/One.md").write_text("# One\ntext")
    (tmp_path / "vault/sub/Two.txt").write_text("zwei")
    (tmp_path / "vault/sub/no.pdf").write_text("x")
    files = read_vault(spark, f"file://{tmp_path}/vault")
    assert {(r["path"], r["content"]) for r in files.collect()} == {("One.md", "# One\ntext"), ("sub/Two.txt", "zwei")}
    assert {r["path"] for r in read_vault(spark, f"{tmp_path}/vault", exclude=("sub",)).collect()} == {"One.md"}
    store = ArtifactStore(spark, f"file://{tmp_path}/index", "main", "f1")
    assert store.load()[0] == "empty"
    sources = indexing.source_rows(indexing.extract_notes(files))
    store.save(sources=sources)
    state, tables = store.load()
    assert state == "ready" and tables["sources"].count() == 2
    store.save(sources=tables["sources"].limit(1))
    assert store.load()[1]["sources"].count() == 1 and tables["sources"].count() == 2  # readers keep their version
    assert ArtifactStore(spark, f"file://{tmp_path}/index", "main", "f2").load()[0] == "rebuilt"
    store.prune(1)
    store.destroy()
    assert store.load()[0] == "empty"
    with pytest.raises(ValueError):
        ArtifactStore(spark, "x", "../up", "f")


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    store = st.SettingsStore(path)
    heard = []
    store.listeners.append(lambda s, rebuild: heard.append(rebuild))
    assert store.update(embedding=st.Embedding(endpoint="http://localhost:1/v1")) is False and store.update(corpus=st.Corpus(chunk_tokens=256)) is True and heard == [False, True]
    assert st.SettingsStore(path).current == store.current
    assert "localhost" not in json.dumps(store.current.diagnostics())
    (tmp_path / "s.json").write_text("{broken")
    assert st.SettingsStore(path).was_reset
    for bad in ({"corpus": {"chunk_tokens": 1}}, {"corpus": {"nope": 1}}, {"embedding": {"endpoint": "ftp://x"}}, {"lexical": {"ngram_min": 9}}):
        with pytest.raises(ValueError):
            st.parse_settings(bad)
    assert st.endpoint_class("https://a.invalid") == "remote_https" and st.endpoint_class("http://a.invalid") == "remote_plaintext"

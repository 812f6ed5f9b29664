import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import incremental, orphans
from inkwell.operators import intervals as iv


def _points(df):
    return {x for r in df.collect() for x in range(r["lo"], r["hi"] + 1)}


def _disjoint(df):
    rows = sorted((r["lo"], r["hi"]) for r in df.collect())
    return all(b < c for (_, b), (c, _) in zip(rows, rows[1:]))


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_operations_against_sets(spark, seed):
    rng = random.Random(seed)
    a = [rng.randint(0, 60) for _ in range(50)] + [None]
    b = [rng.randint(0, 60) for _ in range(30)]
    one = spark.createDataFrame([(x,) for x in a], "seq long")
    two = spark.createDataFrame([(x,) for x in b], "seq long")
    ia, ib = iv.islands(one, block_bits=4), iv.islands(two, block_bits=4)
    sa, sb = {x for x in a if x is not None}, set(b)
    assert _points(ia) == sa and _disjoint(ia)
    assert _points(iv.merge(ia, ib)) == sa | sb and _disjoint(iv.merge(ia, ib))
    assert _points(iv.subtract(ia, ib)) == sa - sb and _disjoint(iv.subtract(ia, ib))
    got = iv.rows_in(one, ib, block_bits=4)
    assert sorted(r["seq"] for r in got.collect()) == sorted(x for x in a if x in sb)
    assert iv.subtract(ia.limit(0), ib).count() == 0 and _points(iv.merge(ia.limit(0), ib)) == sb


def test_ledger_survives_failures(spark, tmp_path):
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/ledger", block_bits=4)
    feed = lambda *s: spark.createDataFrame([(x, f"v{x}") for x in s], "seq long, value string")
    assert ledger.run(feed(1, 2, 3, 7, 7), lambda df: df)["new"] == 4

    def broken(df):
        return df.withColumn("x", F.raise_error(F.lit("lost")))

    with pytest.raises(Exception, match="lost"):
        ledger.run(feed(1, 2, 3, 5, 7, 20), broken)
    assert ledger.versions() == [1]
    assert ledger.run(feed(1, 2, 3, 5, 7, 20), lambda df: df)["new"] == 2
    assert ledger.run(feed(1, 2, 3, 4, 5, 7, 20), lambda df: df)["new"] == 1  # a late commit
    assert ledger.run(feed(1, 2, 3, 4, 5, 7, 20), lambda df: df)["new"] == 0
    assert sorted(r["seq"] for r in ledger.outputs().collect()) == [1, 2, 3, 4, 5, 7, 7, 20]


def test_two_runs_at_once_dont_mix(spark, tmp_path):
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/ledger", block_bits=4)
    feed = spark.createDataFrame([(x, f"v{x}") for x in (1, 2, 3)], "seq long, value string")
    other = spark.createDataFrame([(x, f"w{x}") for x in (1, 2, 3, 4)], "seq long, value string")

    def overtaken(df):
        assert ledger.run(other, lambda rows: rows)["new"] == 4  # commits while the first one works
        return df

    with pytest.raises(RuntimeError, match="another run"):
        ledger.run(feed, overtaken)
    assert ledger.versions() == [1] and sorted(r["value"] for r in ledger.outputs().collect()) == ["w1", "w2", "w3", "w4"]
    assert ledger.run(feed, lambda rows: rows)["new"] == 0
    with pytest.raises(ValueError, match="begun"):
        ledger.adopt(iv.islands(feed))


def test_a_marker_cut_off_is_no_commit(spark, tmp_path):
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/ledger", block_bits=4)
    feed = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, value string")
    (tmp_path / "ledger/_commits").mkdir(parents=True)
    (tmp_path / "ledger/_commits/1").write_text("run-")
    assert ledger.versions() == [] and ledger.run(feed, lambda rows: rows) == {"version": 2, "new": 2}
    assert ledger.versions() == [2] and ledger.outputs().count() == 2


def test_too_many_artifacts_are_refused(spark):
    arts = spark.range(incremental.MAX_ARTIFACTS + 1).selectExpr("cast(id as string) as artifact_id", "true as is_active")
    with pytest.raises(ValueError, match="active artifacts"):
        incremental.active_artifacts(arts)


def test_stale_sources(spark, tmp_path):
    rows = [
        (1, "same", "create", 1, "AA"), (2, "same", "modify", 2, "aa"), (3, "new", "create", 1, "b"), (4, "changed", "create", 1, "c"), (5, "changed", "modify", 2, "d"), (6, "changed", "modify", 1, "C"), (7, "gone", "create", 1, "e"), (8, "gone", "delete", 2, None),
        (9, "never", "delete", 1, None), (10, "back", "create", 1, "f"), (11, "back", "modify", 2, "g"), (12, "back", "modify", 3, "F"), (13, "held_deleted", "delete", 1, None), (14, "held_deleted", "create", 2, "h"), (3, "new", "create", 1, "b"), (None, "x", "create", 1, "i"), (15, None, "create", 1, "j"), (16, "old_artifact", "create", 1, "k"),
    ]
    feed = spark.createDataFrame([(*r, "z") for r in rows], "seq long, source_id string, change_kind string, source_revision int, raw_content_hash string, content string")
    held = [("act", "same", 1), ("act", "same", 0), ("act", "changed", 1), ("act", "gone", 1), ("act", "back", 1), ("act", "held_deleted", 1), ("act", "new", None), ("old", "old_artifact", 1), ("act", None, 3)]
    manifest = spark.createDataFrame(held, "artifact_id string, source_id string, indexed_revision int")
    arts = spark.createDataFrame([("act", True), ("old", False)], "artifact_id string, is_active boolean")
    got = {(r["source_id"], r["source_revision"]) for r in incremental.stale_sources(feed, manifest, arts).collect()}
    assert got == {("new", 1), ("changed", 2), ("gone", 2), ("held_deleted", 2), ("old_artifact", 1)}
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/ledger")
    assert {(r["source_id"], r["source_revision"]) for r in incremental.stale_sources(feed, manifest, arts, ledger).collect()} == got
    assert ledger.versions() == [1, 2] and ledger.run(feed.where("source_id is not null"), lambda rows: rows)["new"] == 0
    assert incremental.stale_sources(feed.limit(0), manifest, arts).count() == 0
    assert incremental.stale_sources(feed, manifest.limit(0), arts.limit(0)).count() == 6


def test_link_names(spark):
    cases = {"a/B%20c.md#x": "b c", " Foo .txt": "foo", "x+y": "x+y", "100%": "100%", "p/q/": "", "Note.MD": "note", "%C3%A9t%C3%A9": "été", "a.b": "a.b"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r[0]: r[1] for r in df.select("l", orphans.link_name(F.col("l"))).collect()} == cases


def test_orphans(spark):
    sources = spark.createDataFrame(
        [("s1", "f/One.md", ["two", "ONE#a", "nine", "http://x.y/one", "a.PDF", None, "gone", "late"], 100, 1_700_000_000_000), ("s1", "f/One.md", ["two", "ONE#a", "nine", "http://x.y/one", "a.PDF", None, "gone", "late"], 100, 1_700_000_000_000), ("s2", "Two.txt", None, 5, None), ("s3", "late.md", [], 1_800_000_000_000, 1)],
        "source_id string, path_raw string, links array<string>, created_ms long, mtime_ms long",
    )
    chunks = spark.createDataFrame([("r1", "s1", 5), ("r2", "sx", 5), ("r2", "sx", 5), ("r3", None, 5), ("r4", "dead", None)], "row_id string, source_id string, mtime_ms long")
    changes = spark.createDataFrame(
        [(1, "dead", 1, "create", "gone.md", 5), (2, "dead", 2, "delete", "gone.md", 9), (3, "s2", 1, "create", "Old.txt", 4), (4, "s2", 2, "rename", "Two.txt", 9), (4, "s2", 2, "rename", "Two.txt", 9), (None, None, 1, "create", "x", 1)],
        "seq long, source_id string, source_revision int, change_kind string, path_raw string, mtime_ms long",
    )
    got = {(r["ref_table"], r["ref_key"], r["ref_pos"], r["status"]) for r in orphans.orphans(sources, chunks, changes).collect()}
    assert got == {("sources", "s1", 2, "missing"), ("sources", "s1", 6, "deleted"), ("chunks", "r2", 0, "missing"), ("chunks", "r4", 0, "deleted")}
    late = orphans.resolve(orphans.references(sources, chunks), orphans.parents(sources, changes)).where("status = 'late' and ref_table = 'sources'")
    assert {(r["ref_key"], r["ref_pos"]) for r in late.collect()} == {("s1", 7)}
    assert orphans.orphans(sources.limit(0), chunks.limit(0), changes.limit(0)).count() == 0


def test_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(orphans, "SALTS", 4)
    refs = spark.range(30_000).select(F.lit("t").alias("ref_table"), F.col("id").cast("string").alias("ref_key"), F.lit(0).alias("ref_pos"), F.lit("id").alias("kind"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.lit(5).cast("long").alias("ref_ms"))
    parents = spark.createDataFrame([("id", "hot", [(1, orphans._OPEN)]), ("id", "7", [(9, orphans._OPEN)])], "kind string, key string, valid array<struct<from_ms: long, to_ms: long>>")
    assert {r["status"]: r["count"] for r in orphans.resolve(refs, parents).groupBy("status").count().collect()} == {"ok": 15_000, "late": 1, "missing": 14_999}


def test_validity_intervals(spark):
    changes = spark.createDataFrame(
        [(1, "a", 1, "create", "Note.md", 10), (2, "a", 2, "delete", "Note.md", 20), (3, "a", 3, "create", "Note.md", 30), (4, "a", 4, "rename", "New.md", 40), (5, "b", 1, "create", "x/note.txt", 15), (6, "b", 2, "modify", "x/note.txt", 18), (7, "b", 3, "delete", "x/note.txt", 25)],
        "seq long, source_id string, source_revision int, change_kind string, path_raw string, mtime_ms long",
    )
    sources = spark.createDataFrame([("a", "New.md", 35)], "source_id string, path_raw string, created_ms long")
    valid = {(r["kind"], r["key"]): [tuple(v) for v in r["valid"]] for r in orphans.parents(sources, changes).collect()}
    assert valid[("name", "note")] == [(10, 25), (30, 40)] and valid[("name", "new")] == [(35, orphans._OPEN)] and valid[("id", "b")] == [(15, 25)]
    refs = spark.createDataFrame([("t", str(i), 0, "name", key, ms) for i, (key, ms) in enumerate([("note", 12), ("note", 27), ("new", 34), ("new", 36), ("new", None), ("none", 1)])], "ref_table string, ref_key string, ref_pos int, kind string, key string, ref_ms long")
    assert [r["status"] for r in orphans.resolve(refs, orphans.parents(sources, changes)).orderBy("ref_key").collect()] == ["deleted", "deleted", "late", "ok", "ok", "missing"]
    assert orphans.resolve(refs, orphans.parents(sources.limit(0))).where("status <> 'missing'").count() == 0

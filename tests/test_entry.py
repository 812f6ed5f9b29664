import __spark_entry__ as e


def test_registry(spark):
    names = e.queries()
    assert set(e.oracle_sql()) <= set(names)
    assert e.entry(spark).count() >= 0


def test_cuts_live_in_the_shared_folder(spark, tmp_path, monkeypatch):
    from inkwell import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    assert session.cut(spark.range(5)).count() == 5 and list(tmp_path.rglob("*.parquet"))
    session.drop_cuts(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_shared_folder_is_read_from_the_session():
    from types import SimpleNamespace as N

    from inkwell.session import shared_dir

    set_one = N(conf=N(get=lambda k, d: "hdfs://x/y/"), sparkContext=None)
    assert shared_dir(set_one) == "hdfs://x/y"
    unset = N(conf=N(get=lambda k, d: None), sparkContext=N(applicationId="a", master="local[2]"))
    assert shared_dir(unset) == shared_dir(unset) and shared_dir(unset).startswith("file://")
    cluster = N(conf=N(get=lambda k, d: None), sparkContext=N(applicationId="a", master="spark://x"))
    try:
        shared_dir(cluster)
    except RuntimeError:
        return
    raise AssertionError("a cluster without a shared folder has to be refused")

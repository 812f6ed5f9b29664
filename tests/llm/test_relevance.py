import math

from pyspark.sql import functions as F

from inkwell.llm import relevance


def test_weights_against_plain_formula(spark):
    rows = [("r1", "s1", ["a", "b", "a"], None, ["t"], []), ("r2", "s2", ["a", "c"], ["x"], ["t"], None), ("r3", None, ["d", None, "d"], [], [], []), ("r3", None, ["d", None, "d"], [], [], []), (None, "s4", ["a"], [], [], [])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "row_id string, source_id string, lexical_terms array<string>, lexical_ngrams array<string>, title_terms array<string>, tag_terms array<string>, weight double")
    got = {(r["row_id"], r["field_name"], r["term"]): r for r in relevance.term_weights(df).collect()}
    n, avg = 3, (3 + 2 + 2) / 3
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    want = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))
    a = got["r1", "lexical_terms", "a"]
    assert abs(a["weight"] - want) < 1e-9 and a["df"] == 2 and a["n_sources"] == 2 and a["tf"] == 2
    assert got["r3", "lexical_terms", "d"]["tf"] == 2 and got["r3", "lexical_terms", "d"]["n_sources"] == 0
    assert len(got) == 8 and relevance.term_weights(df.limit(0)).count() == 0


def test_hot_terms_are_kept(spark, monkeypatch):
    monkeypatch.setattr(relevance, "HOT_DF", 5)
    rows = [(f"r{i}", f"s{i}", ["the", f"w{i}"], [], [], []) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id string, source_id string, lexical_terms array<string>, lexical_ngrams array<string>, title_terms array<string>, tag_terms array<string>")
    out = relevance.term_weights(df)
    assert out.count() == 40 and out.where("term = 'the' and df = 20").count() == 20
    assert {r["term"] for r in relevance.top_terms(out, 1).collect()} == {f"w{i}" for i in range(20)}


def test_hot_terms_make_no_difference(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(f"r{i}", f"s{i % 7}", ["the", *rng.choices("abcdefgh", k=4)], [], ["t"], None) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id string, source_id string, lexical_terms array<string>, lexical_ngrams array<string>, title_terms array<string>, tag_terms array<string>")
    wide, narrow = F.col("n_sources") >= 3, F.col("n_sources").between(2, 6)
    plain = [sorted(map(str, relevance.term_weights(df, keep_terms=k).collect())) for k in (None, wide, narrow)]
    monkeypatch.setattr(relevance, "HOT_DF", 10)
    assert [sorted(map(str, relevance.term_weights(df, keep_terms=k).collect())) for k in (None, wide, narrow)] == plain

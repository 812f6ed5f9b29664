import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import language as lg

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples(spark):
    return [(r["lang_code"], r["sample_text"]) for r in spark.read.parquet(f"{D}/lang_samples.parquet").orderBy("sample_id").collect()]


def test_held_out_accuracy(samples):
    model = lg.LanguageModel([s for i, s in enumerate(samples) if i % 4])
    held = [s for i, s in enumerate(samples) if i % 4 == 0]
    right = sum((lg.languages_in(model, t) or [("?", 0, 0)])[0][0] == c for c, t in held)
    assert right >= 0.97 * len(held)


def test_viterbi_equals_plain_recursion():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60):
        s = rng.normal(0, 4, (n, 5)).astype(np.float32)
        best = s[0].astype(float).copy()
        for row in s[1:]:
            best = np.maximum(best, best.max() - lg.SWITCH) + row
        path = lg.viterbi(s)
        cost = s[np.arange(n), path].sum() - lg.SWITCH * (np.diff(path) != 0).sum()
        assert abs(cost - best.max()) < 1e-3


def test_mixed_text_and_markup(samples):
    model = lg.LanguageModel(samples)
    text = "# Kiln\n\nWe slowly keep the quiet index behind the garden. Das Heft schützt die Probe und das Gefäß.\n\n```\nselect from where\n```\nsee note [3]."
    assert {a for a, _, _ in lg.languages_in(model, text)} == {"en", "de"}
    assert [x[2] for x in lg.segments_in(model, text)] == ["en", "de"] or {"en", "de"} <= {x[2] for x in lg.segments_in(model, text)}
    assert all(0 < x[3] <= 1 for x in lg.segments_in(model, text))
    for empty in (None, "", "12 34", "Kiln", "   \n"):
        assert lg.languages_in(model, empty) == []
    lg.languages_in(model, "wort " * 200_000)


@pytest.mark.parametrize("where", ["{en} {de}", "# Das Heft\n\n{en} **{de}**", "`das ist` {en}\n```\nwe slowly keep das Heft\n```\n{de}\n", "<p title='das'>{en}</p><b>{de}</b>", "\u200b{en}\u00a0{de}", "[[Heft|{en}]] $das$ {de}"])
def test_segments_are_places_in_the_given_text(samples, where):
    model = lg.LanguageModel(samples)
    en, de = "We slowly keep the quiet index behind the garden.", "Das Heft schützt die Probe und das Gefäß."
    for form in ("NFC", "NFD"):
        text = unicodedata.normalize(form, where.format(en=en, de=de))
        got = lg.segments_in(model, text)
        assert [x[2] for x in got] == ["en", "de"]
        first, second = (unicodedata.normalize("NFC", text[a:b]).replace("*", "") for a, b, _, _ in got)
        assert first.startswith("We slowly") and first.endswith("garden") and second.startswith("Das Heft") and second.endswith("Gefäß")


def test_segments_of_canonical_texts_need_no_search(samples):
    model = lg.LanguageModel(samples)
    assert lg.segments_in(model, "Das Heft schützt die Probe und das Gefäß.")[0][:2] == (0, 40)
    assert lg.segments_in(model, "İndex İndex Das Heft schützt die Probe.")[-1][1] == 38


def test_labels(spark):
    rows = [("EN",), ("en_GB",), ("eng",), ("zh-Hant",), ("und",), ("",), (None,), ("deu",), ("nld",), ("dut",), ("wel-GB",), ("tur",), ("xyz",), ("english",)]
    got = [r[0] for r in spark.createDataFrame(rows, "l string").select(lg.label_code(F.col("l"))).collect()]
    assert got == ["en", "en", "en", "zh", None, None, None, "de", "nl", "nl", "cy", "tr", "xyz", None]


def test_wrong_labels(spark, samples):
    model = lg.LanguageModel(samples)
    en, de = "We slowly keep the quiet index behind the garden.", "Das Heft schützt die Probe und das Gefäß."
    chunks = spark.createDataFrame([("r1", "s1", ["en"], en), ("r1", "s1", ["en"], en), ("r2", "s1", None, de), ("r3", None, ["EN_us"], en), ("r4", "s2", ["fr"], None)], "row_id string, source_id string, language_codes array<string>, text_raw string")
    sources = spark.createDataFrame([("s1", "en", ["en"]), ("s2", "xx", None), ("s3", "de", [])], "source_id string, primary_language string, languages array<string>")
    docs = spark.createDataFrame([(1, "eng", en), (2, None, de), (3, "de", None), (None, "de", en)], "doc_id long, lang string, text string")
    got = {tuple(r) for r in lg.wrong_labels(chunks, sources, docs, model).collect()}
    assert got == {("chunks", "r2", "de"), ("sources", "s1", "en"), ("sources", "s1", "de"), ("documents", "2", "de")}
    assert lg.wrong_labels(chunks.limit(0), sources.limit(0), docs.limit(0), model).count() == 0


def test_text_segments(spark, samples):
    model = lg.LanguageModel(samples)
    en, de = "We slowly keep the quiet index behind the garden.", "Das Heft schützt die Probe und das Gefäß."
    chunks = spark.createDataFrame([("r1", en), ("r1", en), ("r2", f"{en} {en} {de}"), ("r3", None)], "row_id string, text_raw string")
    docs = spark.createDataFrame([(1, de), (None, en)], "doc_id long, text string")
    rows = lg.text_segments(chunks, docs, model).collect()
    got = {(r["ref_table"], r["ref_key"], r["text_lang"], r["lang"]) for r in rows}
    assert got == {("chunks", "r1", "en", "en"), ("chunks", "r2", "en", "en"), ("chunks", "r2", "en", "de"), ("chunks", "r3", None, None), ("documents", "1", "de", "de")}
    assert len(rows) == len(got) and all(0 < r[c] <= 1 for r in rows if r["lang"] for c in ("confidence", "text_confidence"))


def test_segments_of_every_chunk_and_document(spark):
    import __spark_entry__ as e

    keys = {tuple(r) for r in e.queries()["p6_segments"](spark, D).select("ref_table", "ref_key").distinct().collect()}
    chunks, docs = spark.read.parquet(f"{D}/chunks.parquet"), spark.read.parquet(f"{D}/documents.parquet")
    assert keys == {("chunks", r[0]) for r in chunks.select("row_id").collect()} | {("documents", str(r[0])) for r in docs.select("doc_id").collect()}

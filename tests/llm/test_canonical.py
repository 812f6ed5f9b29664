import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm.canonical import canonical, canonical_column, canonicalizer, look_alikes

pytestmark = pytest.mark.usefixtures("spark")


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ＡＢＣ　１", "ABC 1"), ("e\u0301", "é"), ("a\u200bb\u00adc", "abc"), ("a\u00a0b", "a b"), ("n\u043et\u0435", "note"), ("\u03a4\u03c5\u03bf", "Tuo"), ("\u0420\u043e\u0441\u0441\u0438\u044f, p\u043ec\u0442", "\u0420\u043e\u0441\u0441\u0438\u044f, \u0440\u043e\u0441\u0442"),
        ("R\u0435\u0301sum\u0435\u0301", "Résumé"), ("\u0430\u0301", "á"), ("st\u03c5\u0308tzt", "stützt"), ("\u0441af\u00e9", "caf\u0435\u0301"), ("gar\u00e7on", "g\u0430r\u0441\u0327on"), ("\u0451\u043b\u043a\u0430", "e\u0308\u043b\u043aa"), ("b\u043en \ufb01", "bon fi"),
        ("\u30ab\u30e1\u30e9", "\u529b\u30e1\u30e9"), ("\u52aa\u529b", "\u52aa\u30ab"), ("\u306f\u3079\u3064", "\u306f\u30d9\u3064"), ("\u0585n", "on"), ("\u13da", "\u13da"), ("x ", "x"), ("x\u200b \u00a0", "x"),
    ],
)
def test_same_looks_same_form(a, b):
    assert canonical(a) == canonical(b) and canonical(canonical(a)) == canonical(a)


def test_visible_differences_stay():
    for a, b in (("Note", "note"), ("note", "noté"), ("a b", "b a"), ("сад", "sad"), ("a  b", "a b"), ("x²", "x2"), ("Il1", "lI1"), ("O0", "0O"), ("rn", "m"), (" a", "a"), ("ß", "ss")):
        assert canonical(a) != canonical(b)


def test_consistent_script_is_chosen():
    assert canonical("p\u043e\u0441\u0442 дом") == "\u0440\u043e\u0441\u0442 дом"
    assert canonical("\u0440\u043e\u0441\u0435 and then") == "poce and then" and canonical("\u0440\u043e\u0441\u0435 \u0438") == "\u0440\u043e\u0441\u0435 \u0438"
    assert canonical(None) is None and canonical("") == "" and len(canonical("\u0435" * 100_000)) == 100_000


@given(st.text(st.sampled_from("aceopxyu стдABETnéüçёñ\u0301\u0308 1-"), max_size=20), st.integers(0, 2**20))
@settings(max_examples=300, deadline=None)
def test_any_look_alike_spelling_has_one_form(text, bits):
    own, out = canonicalizer(), []
    for i, ch in enumerate(unicodedata.normalize("NFD", text)):
        at = own.looks.get(ch)
        others = sorted(own.shapes[at].values()) if at is not None else [ch]
        out.append(others[(bits >> i) % len(others)] if bits >> i & 1 else ch)
    assert canonical("".join(out)) == canonical(text)
    assert canonical(canonical(text)) == canonical(text)


def test_column(spark):
    df = spark.createDataFrame([("n\u043ete", 1), (None, 2), ("", 3)], "value string, canonical int")
    assert [r["form"] for r in canonical_column(df, "value", "form").orderBy("canonical").collect()] == ["note", None, ""]
    assert canonical_column(df.limit(0), "value", "form").count() == 0


def test_pairs(spark):
    rows = [("t", "1", "note"), ("t", "1", "note"), ("t", "2", "n\u043ete"), ("t", "3", "note"), ("t", "4", "other"), ("t", "5", None), ("p", "6", "ｎｏｔｅ"), ("t", None, "note"), ("t", "7", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "field_name string, key string, value string, form string")
    assert {tuple(r) for r in look_alikes(df).collect()} == {("t", "1", "2"), ("t", "2", "3")}
    assert look_alikes(df.limit(0)).count() == 0

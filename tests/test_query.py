import pytest

from inkwell.operators.filters import RowFilter
from inkwell.plans import query as q


@pytest.mark.parametrize(
    ("raw", "part", "value"),
    [
        ("kiln glaze notes", "terms", ("kiln", "glaze", "notes")), ('"slow firing" cone', "phrases", ("slow firing",)), ('clay -raku -"salt glaze"', "excluded", ("raku", "salt glaze")),
        ("folder:Studio path:pots ext:.TXT tag:#craft", "filters", (("folder", "Studio"), ("path", "pots"), ("ext", "txt"), ("tag", "craft"))), ("after:someday", "terms", ("after:someday",)), ("cone::six shelf:two", "terms", ("cone::six", "shelf:two")),
        ('tag:"two words" wheel', "filters", (("tag", "two words"),)), ('tag:"two words" wheel', "terms", ("wheel",)), ("file:log.txt title:t id:Q7", "fields", (("file", "log.txt"), ("title", "t"), ("id", "Q7"))), ("path: glaze", "terms", ("glaze",)), ("-tag:raku", "excluded", ("tag:raku",)),
        ("", "terms", ()), ('"not closed', "phrases", ("not closed",)), ("wheel - bat", "terms", ("wheel", "-", "bat")), ("SEMANTIC: slip", "mode", "semantic"), ("exact:slip", "mode", "exact"), ('"  "', "phrases", ()),
    ],
)
def test_parse(raw, part, value):
    assert getattr(q.parse(raw), part) == value


def test_dates():
    f = dict(q.parse("before:2026-01-01 after:2025-01-01").filters)
    assert f == {"before": 1767225600000, "after": 1735776000000 - 1}
    assert q.day_bound("2025-02-31", True) == q.day_bound("2025-03-03", True) and q.day_bound("2025-13-01", True) is None


@pytest.mark.parametrize(
    ("raw", "label", "factor"),
    [
        ('"cone six"', "exact+lexical", 1), ("title:glazes", "exact+lexical", 1), ("shed/kiln.log", "exact+lexical", 1), ("KilnLogReader", "exact+lexical", 1), ("ash glaze", "hybrid", 0.5), ("which ash glaze runs at cone six", "hybrid", 1), ("ash glaze?", "hybrid", 1),
        ("tag:craft", "metadata", 1), ("", "none", 1), ("釉薬の焼成温度", "hybrid", 1), ("semantic:ash", "semantic", 1), ("lexical:ash", "lexical", 1), ("exact:ash", "exact", 1),
    ],
)
def test_plan(raw, label, factor):
    p = q.plan(q.parse(raw))
    assert p.label == label and p.semantic_factor == factor


def test_degradation():
    assert q.plan(q.parse("ash glaze"), embedding=False).label == "exact+lexical" and q.plan(q.parse("lexical:x"), embedding=True, lexical=False).label == "exact+semantic"
    p = q.plan(q.parse("semantic:x"), embedding=False)
    assert p.label == "exact+lexical" and p.degraded == ("semantic_unavailable",)
    p = q.plan(q.parse("lexical:x"), embedding=False, lexical=False, store=False)
    assert p.label == "exact" and p.degraded == ("store_empty", "lexical_unavailable")


def test_needles_and_filters():
    n = q.needles(q.parse('"a b" title:t file:f id:i word snake_case'))
    assert [(x.phrase, len(x.fields)) for x in n] == [("a b", 6), ("t", 2), ("f", 2), ("i", 3), ("snake_case", 6)]
    assert [x.phrase for x in q.needles(q.parse("word"), True)] == ["word"]
    f = q.row_filter(q.parse("folder:b before:2025-01-01 tag:x"), RowFilter(folders=("a",), mtime_before=5, source_ids=("s",)))
    assert f.folders == ("a", "b") and f.mtime_before == 5 and f.tags == ("x",) and f.source_ids == ("s",)


def test_identifiers():
    assert q.split_identifier("HTTPServerIndexProfile2Go") == ["HTTP", "Server", "Index", "Profile2", "Go"]
    assert q.split_identifier("std::my_vec-x.y/Z") == ["std", "my", "vec", "x", "y", "Z"]


def test_content_is_phrases_terms_fields():
    assert q.parse('ash title:pots "cone six" glaze').content_text == "cone six ash glaze pots"

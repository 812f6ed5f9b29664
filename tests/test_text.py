import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import hashing, markdown, text, vectors
from inkwell.plans.query import split_identifier


def _one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_normalization(spark):
    r = _one(spark, "ＦＵＬＬ　 Width\tÉté", text.normalize_lexical("x"), text.fold_accents("x"), text.collapse_whitespace("x"))
    assert r[0] == "full width été" and r[1].endswith("Ete") and r[2] == "ＦＵＬＬ Width Été"
    assert tuple(_one(spark, None, text.normalize_lexical("x"), text.fold_accents("x"))) == (None, None)


@pytest.mark.parametrize(
    ("value", "primary", "mixed"), [("日本語のテキスト", "ja", True), ("中文文本", "zh", False), ("한국어", "ko", False), ("ภาษาไทย", "th", False), ("العربية", "ar", False), ("עברית", "he", False), ("English", "und", False), ("中文 with much English", "zh", True), ("", "und", False), ("123", "und", False)]
)
def test_language(spark, value, primary, mixed):
    r = _one(spark, value, text.language_of(text.script_counts("x")).alias("l"))["l"]
    assert r["primary_language"] == primary and r["mixed"] == mixed


def test_identifier_terms(spark):
    r = _one(spark, "use IndexProfileService and snake_case plain", text.identifier_terms("x").alias("t"))["t"]
    assert {"indexprofileservice", "index_profile_service", "index-profile-service", "service", "snake_case", "snakecase"} <= set(r) and "plain" not in r


def test_split_matches_plain_code(spark):
    tokens = ["HTTPServer2Go", "std::vec.x", "a-b_c/D", "ÄrgerÖl", "x", "ABC", "v1.2", "fooBARBaz9Q", "__a__"]
    got = spark.createDataFrame([(t,) for t in tokens], "x string").select("x", text.split_identifier("x").alias("p")).collect()
    assert {r["x"]: list(r["p"]) for r in got} == {t: split_identifier(t) for t in tokens}


def test_ngrams_and_terms(spark):
    df = text.with_analysis(spark.createDataFrame([("検索 one, Two_3 検 été",), (None,)], "x string"), "x", "a")
    r, nothing = (x["a"] for x in df.collect())
    assert list(nothing["terms"]) == [] and list(r["secondary_terms"]) == ["ete"]
    assert list(r["terms"]) == ["検索", "one", "two_3", "検", "été"] and list(r["ngrams"]) == ["検索", "検"]
    r = _one(spark, "全文検索", text.ngrams("x").alias("n"))["n"]
    assert list(r) == ["全文", "文検", "検索", "全文検", "文検索"]


def test_token_estimate_is_the_same_in_both_places(spark):
    values = ["五個漢字啊", "abcdefgh", "mixed 漢字 and ไทย", "", "한국어 text", " \n\t "]
    got = {r["x"]: r["n"] for r in spark.createDataFrame([(v,) for v in values], "x string").select("x", text.estimate_tokens("x").alias("n")).collect()}
    assert got == {v: markdown.estimate_tokens(v) for v in values} and got["五個漢字啊"] == 5 and got["abcdefgh"] == 2


def test_find_and_snippet(spark):
    r = _one(spark, "hello World", text.find_verified("x", F.lit("world")), text.find_verified("x", F.lit("world"), True), text.find_verified("x", F.lit("zz")))
    assert tuple(r) == (6, None, None)
    assert _one(spark, "中文検索", text.find_verified("x", F.lit("検索")))[0] == 2
    assert _one(spark, "İx abc", text.find_verified("x", F.lit("ABC")))[0] == 3
    long = "x" * 100 + "needle" + "y" * 300
    s = _one(spark, long, text.snippet("x", F.lit(100), F.lit(6)).alias("s"))["s"]
    assert s["snippet"][s["highlight_start"] : s["highlight_end"]] == "needle" and s["snippet"][0] == s["snippet"][-1] == "…"
    assert _one(spark, "short", text.snippet("x", F.lit(None).cast("int"), F.lit(None).cast("int")).alias("s"))["s"]["snippet"] == "short"


def test_plain_analysis_equals_columns(spark):
    values = ["HTTPServerIndex2Go std::vec café ＦＵＬＬ　幅", "全文検索エンジン ー 々 한국어 검색 ไทย ພາສາ မြန်မာ ខ្មែរ", "snake_case-kebab a.b/c.D x² ½ Ⅷ", "İstanbul ßtraße Ärger", "", "  ", "検", "don't __a__ v1.2", "ｶﾅ かな カナ"]
    rows = text.with_analysis(spark.createDataFrame([(v,) for v in values], "x string"), "x", "a").collect()
    for r in rows:
        a = r["a"]
        assert text.analyze_words(r["x"]) == (list(a["terms"]) + list(a["secondary_terms"]), list(a["ngrams"]), list(a["identifier_terms"])), r["x"]


def test_paths_and_links(spark):
    r = _one(spark, "Notes\\Sub/A.b.MD", text.path_terms("x").alias("p"))["p"]
    assert list(r) == ["notes", "sub", "a.b.md", "a.b", "md", "notes/sub/a.b.md"]
    assert _one(spark, "dir/Note Name.md#part", text.link_target("x"))[0] == "note name"
    assert list(_one(spark, "a/Stem.md", text.link_names("x", F.lit("Title")).alias("n"))["n"]) == ["stem", "title"]
    p = _one(spark, "plain", text.path_parts("x").alias("p"))["p"]
    assert (p["filename"], p["folder"]) == ("plain", "")


def test_template(spark):
    c, used, missing = text.render_template("{{title}}: {{ content }}{{nope}}", {"title": F.col("x"), "content": F.lit("{{title}}")})
    assert _one(spark, "T", c)[0] == "T: {{title}}" and used == ["title", "content"] and missing == ["nope"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.dot(F.col("a"), F.col("b")), vectors.l2(F.col("a"), F.col("b"))).collect()
    assert abs(got[0][0] - 0.6) < 1e-9 and got[0][1] == 3 and abs(got[0][2] - 20**0.5) < 1e-6
    assert got[1][0] == 0 and got[2][1] is None and got[3][1] is None
    back = df.select(vectors.decode_base64(vectors.encode_base64("b")).alias("v")).collect()
    assert [list(r["v"]) for r in back][:2] == [[3.0, 4.0], [1.0, 0.0]]


def test_canonical_json():
    assert hashing.canonical_json({"b": [1, -0.0, 2.5], "a": "é"}) == '{"a":"é","b":[1,0,2.5]}'
    with pytest.raises(ValueError):
        hashing.canonical_json([float("nan")])


NOTE = """---
title: My Note
aliases: [One, 'Two']
tags:
  - alpha
  - "#beta"
---
Intro with [[Target#part|shown]] and #inline and #123.

# First
- [ ] open
- [x] done
```js
# not a heading
```
## 第二 Section
![pic](img.png "t") [self](#x)
"""


def test_extract():
    n = markdown.extract(NOTE, "stem")
    assert n.title == "My Note" and n.aliases == ["One", "Two"] and n.tags == ["alpha", "beta", "inline", "x"]
    assert [(level, t) for level, t, _ in n.headings] == [(1, "First"), (2, "第二 Section")]
    assert [(x[0], x[1], x[3]) for x in n.links] == [("Target", "shown", False), ("img.png", "pic", True)]
    assert [(t, c) for t, c, _ in n.tasks] == [("open", False), ("done", True)] and n.fences[0][2] == "js"
    assert markdown.extract("no front\n# H", "s").title == "H" and markdown.extract("", "s").title == "s"


def test_chunks():
    n = markdown.extract(NOTE, "stem")
    got = markdown.chunks(n, markdown.Budget(512, 64, 0))
    assert [c["block_type"] for c in got] == ["preamble", "heading_block", "heading_block"] and got[2]["heading_path"] == ["First", "第二 Section"]
    for c in got:
        assert NOTE[c["char_start"] : c["char_end"]].strip().startswith(c["text_raw"].split("\n")[0])
    many = markdown.extract("# H\n" + "\n".join(f"line {i} " + "word " * 10 for i in range(200)), "s")
    split = markdown.chunks(many, markdown.Budget(128, 16, 0))
    assert len(split) > 5 and {c["block_type"] for c in split} == {"split"} and len({c["structural_anchor"] for c in split}) == len(split)
    tiny = markdown.chunks(markdown.extract("# A\na\n# B\nb\n# C\nc", "s"), markdown.Budget(512, 0, 50))
    assert [c["block_type"] for c in tiny] == ["merged"]
    table = markdown.chunks(markdown.extract("| a | b |\n|---|---|\n" + "\n".join(f"| {i} value | some text |" for i in range(120)), "s"), markdown.Budget(96, 0, 0))
    assert all(c["text_raw"].startswith("| a | b |\n|---|---|") for c in table) and len(table) > 3
    fence = "intro text here\n" * 20 + "```\n" + "\n".join(f"code line number {i}" for i in range(30)) + "\n```\n" + "after\n" * 20
    pieces = markdown.chunks(markdown.extract(fence, "s"), markdown.Budget(160, 0, 0))
    assert sum("code line" in c["text_raw"] for c in pieces) == 1
    assert "code" not in "".join(c["text_raw"] for c in markdown.chunks(markdown.extract(fence, "s"), markdown.Budget(160, 0, 0, False)))
    assert markdown.chunks(markdown.extract("", "s")) == []


@given(st.lists(st.sampled_from(["# a", "## b", "text", "", "```", "| x | y |", "|---|", "---", "- [ ] t", "漢字" * 9]), max_size=40))
@settings(max_examples=150, deadline=None)
def test_chunks_cover_all_lines(lines):
    n = markdown.extract("\n".join(lines), "s")
    got = markdown.chunks(n, markdown.Budget(16, 0, 4))
    covered = {i for c in got for i in range(c["line_start"], c["line_end"] + 1)}
    assert all(i in covered for i in range(n.front_end + 1, len(n.lines)) if n.lines[i].strip())
    assert [c["chunk_ordinal"] for c in got] == list(range(len(got))) and json.dumps(got)

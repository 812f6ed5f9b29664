import pytest

from inkwell.llm import markup


@pytest.mark.parametrize(
    ("text", "families"),
    [
        ("# Head\n\ntext", ["markdown"]), ("Head\n====\ntext", ["markdown"]), ("a *b* c", ["markdown"]), ("3 * 4 * 12 = 144.", []), ("2 ** 3 is 8, x_1 and under_score.", []), ("`x`", ["markdown"]), ("[a](b.md)", ["markdown"]), ("[a][1]\n\n[1]: b.md", ["markdown"]),
        ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("> quoted", ["markdown"]), ("~491 km, 5 > 3.", []), ("- [ ] do", ["markdown"]), ("- plain\n- list", []), ("x.[^3]", ["markdown"]), ("see note [545].", []), ("#tag and #other", []),
        ("a <b>c</b>", ["html"]), ("<!-- gone -->a", ["html"]), ("a&nbsp;b", ["html"]), ("R&D and Q&A.", []), ("x <- f(), a < b and c > d.", []), ("&#8212;", ["html"]), ("&nosuch;", []),
        ("[[Note|label]]", ["wiki"]), ("[https://x.invalid label]", ["wiki"]), ("{{cite|a=1}}", ["wiki"]), ("''it''", ["wiki"]), ("it's 'quoted'", []), ("== head ==", ["wiki"]), ("{| class=\"grid\"\n|-\n| a\n|}", ["wiki"]), ("__NOTOC__", ["wiki"]), ("#REDIRECT [[A]]", ["wiki"]),
        ("\\section{A}", ["latex"]), ("\\begin{quote}\na\n\\end{quote}", ["latex"]), ("$x_1$", ["latex"]), ("$$x$$", ["latex"]), ("\\( x \\)", ["latex"]), ("costs $40 and $60.", []), ("C:\\notes\\archive332.", []), ("{draft} of [0, 167).", []),
        ("```\n<b>$x$</b> [[a]]\n```", ["markdown"]), ("`<b>`", ["markdown"]), ("<pre>**a** $x$</pre>", ["html"]), ("$a_{[[x]]} <b>$", ["latex"]), ("[[a <b>]]", ["wiki"]), ("````sql\nselect '''", ["markdown"]), ("<img src=\"a.png\" alt=''> b", ["html"]), ("", []), ("plain", []),
    ],
)
def test_families(text, families):
    assert markup.clean(text)[1] == families


def test_null_is_null():
    assert markup.clean(None) == (None, [])


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"), ("<p>a<p>b", "a\n\nb"), ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"), ("<style>x</style>a<span style='display:none'>b</span>", "a"), ("<pre>x\n  y</pre>", "    x\n      y"),
        ("## A ##\ntext", "## A\ntext"), ("\\section{A}\ntext", "## A\ntext"), ("```py\nx = 1\n```", "    x = 1"), ("a $x^2$ b", "a $x^2$ b"), ("[[Note|label]] and [t](u)", "label and t"), ("**a** *b* `c`", "a b c"), ("&lt;b&gt; &amp;amp;", "<b> &amp;"),
    ],
)
def test_rendering_keeps_structure(text, shown):
    assert "\n".join(x for x in markup.clean(text)[0].split("\n") if x) == "\n".join(x for x in shown.split("\n") if x)


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("a <span hidden>x</span> visible after", "a  visible after"), ("<p>one</p><p style='display:none'>two</p><p>three</p>", "one\nthree"), ("<p hidden>one<p>two", "two"), ("<div style='visibility : hidden'>a<b>b</b></div>c", "c"), ("<b style=\"color:red\">x</b>", "x"),
        ("<a title=\"no hidden fees\">text</a> x", "text x"), ("<p class=\"a hidden b\">vis</p>y", "vis\ny"), ("<i data-hidden=1>x</i>", "x"), ("<div>" * 61 + "<span hidden>secret</span>ok", "ok"), ("<div>" * 500 + "<p>in</p>" + "</div>" * 500 + "out", "in\nout"),
        ("<style>p { }</style>a<script>if (a < b) x()</script>b", "ab"), ("<img src=x alt='a &amp; b' hidden><img alt=pic>", "pic"), ("</b></p>x<br>y", "x\ny"),
        ("\\textcolor{red}{visible words}", "visible words"), ("\\href{u}{the label}", "the label"), ("\\textbf{a \\emph{b} c}", "a b c"), ("\\textbf{a {b} c}", "a {b} c"), ("see \\cite[p. 3]{x} here", "see  here"), ("\\pair{one}{two}", "one two"), ("\\emph{open", "\\emph{open"),
        ("{{x|{{y}}}}z", "z"), ("{{Infobox\n| a = b\n| c = {{d}}\n}}\nrest", "rest"), ("{{open and **b**", "{{open and b"), ("a $$ b and c", "a $$ b and c"), ("**b** $$ x\n\n$$ y", "b $$ x\n$$ y"), ("\\( open **b**", "\\( open b"), ("**two\nlines**", "two\nlines"), ("[a\nb](c)", "a\nb"), ("`x\ny`", "x y"), ("`x\n\ny` *z*", "`x\ny` z"),
        ("[![alt](i.png)](u)", "alt"), ("[a [b] *c*](u)", "a [b] c"), ("*a [b*](c)", "*a b*"), ("*see [0, 5) there*", "see [0, 5) there"), ("[a *b](c) d*", "a *b d*"), ("[http://x.y the *label*]", "the label"), ("**a *b* c**", "a b c"), ("\\*no\\* *yes*", "\\*no\\* yes"), ("[x](a_(b))", "x"), ("''a\nb''", "''a\nb''"),
        ("\\begin{enumerate}\n\\item a\n\\begin{itemize}\n\\item b\n\\end{itemize}\n\\item c\n\\end{enumerate}", "1. a\n  - b\n2. c"), ("\\begin{tabular}{ll}\nab & c \\\\ \\hline\nd & ef\n\\end{tabular}", "ab | c\nd  | ef"), ("\\section{A \\emph{b}}\ntext", "## A b\ntext"),
        ("<table><tr><td>a<td>b<table><tr><td>c<td>in</table><tr><td colspan=2>wide</table>", "a    | b c in\nwide |"),
    ],
)
def test_visible_text_is_kept_and_hidden_text_is_not(text, shown):
    assert "\n".join(x for x in markup.clean(text)[0].split("\n") if x) == shown


@pytest.mark.parametrize(("text", "family"), [("`" + "x " * 3000 + "y`", "markdown"), ("**" + "x " * 3000 + "y**", "markdown"), ("''" + "x " * 3000 + "y''", "wiki"), ("\\emph{" + "x " * 3000 + "}", "latex"), ("{{" + "x " * 3000 + "}}", "wiki")])
def test_length_makes_no_difference(text, family):
    assert markup.clean(text)[1] == [family]


def test_time_is_linear_in_hostile_texts():
    import time

    parts = ("<div>", "*a ", "[", "$a ", "'' a", "<a ", "| a ", "> ", "<!--", "\\(", "\\[", "$$ a\n\n", "{{", "{{a}", "}}", "\\x{", "\\x{a}{", "[a](", "![", "` `` ", "_a ", "</b>", "<td>", "<li>", "<p hidden>", "\\begin{itemize}\n", "\\item \n", "[http://a b", "&a;", "<pre>", "```\n````\n", "*a* _b", "[[a")
    for part in parts:
        took = []
        for n in (10_000, 40_000):
            began = time.process_time()
            markup.clean(part * n)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.5, part


def test_long_and_nested_texts_end_quickly():
    for text in ("<div>" * 5000 + "a", "*a " * 50_000, "`" * 100_000, "[" * 100_000, "$a " * 50_000, "'' a" * 30_000, "<a " * 30_000, "| a " * 30_000, "> " * 30_000, "<!--" * 30_000, "\\begin{equation}" * 5000, "{{" * 50_000):
        markup.clean(text)
    assert markup.clean("<div>" * 50_000 + "deep")[0] == "deep"


def test_prose_leaves_out_code_and_headings():
    assert markup.prose("# Head\n\nA sentence.\n\n```\ncode\n```\n$x$") == "A sentence."


def test_dataframe_keeps_rows(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", "**b**", "y"), ("b", "**b**", "y")], "row_id string, text_raw string, families string")
    rows = {tuple(r[:2]) for r in markup.render_markup(df, "row_id").collect()}
    assert rows == {("a", None), ("b", "b")}
    assert markup.render_markup(df.limit(0), "row_id").count() == 0

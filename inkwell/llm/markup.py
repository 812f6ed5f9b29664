"""Markup residue: HTML, Markdown, wiki and LaTeX text to clean text that keeps its structure.

A tree builder reads a text once. Opaque constructs (fences, code spans, comments, pre and script elements, formulas,
wiki links, tags) are taken out first, leftmost first, so that what stands inside them belongs to them alone; then
templates, which may span lines and nest. The rest is read by line: every heading, list item, quote, table or
environment opens and closes the same elements that HTML tags do, with HTML's implied end tags (li, p, td, tr, dt, dd,
option) and void elements. Plain lines are read by paragraph: emphasis, links, images and commands with arguments nest
and may go over line breaks. Elements that no reader sees (head, script, style, template, those whose attributes hide
them, comments) stay out of the text, up to their own end tag. The renderer emits all visible text: blocks on lines of
their own, list marks with indentation, table cells aligned in columns, code and formulas unchanged.

Defined cases: null gives null text and no family; an empty text gives an empty text. Fences, comments, pre elements
and environments that a chunk's end cut off reach to the end; formulas end within their paragraph or are none. Texts of
any length and elements nested to any depth are read whole; nothing is bounded in length, and time stays linear.
Repeated rows give repeated results.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FAMILIES = ("html", "latex", "markdown", "wiki")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title iframe object canvas svg".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
# An opening element ends these open elements, looking no further up than the scopes.
IMPLIED = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th"), ("table",)), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("tbody", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)),
}
# LaTeX commands that name something instead of showing it, those that show their last argument only, section levels.
SILENT = frozenset("label ref eqref pageref cite citep citet usepackage documentclass input include includegraphics bibliography bibliographystyle vspace hspace newcommand renewcommand setlength addtolength setcounter pagestyle thispagestyle index".split())
LAST_SHOWN = frozenset("textcolor href hyperref colorbox fcolorbox parbox raisebox resizebox scalebox multicolumn multirow".split())
LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}

_FORMULA_ENV = "equation|align|gather|multline|eqnarray|displaymath|math"
#: Where an opaque construct may begin; what it is and how far it goes is found out there.
_OPEN = re.compile(
    r"(?P<fence>^[ ]{0,3}(?:>[ ]?)?(?P<mark>`{3,}|~{3,})[^`\n]*\n)|(?P<comment><!--)|(?P<raw><(?P<rawname>pre|script|style)\b[^<>]*>)"
    rf"|(?P<env>\\begin\{{(?P<envname>verbatim|lstlisting|{_FORMULA_ENV})\*?\}})|(?P<display>\$\$(?=[^$])|\\\[|\\\()"
    r"|(?P<dollar>(?<![\\$\w])\$(?=[^\s$])(?:[^$\n\\]|\\.|\n(?![ \t]*(?:\n|\Z)))*?(?<=[^\s\\])\$(?![\d$]))"
    r"|(?P<ticks>`+)|(?P<wikilink>\[\[(?P<target>[^\[\]\n|]+)(?:\|(?P<label>[^\[\]\n]*))?\]\])"
    r"|(?P<tag></?(?P<name>[A-Za-z][A-Za-z0-9-]*)(?P<attrs>(?:\s+[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*)\s*/?>)"
    r"|(?P<ref>&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});)",
    re.M,
)
_FENCE_END = re.compile(r"^[ ]{0,3}(?:>[ ]?)?(?P<mark>`{3,}|~{3,})[`~]*[ \t]*$", re.M)
_GAP = re.compile(r"\n[ \t]*\n")
_START = re.compile(r"[<`~$\\\[&]")
_FENCE_LEAD = re.compile(r"[ ]{0,3}(?:>[ ]?)?")
_HINT = re.compile(r"[*_`#<>\[{$\\=~&|]")
_PH = re.compile("\ue000(\\d+)\ue001")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_BRACES = re.compile(r"(?P<cmd>\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{)|\{\{|\}\}|\{|\}")
_BUSY = re.compile(r"[\[{*_~\\]|''")
#: Tokens that matter within a paragraph.
_TOKEN = re.compile(
    r"\\(?P<cmd>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{|\\.|(?P<foot>\[\^[^\]\s]+\]:?)|(?P<ext>\[(?:https?|ftp|mailto):[^\s\]]+[ \t]+(?=[^\s\]]))"
    r"|(?P<magic>__[A-Z]{3,}__)|(?P<bracket>!\[|\[)|(?P<end>\])|(?P<brace>\{)|(?P<close>\})|(?P<run>\*+|_+|~+|'{2,})|(?P<nl>\n)"
)
_DEST = re.compile(r"\((?:[^()\n]|\([^()\n]*\))*\)|\[[^\[\]\n]*\]")
_ATX = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^[ ]{0,3}(=+|-{2,})[ \t]*$")
_WHEAD = re.compile(r"^(={2,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
_QUOTE = re.compile(r"^[ ]{0,3}>(?:[ ]?)(.*)$")
_ITEM = re.compile(r"^([ \t]*)([-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_TASK = re.compile(r"^\[([ xX])\][ \t]+(.*)$")
_RULE = re.compile(r"^[ ]{0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_SEP = re.compile(r"^[ ]{0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEF = re.compile(r"^[ ]{0,3}\[([^\]^\n][^\]\n]*)\]:[ \t]*(\S+).*$")
_REDIRECT = re.compile(r"^#REDIRECT\b[: ]*", re.I)
_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+)\*?\}(?:\[[^\]\n]*\])?")
_TABULAR = re.compile(r"\\begin\{(?:tabular|tabularx|longtable|array)\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*")
_TABULAR_END = re.compile(r"\\end\{(?:tabular|tabularx|longtable|array)\*?\}")
_SECTION = re.compile(r"^[ \t]*\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{((?:[^{}]|\{[^{}]*\})*)\}[ \t]*")
_TEXITEM = re.compile(r"^[ \t]*\\item(?![A-Za-z])(?:\[([^\]]*)\])?[ \t]*(.*)$")
_TEXLISTS = ("itemize", "enumerate", "description")


def _attributes(attrs: str) -> dict[str, str]:
    """Attribute names in lower case with their values; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _hides(attributes: dict[str, str]) -> bool:
    """Whether an element with these attributes isn't shown."""
    if "hidden" in attributes:
        return True
    for part in attributes.get("style", "").lower().split(";"):
        name, _, value = part.partition(":")
        if (name.strip(), value.replace("!important", "").strip()) in (("display", "none"), ("visibility", "hidden"), ("visibility", "collapse")):
            return True
    return False


class _Node:
    __slots__ = ("tag", "kids", "mark", "level", "hidden", "span")

    def __init__(self, tag: str, mark: str = "", level: int = 0, hidden: bool = False, span: int = 1):
        self.tag, self.kids, self.mark, self.level, self.hidden, self.span = tag, [], mark, level, hidden or tag in HIDDEN, span


class _Opaque:
    """Finds opaque constructs; what it holds stands in the text as numbered marks."""

    def __init__(self, text: str, families: set[str]):
        self.text, self.families = text, families
        self.held: list[tuple] = []
        self.places: list[tuple[int, int]] = []  # where in the text they stood
        self.gone: dict[str, int] = {}  # closers that aren't found from a position on
        self.gaps = [m.start() for m in _GAP.finditer(text)]
        self.runs: dict[int, list[int]] | None = None

    def find(self, closer: str, at: int) -> int:
        if self.gone.get(closer, len(self.text) + 1) <= at:
            return -1
        found = self.text.find(closer, at)
        if found < 0:
            self.gone[closer] = at
        return found

    def search(self, pattern: str, at: int) -> re.Match | None:
        if self.gone.get(pattern, len(self.text) + 1) <= at:
            return None
        found = re.compile(pattern, re.I).search(self.text, at)
        if found is None:
            self.gone[pattern] = at
        return found

    def parted(self, a: int, b: int) -> bool:
        """Whether an empty line stands between two places."""
        k = bisect.bisect_left(self.gaps, a)
        return k < len(self.gaps) and self.gaps[k] < b

    def begin(self, at: int, floor: int) -> re.Match | None:
        """What may begin at a character that opens something; a fence begins with its line."""
        text = self.text
        if text[at] in "`~":
            line = text.rfind("\n", max(0, at - 8), at) + 1
            if (line or at <= 8) and line >= floor and _FENCE_LEAD.fullmatch(text, line, at) and (m := _OPEN.match(text, line)) and m["fence"] is not None:
                return m
        return _OPEN.match(text, at)

    def replaced(self) -> str:
        text, out, at, seek = self.text, [], 0, 0
        while s := _START.search(text, seek):
            m = self.begin(s.start(), at)
            end, item = self.read(m) if m is not None else (s.start() + 1, None)
            if item is None:
                seek = end
                continue
            out.append(text[at : m.start()])
            out.append(f"\ue000{len(self.held)}\ue001")
            self.held.append(item)
            self.places.append((m.start(), end))
            at = seek = end
        out.append(text[at:])
        return "".join(out)

    def read(self, m: re.Match) -> tuple[int, tuple | None]:
        """Where the construct ends and what is held of it; None if it is none, and where to look on."""
        text, n, e = self.text, len(self.text), m.end()
        if m["fence"] is not None:
            self.families.add("markdown")
            mark = m["mark"]
            for f in _FENCE_END.finditer(text, e):
                if f["mark"].startswith(mark):
                    return f.end(), ("code", text[e : f.start()])
            return n, ("code", text[e:])
        if m["ticks"] is not None:
            size = len(m["ticks"])
            if self.runs is None:
                self.runs = {}
                for r in re.finditer("`+", text):
                    self.runs.setdefault(r.end() - r.start(), []).append(r.start())
            own = self.runs.get(size, ())
            k = bisect.bisect_left(own, e)
            if k < len(own) and not self.parted(e, own[k]):
                self.families.add("markdown")
                return own[k] + size, ("span", text[e : own[k]].replace("\n", " "))
            return e, None
        if m["comment"] is not None:
            self.families.add("html")
            end = self.find("-->", e)
            return (end + 3 if end >= 0 else n), ("text", "")
        if m["raw"] is not None:
            self.families.add("html")
            name = m["rawname"]
            end = self.search(rf"</{name}\s*>", e)
            inner = text[e : end.start() if end else n]
            shown = ("code", html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", inner))) if name == "pre" and not _hides(_attributes(m["raw"][4:-1])) else ("text", "")
            return (end.end() if end else n), shown
        if m["env"] is not None:
            self.families.add("latex")
            name = m["envname"]
            end = self.search(rf"\\end\{{{name}\*?\}}", e)
            stop = end.end() if end else n
            return stop, ("code", text[e : end.start() if end else n]) if name in ("verbatim", "lstlisting") else ("math", text[m.start() : stop])
        if m["display"] is not None:
            closer = {"$$": "$$", "\\[": "\\]", "\\(": "\\)"}[m["display"]]
            end = self.find(closer, e)
            if end < 0 or self.parted(e, end):
                return e, None
            self.families.add("latex")
            return end + 2, ("math", text[m.start() : end + 2])
        if m["dollar"] is not None:
            self.families.add("latex")
            return e, ("math", m[0])
        if m["wikilink"] is not None:
            self.families.add("wiki")
            target = m["target"].strip()
            quiet = re.match(r"(?i)(category|file|image|media)\s*:", target)
            label = m["label"].rpartition("|")[2] if m["label"] is not None else target
            return e, ("text", "" if quiet and m["label"] is None else label)
        if m["tag"] is not None:
            self.families.add("html")
            return e, ("tag", m["name"].lower(), m[0].startswith("</"), m[0].endswith("/>"), m["attrs"])
        if (shown := html.unescape(m[0])) == m[0]:
            return e, None
        self.families.add("html")
        return e, ("text", " " if shown == "\xa0" else shown)


def _without_templates(text: str) -> tuple[str, bool]:
    """The text without balanced {{...}}, which may nest and span lines, and whether there was one."""
    opened: list[tuple[str, int]] = []
    counts: Counter[str] = Counter()
    dropped: list[tuple[int, int]] = []
    at = 0
    while m := _BRACES.search(text, at):
        at, token = m.end(), m[0]
        if m["cmd"] is not None:
            opened.append(("{", m.start()))
            counts["{"] += 1
        elif token in ("{{", "{"):
            opened.append((token, m.start()))
            counts[token] += 1
        else:
            want = "{{" if token == "}}" and opened and opened[-1][0] == "{{" else "{"
            if want == "{" and token == "}}":
                at -= 1  # one brace only
            if not counts[want]:
                continue
            while True:
                kind, start = opened.pop()
                counts[kind] -= 1
                if kind == want:
                    break
            if want == "{{":
                while dropped and dropped[-1][0] > start:
                    dropped.pop()
                dropped.append((start, at))
    if not dropped:
        return text, False
    out, last = [], 0
    for a, b in dropped:
        out.append(text[last:a])
        last = b
    out.append(text[last:])
    return "".join(out), True


_BRACKETS = re.compile(r"\\.|(?P<foot>\[\^[^\]\s]+\])|(?P<ext>\[(?:https?|ftp|mailto):[^\s\]]+[ \t]+(?=[^\s\]]))|(?P<open>!\[|\[)|(?P<end>\])")


class _Inline:
    """Reads a paragraph: what its constructs show, marks of opaque ones left in; brackets first, then one pass with one stack."""

    def __init__(self, text: str, families: set[str]):
        self.text, self.families = text, families
        self.out: list[str] = []
        self.stack: list[tuple] = []  # (kind, place in out, extra)
        self.counts: Counter = Counter()  # of the kinds open within the innermost link
        self.outer: list[Counter] = []
        self.command: tuple | None = None  # (end, name, ranges of the arguments so far) of the command just closed

    def links(self) -> tuple[dict[int, str], dict[int, int]]:
        """Where links, images and labelled addresses begin, with their family, and where their brackets end, with the end of their target."""
        text, begins, ends = self.text, {}, {}
        opened: list[tuple] = []
        for m in _BRACKETS.finditer(text):
            if m["ext"] is not None:
                opened.append((m.start(), m.end(), "wiki"))
            elif m["open"] is not None:
                before = text[m.start() - 1] if m.start() else " "
                fits = m[0] == "![" or not (before in "!]_" or before.isalnum())
                opened.append((m.start(), m.end(), "markdown" if fits else None))
            elif m["end"] is not None and opened:
                start, inner, family = opened.pop()
                if family == "wiki":
                    begins[start], ends[m.start()] = family, m.end()
                elif family and (m.start() > inner or text[start] == "!") and (dest := _DEST.match(text, m.end())):
                    begins[start], ends[m.start()] = family, dest.end()
        return begins, ends

    def push(self, kind, literal: str, extra=None) -> None:
        self.stack.append((kind, len(self.out), extra))
        self.counts[kind] += 1
        self.out.append(literal)

    def pop(self, kind) -> tuple | None:
        """The nearest open thing of a kind within the innermost link; what stands above it was plain text."""
        if not self.counts[kind]:
            return None
        while True:
            top = self.stack.pop()
            self.counts[top[0]] -= 1
            if top[0] == kind:
                return top

    def shown(self) -> str:
        text, at, line = self.text, 0, 0
        begins, ends = self.links() if "[" in text else ({}, {})
        while m := _TOKEN.search(text, at):
            self.out.append(text[at : m.start()])
            at = m.end()
            kind = m.lastgroup
            if kind == "nl":
                line += 1
                self.out.append("\n")
            elif kind == "run":
                self.delimiter(m, line)
            elif kind == "cmd":
                self.push("{", m[0], (m["cmd"], []))
            elif kind == "brace":
                after = self.command if self.command and self.command[0] == m.start() else None
                self.push("{", "{", after[1:] if after else None)
            elif kind == "close":
                self.close(at)
            elif kind in ("bracket", "ext") and m.start() in begins:
                self.families.add(begins[m.start()])
                self.stack.append(("[", len(self.out), None))
                self.outer.append(self.counts)
                self.counts = Counter()
            elif kind == "end" and m.start() in ends:
                while self.stack.pop()[0] != "[":
                    pass
                self.counts = self.outer.pop()
                at = ends[m.start()]
            elif kind == "foot":
                self.families.add("markdown")
            elif kind == "magic":
                self.families.add("wiki")
            else:
                self.out.append(m[0])
        self.out.append(text[at:])
        return "".join(self.out)

    def delimiter(self, m: re.Match, line: int) -> None:
        text, run, s, e = self.text, m[0], m.start(), m.end()
        before, after = text[s - 1] if s else " ", text[e] if e < len(text) else " "
        n, char = len(run), run[0]
        opens, closes = not after.isspace(), not before.isspace() and before != "\\"
        kind: tuple = (char, n)
        if char == "'":
            kind, fits, family = ("'", line), n <= 5, "wiki"  # ends with its line
        else:
            fits, family = (n == 2 if char == "~" else n <= 3), "markdown"
            opens = opens and before != "\\"
            if char == "_":
                opens, closes = opens and not (before == "_" or before.isalnum()), closes and not (after == "_" or after.isalnum())
        if fits and closes and (found := self.pop(kind)):
            self.families.add(family)
            self.out[found[1]] = ""
        elif fits and opens:
            self.push(kind, run)
        else:
            self.out.append(run)

    def close(self, at: int) -> None:
        """Ends an argument of a command, or is a plain brace."""
        found = self.pop("{")
        if found is None or found[2] is None:
            self.out.append("}")
            return
        _, place, (name, arguments) = found
        self.families.add("latex")
        self.out[place] = " " if arguments else ""
        arguments.append((place, len(self.out)))
        hidden = arguments if name in SILENT else arguments[:-1] if name in LAST_SHOWN else ()
        for a, b in hidden:
            self.out[a:b] = [""] * (b - a)
        if name in LAST_SHOWN:
            self.out[place] = ""
        self.command = (at, name, arguments)


class _Builder:
    """Reads one text into a tree; `families` are those of the constructs it met."""

    def __init__(self, text: str):
        self.families: set[str] = set()
        self.root = _Node("root")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}  # where in the stack elements of a name are open
        self.lists: list[list] = []  # open LaTeX lists: kind, items so far
        if "\ue000" in text or "\ue001" in text:
            text = text.replace("\ue000", "").replace("\ue001", "")
        opaque = _Opaque(text, self.families)
        text, self.held = opaque.replaced(), opaque.held
        if "{{" in text:
            text, any_template = _without_templates(text)
            if any_template:
                self.families.add("wiki")
        self.lines(text)

    # -- elements
    def cut(self, at: int) -> None:
        """Close all elements from a place in the stack on."""
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def open(self, tag: str, mark: str = "", level: int = 0, hidden: bool = False, span: int = 1) -> None:
        if tag in IMPLIED:
            ends, scopes = IMPLIED[tag]
            floor = max((own[-1] for s in scopes if (own := self.places.get(s))), default=0)
            above = [own[k] for e in ends if (own := self.places.get(e)) and (k := bisect.bisect_right(own, floor)) < len(own)]
            if above:
                self.cut(min(above))
        elif tag in BLOCK:
            at = len(self.stack) - 1
            while at > 0 and self.stack[at].tag not in BLOCK and self.stack[at].tag != "mdli":
                at -= 1
            if self.stack[at].tag == "p":
                self.cut(at)
        node = _Node(tag, mark, level, hidden, span)
        self.stack[-1].kids.append(node)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, tag: str) -> None:
        if own := self.places.get(tag):
            self.cut(own[-1])

    def leaf(self, tag: str, text: str, level: int = 0) -> None:
        node = _Node(tag, "", level)
        node.kids.append(text)
        self.stack[-1].kids.append(node)

    def text(self, s: str) -> None:
        if s:
            self.stack[-1].kids.append(s)

    def tag(self, name: str, closing: bool, void: bool, attrs: str) -> None:
        if closing:
            self.close(name)
        elif name == "br":
            self.text("\n")
        elif name == "img":
            attributes = _attributes(attrs)
            if not _hides(attributes):
                self.text(attributes.get("alt", ""))
        elif name == "hr":
            self.leaf("p", "")
        elif name not in VOID:
            attributes = _attributes(attrs) if attrs else {}
            level = int(name[1]) if len(name) == 2 and name[0] == "h" and name[1] in "123456" else 0
            span = attributes.get("colspan", "1")
            self.open(name, "", level, _hides(attributes), min(1000, int(span)) if span.isdecimal() and name in ("td", "th") else 1)
            if void:
                self.close(name)

    def inline(self, s: str) -> None:
        self.runs(_Inline(s, self.families).shown() if _BUSY.search(s) else s)

    def runs(self, s: str) -> None:
        """Text with the held constructs put back."""
        if "\ue000" not in s:
            self.text(s)
            return
        at = 0
        for m in _PH.finditer(s):
            self.text(s[at : m.start()])
            kind, *rest = self.held[int(m[1])]
            if kind == "text":
                self.text(rest[0])
            elif kind == "tag":
                self.tag(*rest)
            else:
                self.leaf({"span": "code", "code": "pre", "math": "math"}[kind], rest[0])
            at = m.end()
        self.text(s[at:])

    # -- blocks
    def heading(self, level: int, s: str) -> None:
        self.open(f"h{level}", level=level)
        self.inline(s)
        self.close(f"h{level}")

    def item(self, mark: str, level: int, body: str) -> None:
        self.open("mdli", mark, level)
        self.inline(body)
        self.close("mdli")

    def table(self, rows: list[list[str]]) -> None:
        self.open("table")
        for row in rows:
            self.open("tr")
            for cell in row:
                self.open("td")
                self.inline(cell.strip())
                self.close("td")
            self.close("tr")
        self.close("table")

    def environments(self, line: str) -> str:
        """The line without begins and ends of environments; open lists are remembered."""
        self.families.add("latex")
        for m in _ENV.finditer(line):
            if m[2] in _TEXLISTS:
                if m[1] == "begin":
                    self.lists.append([m[2], 0])
                elif self.lists:
                    self.lists.pop()
        return _ENV.sub("", line)

    def lines(self, text: str) -> None:
        lines = text.split("\n")
        i, n, last = 0, len(lines), len(lines) - 1
        paragraph: list[str] = []

        def flush() -> None:
            if paragraph:
                self.inline("".join(paragraph))
                paragraph.clear()

        while i < n:
            line = lines[i]
            nl = "\n" if i < last else ""
            i += 1
            if not line or line.isspace():
                flush()
                self.text(nl)
                continue
            first = line.lstrip()[0]
            if first == "\ue000" or first.isalpha():
                pass
            elif first == "#":
                if m := _ATX.match(line):
                    flush()
                    self.families.add("markdown")
                    self.heading(len(m[1]), m[2])
                    continue
                if m := _REDIRECT.match(line):
                    flush()
                    self.families.add("wiki")
                    self.inline(line[m.end() :])
                    self.text(nl)
                    continue
            elif first == "=" and (m := _WHEAD.match(line)):
                flush()
                self.families.add("wiki")
                self.heading(len(m[1]), m[2])
                continue
            elif first == ">" and (m := _QUOTE.match(line)):
                flush()
                self.families.add("markdown")
                self.open("blockquote")
                self.inline(re.sub(r"^\[!\w+\][+-]?[ \t]*", "", m[1]))
                self.close("blockquote")
                continue
            elif first == "{" and line.startswith("{|"):
                flush()
                self.families.add("wiki")
                rows: list[list[str]] = [[]]
                while i < n and not lines[i].startswith("|}"):
                    row = lines[i].strip()
                    if row.startswith("|-"):
                        rows.append([])
                    elif row.startswith(("|", "!")):
                        rows[-1] += re.split(r"\|\||!!", row[1:].lstrip("+"))
                    elif row and rows[-1]:
                        rows[-1][-1] += " " + row
                    i += 1
                i += i < n
                self.table([r for r in rows if r])
                continue
            elif first == "[" and (m := _DEF.match(line)):
                flush()
                self.families.add("markdown")
                continue
            if first == "|" or ("|" in line and i < n and "-" in lines[i] and "|" in lines[i] and _SEP.match(lines[i])):
                if (line.count("|") > 2 and line.lstrip()[0] == "|" and line.rstrip()[-1] == "|") or (i < n and "|" in lines[i] and _SEP.match(lines[i])):
                    flush()
                    self.families.add("markdown")
                    rows, i = [], i - 1
                    while i < n and "|" in lines[i]:
                        if not _SEP.match(lines[i]):
                            rows.append(lines[i].strip().strip("|").split("|"))
                        i += 1
                    self.table(rows)
                    continue
            if _RULE.match(line):
                flush()
                self.leaf("p", "")
                continue
            if m := _ITEM.match(line):
                flush()
                body = m[3]
                mark = m[2] if m[2][0].isdigit() else "-"
                if t := _TASK.match(body):
                    self.families.add("markdown")
                    mark, body = f"- [{t[1].lower()}]", t[2]
                self.item(mark, len(m[1].expandtabs(4)) // 2, body)
                continue
            if first == "\\":
                if m := _SECTION.match(line):
                    flush()
                    self.families.add("latex")
                    self.heading(LEVEL[m[1]], m[2])
                    line = line[m.end() :]
                    if not line.strip():
                        continue
                elif m := _TEXITEM.match(line):
                    flush()
                    body, mark = m[2], m[1] or "-"
                    if self.lists:
                        self.lists[-1][1] += 1
                        mark = m[1] or (f"{self.lists[-1][1]}." if self.lists[-1][0] == "enumerate" else "-")
                    level = max(0, len(self.lists) - 1)
                    self.item(mark, level, self.environments(body) if _ENV.search(body) else body)
                    continue
            if "\\begin{" in line and (m := _TABULAR.search(line)):
                self.families.add("latex")
                paragraph.append(line[: m.start()])
                flush()
                body, rest = [line[m.end() :]], None
                while (end := _TABULAR_END.search(body[-1])) is None and i < n:
                    body.append(lines[i])
                    i += 1
                if end:
                    rest = body[-1][end.end() :]
                    body[-1] = body[-1][: end.start()]
                cells = re.sub(r"\\(?:hline|toprule|midrule|bottomrule)(?![A-Za-z])|\\cline\{[^{}]*\}", "", "\n".join(body))
                self.table([[c for c in re.split(r"(?<!\\)&", row)] for row in re.split(r"\\\\(?:\[[^\]\n]*\])?", cells) if row.strip()])
                if rest and rest.strip():
                    i -= 1
                    lines[i] = rest
                continue
            if "\\" in line and _ENV.search(line):
                bare = self.environments(line)
                if not bare.strip():
                    flush()
                    continue
                line = bare
            if i < n and lines[i] and lines[i].lstrip(" ")[:1] in ("=", "-") and (m := _SETEXT.match(lines[i])) and (m[1][0] == "=" or len(m[1]) > 2):
                flush()
                self.families.add("markdown")
                self.heading(1 if m[1][0] == "=" else 2, line.strip())
                i += 1
                continue
            paragraph += (line, nl)
        flush()


def _flat(node: _Node) -> str:
    """The visible text of an element on one line; blocks and cells stay apart."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.hidden:
            apart = x is not node and (x.tag in BLOCK or x.tag == "mdli")
            if apart:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.kids))
    return re.sub(r"\s+", " ", "".join(out)).strip()


def _table(node: _Node, prose: bool) -> str:
    rows = []
    for r in _rows(node):
        row: list[str] = []
        for c in r.kids:
            if isinstance(c, _Node) and not c.hidden:
                row += [_flat(c), *[""] * (c.span - 1)]
        if any(row):
            rows.append(row)
    if prose:
        return "\v" + "\v".join("\v".join(filter(None, r)) for r in rows) + "\v"
    widths = [max(len(r[k]) for r in rows if k < len(r)) for k in range(max(map(len, rows), default=0))]
    return "\v" + "\n".join(" | ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows) + "\v"


def _render(root: _Node, prose: bool) -> list[str]:
    """Pieces of text; '\v' asks for a new line, once however often it is asked for."""
    out: list[str] = []
    todo: list[tuple] = [(x, 0, "") for x in reversed(root.kids)]
    while todo:
        kid, depth, number = todo.pop()
        if isinstance(kid, str):
            out.append(kid)
            continue
        tag = kid.tag
        if kid.hidden:
            continue
        if tag == "code":
            out.append(" " if prose else "".join(x if isinstance(x, str) else _flat(x) for x in kid.kids))
        elif tag == "math":
            out.append(" " if prose else "".join(x if isinstance(x, str) else _flat(x) for x in kid.kids))
        elif tag == "pre":
            if prose:
                out.append("\v")
            else:
                body = "".join(x if isinstance(x, str) else _flat(x) for x in kid.kids).strip("\n")
                out.append("\v" + "\n".join("    " + x for x in body.split("\n")) + "\v")
        elif kid.level and tag[0] == "h":
            out.append("\v" if prose else "\v" + "#" * kid.level + " " + _flat(kid) + "\v")
        elif tag == "table":
            out.append(_table(kid, prose))
        elif tag in ("ul", "ol"):
            count, own = 0, []
            for x in kid.kids:
                if isinstance(x, str):
                    if x.strip():
                        own.append((x, depth, ""))
                elif x.tag == "li":
                    count += not x.hidden
                    own.append((x, depth, "-" if tag == "ul" else f"{count}."))
                else:
                    own.append((x, depth, ""))
            todo.extend(reversed(own))
        else:
            item = tag in ("mdli", "li")
            block = item or tag == "p" or tag in BLOCK
            if item:
                out.append("\v" if prose else "\v" + "  " * max(kid.level, depth) + (number or kid.mark or "-") + " ")
            elif block:
                out.append("\v")
            if block:
                todo.append(("\v", 0, ""))
            todo.extend((x, depth + item, "") for x in reversed(kid.kids))
    return out


def _rows(table: _Node) -> Iterator[_Node]:
    todo = list(reversed(table.kids))
    while todo:
        x = todo.pop()
        if isinstance(x, _Node) and not x.hidden:
            if x.tag == "tr":
                yield x
            elif x.tag != "table":
                todo.extend(reversed(x.kids))


def _layout(pieces: list[str]) -> str:
    text = re.sub(r"(?:[ \t]*\v)+\n?", "\n", "".join(pieces))
    text = re.sub(r"[ \t]+\n", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    return text.strip("\n").rstrip()


def parse(text: str) -> tuple[_Node | None, set[str]]:
    """The tree and the families of a text; no tree if it holds no construct."""
    if not _HINT.search(text) and "''" not in text and "---" not in text:
        return None, set()
    builder = _Builder(text)
    return builder.root, builder.families


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """Clean text and the families of the markup that was in it."""
    if text is None:
        return None, []
    root, families = parse(text)
    if root is None or not families:
        return text, []
    return _layout(_render(root, False)), sorted(families)


def prose(text: str) -> str:
    """Running text only: without code, formulas and headings."""
    root, families = parse(text)
    if root is None or not families:
        return text
    return _layout(_render(root, True))


def without_opaque(text: str) -> str:
    """A text of the same length with blanks where code, formulas, tags and comments stand."""
    if not _START.search(text):
        return text
    opaque = _Opaque(text, set())
    opaque.replaced()
    out, at = [], 0
    for (a, b), item in zip(opaque.places, opaque.held):
        if item[0] != "text" or not item[1].strip():
            out += (text[at:a], " " * (b - a))
            at = b
    return "".join([*out, text[at:]])


def render_markup(df: DataFrame, key: str, text: str = "text_raw") -> DataFrame:
    """(key, clean_text, families) of every row of df; one pass, no shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            done = [clean(t) for t in pdf["_t"]]
            yield pd.DataFrame({"k": pdf["_k"], "clean_text": [a for a, _ in done], "families": [b for _, b in done]})

    return df.selectExpr(f"`{key}` as _k", f"`{text}` as _t").mapInPandas(run, f"k {kind}, clean_text string, families array<string>").withColumnRenamed("k", key)

"""The search language: parsing, planning and the needles of exact search. All of it is small driver-side data."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from inkwell.operators.exact import ALL, Needle
from inkwell.operators.filters import RowFilter, combine

# Words of the search language.
MODES = ("auto", "exact", "lexical", "semantic", "hybrid")
KEYS = ("folder", "path", "file", "ext", "tag", "title", "before", "after", "id")
_DAY_MS = 86_400_000
_NO_SPACE = re.compile(r"[฀-໿က-႟ក-៿々〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")


@dataclass(frozen=True)
class Query:
    raw: str
    terms: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()  # (file | title | id, value)
    filters: tuple[tuple[str, str | int], ...] = ()
    mode: str | None = None

    @property
    def has_content(self) -> bool:
        return bool(self.terms or self.phrases or self.fields)

    @property
    def metadata_only(self) -> bool:
        return bool(self.filters) and not self.has_content

    @property
    def content_text(self) -> str:
        """What is analysed and embedded: phrases, then terms, then field values."""
        return " ".join([*self.phrases, *self.terms, *(v for _, v in self.fields)])


def day_bound(value: str, before: bool) -> int | None:
    """Epoch milliseconds of a YYYY-MM-DD: its first for before, its last for after. Days past a month's end roll over."""
    m = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", value)
    if not m:
        return None
    year, month, day = map(int, m.groups())
    if not (1 <= month <= 12 and 1 <= day <= 31) or year < 1:
        return None
    start = datetime(year, month, 1, tzinfo=UTC) + timedelta(days=day - 1)
    ms = round((start - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1000
    return ms if before else ms + _DAY_MS - 1


_SCAN = re.compile(
    r"\s*(?P<neg>-(?=\S))?(?:"
    r'"(?P<phrase>[^"]*)(?:"|$)'
    r'|(?P<key>[A-Za-z]+):"(?P<quoted>[^"]*)(?:"|$)'
    r'|(?P<word>[^\s":]*:\S*|[^\s":]+)'
    r'|(?P<rest>\S))'
)


#: What a key's value means: the part of the query it goes to, and its reading; None if it has none, then the word is a term.
_READINGS: dict[str, tuple[str, Callable[[str], str | int | None]]] = {
    "folder": ("filters", str), "path": ("filters", str), "ext": ("filters", lambda v: v.removeprefix(".").lower()), "tag": ("filters", lambda v: v.removeprefix("#")),
    "before": ("filters", lambda v: day_bound(v, True)), "after": ("filters", lambda v: day_bound(v, False)), "file": ("fields", str), "title": ("fields", str), "id": ("fields", str),
}


def _pieces(text: str) -> Iterator[tuple[str, object]]:
    """The parts of a query text in order: (part, value)."""
    at = 0
    while (m := _SCAN.match(text, at)) and m.end() > at:
        at = m.end()
        sign = "excluded" if m["neg"] else None
        if m["phrase"] is not None:
            yield sign or "phrases", m["phrase"].strip()
            continue
        whole = m[0].strip()
        key, colon, value = (m["key"], ":", m["quoted"]) if m["key"] is not None else (m["word"] or "").partition(":")
        reading = _READINGS.get(key.lower()) if colon and not sign else None
        if reading is None:
            yield sign or "terms", whole.removeprefix("-") if sign else whole
        elif value.strip():
            part, read = reading
            meant = read(value.strip())
            yield ("terms", whole) if meant is None else (part, (key.lower(), meant))


def parse(raw: str) -> Query:
    """A query string to its parts. Unknown keys, bad dates and negated keys stay ordinary terms; a key without value says nothing."""
    text, mode = raw.strip(), None
    if m := re.match(rf"(?i)({'|'.join(MODES)}):\s*", text):
        mode, text = m[1].lower(), text[m.end() :]
    parts: dict[str, list] = {}
    for part, value in _pieces(text):
        if value:
            parts.setdefault(part, []).append(value)
    return Query(raw, **{part: tuple(values) for part, values in parts.items()}, mode=mode)


def row_filter(query: Query, base: RowFilter | None = None) -> RowFilter:
    of = lambda kind: [v for k, v in query.filters if k == kind]
    return combine(base, of("folder"), of("path"), of("tag"), of("ext"), min(of("before"), default=None), max(of("after"), default=None))


def split_identifier(token: str) -> list[str]:
    """As functions.text.split_identifier, for the few words of a query."""
    parts = []
    for piece in re.split(r"::|[./\-_]", token):
        word = ""
        for i, c in enumerate(piece):
            if word and _upper(c) and (not _upper(piece[i - 1]) and (_lower(piece[i - 1]) or unicodedata.category(piece[i - 1])[0] == "N") or _upper(piece[i - 1]) and i + 1 < len(piece) and _lower(piece[i + 1])):
                parts.append(word)
                word = ""
            word += c
        if word:
            parts.append(word)
    return parts


def _upper(c: str) -> bool:
    return unicodedata.category(c) == "Lu"


def _lower(c: str) -> bool:
    return unicodedata.category(c) == "Ll"


def is_precise(term: str) -> bool:
    return "/" in term or "::" in term or len(split_identifier(term)) >= 2


@dataclass(frozen=True)
class Plan:
    mode: str
    exact: bool
    lexical: bool
    semantic: bool
    semantic_factor: float = 1.0
    metadata_only: bool = False
    degraded: tuple[str, ...] = ()

    @property
    def label(self) -> str:
        if self.metadata_only:
            return "metadata"
        if self.exact and self.lexical and self.semantic:
            return "hybrid"
        return "+".join(n for n in ("exact", "lexical", "semantic") if getattr(self, n)) or "none"


#: What runs for a mode, and for the shapes of a query in auto mode; with the weight of semantic ranks.
_STAGES = {"exact": {"exact"}, "lexical": {"lexical"}, "semantic": {"semantic"}, "hybrid": {"exact", "lexical", "semantic"}}
_SHAPES = {"precise": ({"exact", "lexical"}, 1.0), "short_words": (_STAGES["hybrid"], 0.5), "question": (_STAGES["hybrid"], 1.0)}
#: What stands in if a stage can't run and none else was asked for.
_STAND_IN = {"semantic": {"exact", "lexical"}, "lexical": {"exact", "semantic"}}


def shape(query: Query) -> str:
    """precise, short_words or question."""
    looked_up = query.phrases or query.fields or any(is_precise(t) for t in query.terms)
    asks = set("?？") & set(query.raw) or len(query.terms) > 3 or sum(len(t) for t in query.terms if _NO_SPACE.search(t)) >= 6
    return "precise" if looked_up else "question" if asks else "short_words"


def plan(query: Query, requested: str = "auto", embedding: bool = True, lexical: bool = True, store: bool = True) -> Plan:
    """Which retrievers run. What a missing capability takes away is told, never silent."""
    mode = query.mode or requested
    notes = () if store else ("store_empty",)
    if not query.has_content:
        return Plan(mode, query.metadata_only, False, False, 1.0, query.metadata_only, notes)
    wanted, factor = _SHAPES[shape(query)] if mode == "auto" else (_STAGES[mode], 1.0)
    missing = [name for name, there in (("semantic", embedding), ("lexical", lexical)) if not there]
    for name in missing:
        if name in wanted:
            notes += (f"{name}_unavailable",)
            wanted = wanted - {name} or _STAND_IN[name] - ({"semantic"} & set(missing))
    return Plan(mode, *(name in wanted for name in ("exact", "lexical", "semantic")), factor, False, notes)


def needles(query: Query, explicit_exact: bool = False) -> list[Needle]:
    """What exact search looks for: phrases everywhere, keyed values in their fields, words if they are precise or exact was asked for."""
    where = {"title": ("title", "alias"), "file": ("filename", "path"), "id": ("text", "title", "filename")}
    out = [Needle(p, ALL) for p in query.phrases] + [Needle(v, where[k]) for k, v in query.fields]
    return out + [Needle(t, ALL) for t in query.terms if explicit_exact or is_precise(t)]

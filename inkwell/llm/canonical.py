"""Visually identical text with different characters, brought to one consistent form.

Steps: width and presentation forms to normal ones, invisible characters out, every space to U+0020, accents taken
apart; then scripts are resolved token by token, and accents put together again. Which letters look alike is read from
the public confusables data that come with Spark (ICU's spoof checker): letters of different scripts and the same case
with one skeleton are one shape. Each letter stands for the set of scripts in which its shape can be written.
Intersected over a token the sets tell how it can be spelled: in one script (that spelling is taken, which repairs
mixed-script tokens), in several (a whole-script confusable: the script that most of the value's tokens speak for is
taken, a token for all it can be in alike, in the order of PREFERENCE if they tell nothing) or in none (each letter is then put in its Latin look-alike). In
Japanese, where scripts mix within words, a letter whose shape is in several scripts takes that of the nearest letter
that is not, the one before it first. As the choice depends on looks alone, values that look the same get the same form.

Letter case, accents, other letters of the same script, word order and the number of spaces are visible and stay;
blanks at the end aren't. Joiners stay where they change what is seen (Arabic and Indic scripts, emoji).

Defined cases: null stays null and equals nothing; an empty value is a value. Repeated rows count once. Texts of
any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import cut

#: Decomposition tags of forms that look like what they decompose to.
_FORMS = frozenset(("<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>"))
PREFERENCE = ("latin", "cyrillic", "greek")
CACHE = 200_000
# Letters that the data call confusable with one of another script though the two are told apart at sight.
APART = frozenset("гᴦσ")
_EAST = frozenset(("hiragana", "katakana", "cjk"))
_JOINED = re.compile("(?:[\u0600-\u08ff\u0900-\u0dff\u1780-\u17ff\u2600-\u27bf\ufe0f\U0001f000-\U0001faff])[\u200c\u200d]$")
_WORD = re.compile(r"(?:(?![\u1100-\u11ff\u2e80-\ua4cf\uac00-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff])[^\W\d_]|[\u0300-\u036f])+")
_CLUSTER = re.compile(r"[\u1100-\u115f][\u1160-\u11ff]*|(?s:.)[\u0300-\u036f\u3099\u309a]*")
_EAST_RUN = re.compile(r"[\u3041-\u3096\u3099\u309a\u30a1-\u30fc\u3400-\u4dbf\u4e00-\u9fff]+")


def _preferred(script: str) -> tuple[int, str]:
    return PREFERENCE.index(script) if script in PREFERENCE else len(PREFERENCE), script


def _script(ch: str) -> str:
    """The script of a letter, which its name in the character database begins with."""
    return unicodedata.name(ch, "?").split()[0].lower()


@lru_cache(1)
def _single() -> dict[int, str | None]:
    """What single characters become, by rule from the character database."""
    table: dict[int, str | None] = {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        category = unicodedata.category(ch)
        if category in ("Cn", "Co", "Cs"):
            continue
        tag, _, _ = unicodedata.decomposition(ch).partition(" ")
        if category == "Zs":
            table[code] = " "
        elif category == "Cf" and code not in (0x200C, 0x200D) and not 0x600 <= code <= 0x8FF:
            table[code] = None
        elif 0xFE00 <= code <= 0xFE0E or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            table[code] = None
        elif tag in _FORMS or 0xFB00 <= code <= 0xFB06:
            table[code] = unicodedata.normalize("NFKC", ch)
    return table


@lru_cache(1)
def _any_single() -> re.Pattern:
    """Any character that becomes another one."""
    codes, parts = sorted(_single()), []
    for code in codes:
        if parts and parts[-1][1] == code - 1:
            parts[-1][1] = code
        else:
            parts.append([code, code])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in parts) + "]")


def _joiners(text: str) -> str:
    out = []
    for ch in text:
        if ch in "\u200c\u200d" and not _JOINED.match(("".join(out[-1:]) or " ") + ch):
            continue
        out.append(ch)
    return "".join(out)


class Canonical:
    """The form of a text; small (a few hundred shapes), so it goes to the workers with the task.

    shapes: for each look (skeleton and case) the letter of each script that is written so.
    """

    def __init__(self, shapes: list[dict[str, str]], looks: dict[str, int]):
        self.shapes, self.looks = shapes, looks
        self.east = {ch for ch, i in looks.items() if shapes[i].keys() <= _EAST}
        self.foreign = re.compile("[" + "".join(sorted(ch for ch in looks.keys() - self.east if not ch.isascii())) + r"\u0370-\u03ff\u0400-\u058f\u1f00-\u1fff]")
        voiced = [ch for ch in map(chr, range(0x3041, 0x3100)) if unicodedata.normalize("NFD", ch)[0] in self.east]
        self.any_east = re.compile("[" + "".join(sorted(self.east | set(voiced))) + "]" if self.east else r"(?!)")
        self.cache: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def scripts(self, token: str) -> tuple[str, ...]:
        """The scripts a token can be spelled in, most preferred first."""
        if (known := self.cache.get(token)) is not None:
            return known
        left: set[str] | None = None
        for ch in token:
            if not "\u0300" <= ch <= "\u036f":
                at = self.looks.get(ch)
                own = {_script(ch)} if at is None else self.shapes[at].keys()
                left = set(own) if left is None else left & own
        out = tuple(sorted(left or (), key=_preferred))
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.cache[token] = out
        return out

    def spelled(self, token: str, script: str | None) -> str:
        """A token in one script; without one each letter in the most preferred script of its shape."""
        out = []
        for ch in token:
            at = self.looks.get(ch)
            if at is not None and (script is None or _script(ch) != script):
                shape = self.shapes[at]
                ch = shape[script or min(shape, key=_preferred)]
            out.append(ch)
        return "".join(out)

    def eastern(self, m: re.Match) -> str:
        run = m[0]
        if not self.any_east.search(run):
            return run
        sure = [None if ch in self.east or ch in "\u3099\u309aー" else _script(ch) for ch in run]
        before: list[str | None] = []
        last = None
        for s in sure:
            last = s or last
            before.append(last)
        out, after = [], None
        for ch, s, left in zip(reversed(run), reversed(sure), reversed(before)):
            after = s or after
            if ch in self.east:
                shape = self.shapes[self.looks[ch]]
                ch = next((shape[x] for x in (left, after, "cjk", "katakana", "hiragana") if x in shape), ch)
            out.append(ch)
        return "".join(reversed(out))

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        if text.isascii():
            return text.rstrip(" ")
        if _any_single().search(text):
            text = text.translate(_single())
        if "\u200c" in text or "\u200d" in text:
            text = _joiners(text)
        text = text.rstrip(" ")
        foreign, eastern = self.foreign.search(text), self.any_east.search(text)
        if not foreign and not eastern:
            return unicodedata.normalize("NFC", text)
        text = unicodedata.normalize("NFD", text)
        if foreign:
            known: Counter[str] = Counter()
            for token in _WORD.findall(text):
                scripts = self.scripts(token)
                for script in scripts:
                    known[script] += 1 / len(scripts)

            def respell(m: re.Match) -> str:
                scripts = self.scripts(m[0])
                return self.spelled(m[0], max(scripts, key=known.__getitem__) if scripts else None)

            text = _WORD.sub(respell, text)
        if eastern:
            text = _EAST_RUN.sub(self.eastern, text)
        return unicodedata.normalize("NFC", text)

    def origins(self, text: str) -> list[int] | None:
        """For each character of the form the place it comes from, and at the end the length; None if they are the same places."""
        if len(self(text)) == len(text) and unicodedata.is_normalized("NFC", text) and not _any_single().search(text):
            return None
        out: list[int] = []
        for m in _CLUSTER.finditer(text):
            kept = unicodedata.normalize("NFC", m[0].translate(_single()).replace("\u200c", "").replace("\u200d", ""))
            out += [m.start()] * len(kept)
        return [*out, len(text)]


_KNOWN: dict[str, Canonical] = {}


def canonicalizer() -> Canonical:
    """The form of texts by the confusables data of the running Spark; read once, in one call."""
    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("a Spark session has to run: the confusables data come with it")
    if not _KNOWN:
        letters = [ch for ch in map(chr, (*range(0x41, 0xD800), *range(0x10000, 0x1F000))) if unicodedata.category(ch) in ("Lu", "Ll") or _script(ch) in _EAST]
        letters = [ch for ch in letters if unicodedata.normalize("NFD", ch) == ch and ord(ch) not in _single() and ch not in APART]
        skeletons = context._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
        groups: dict[tuple, list[str]] = defaultdict(list)
        for ch, skeleton in zip(letters, skeletons, strict=True):
            groups[skeleton, "east" if _script(ch) in _EAST else unicodedata.category(ch)].append(ch)
        shapes, looks = [], {}
        for _, own in sorted(groups.items(), key=lambda x: x[1][0]):
            by_script: dict[str, str] = {}
            for ch in own:  # by code point: a script's first letter of a shape is its plain one
                script = _script(ch)
                if script != "latin" or ch.isascii():
                    by_script.setdefault(script, ch)
            if len(by_script) > 1:
                looks |= {ch: len(shapes) for ch in own if _script(ch) != "latin" or ch.isascii()}
                shapes.append(by_script)
        _KNOWN["icu"] = Canonical(shapes, looks)
    return _KNOWN["icu"]


def canonical(text: str | None) -> str | None:
    """The form of one text, on the driver."""
    return canonicalizer()(text)


def canonical_column(df: DataFrame, column: str, to: str = "canonical") -> DataFrame:
    """df with the canonical form of a column; no shuffle."""

    canonical = canonicalizer()

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return pd.Series([canonical(x) for x in s], dtype=object)

    return df.withColumn(to, form(F.col(f"`{column}`")))


def canonical_keys(df: DataFrame) -> DataFrame:
    """df (field_name, key, value) to (field_name, key, form, own): 128-bit names of the canonical form and of the value.

    Only names leave the workers, so the exchange that follows doesn't carry texts.
    """

    canonical = canonicalizer()

    def name(text: str) -> bytes:
        return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            own = [name(x) for x in pdf["value"]]
            forms = [canonical(x) for x in pdf["value"]]
            yield pd.DataFrame({"field_name": pdf["field_name"], "key": pdf["key"], "form": [o if f == v else name(f) for f, v, o in zip(forms, pdf["value"], own)], "own": own})

    return df.where("value is not null and key is not null").select("field_name", "key", "value").mapInPandas(run, "field_name string, key string, form binary, own binary")


def look_alikes(df: DataFrame) -> DataFrame:
    """Pairs (field_name, key_a, key_b), key_a < key_b, of records whose values look the same but differ.

    Spellings of one form are paired first, then expanded to their records, so equal strings never meet each
    other, however many records share one; the join costs what its result holds.
    """
    named = cut(canonical_keys(df).distinct(), "forms")  # read four times below
    spellings = named.select("field_name", "form", "own").distinct()
    several = spellings.groupBy("field_name", "form").count().where("count > 1").drop("count")
    spellings = spellings.join(several, ["field_name", "form"], "left_semi")
    two = spellings.withColumnRenamed("own", "own_a").join(spellings.withColumnRenamed("own", "own_b"), ["field_name", "form"]).where("own_a < own_b").select("field_name", "own_a", "own_b")
    left = two.join(named.select("field_name", F.col("own").alias("own_a"), F.col("key").alias("x")), ["field_name", "own_a"])
    both = left.join(named.select("field_name", F.col("own").alias("own_b"), F.col("key").alias("y")), ["field_name", "own_b"])
    return both.where("x <> y").select("field_name", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def vault_values(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(field_name, key, value) of titles and paths of sources and texts of chunks."""
    pick = [F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("title_raw", "path_raw")]
    own = sources.select(F.col("source_id").alias("key"), F.explode(F.array(*pick)).alias("v")).select("v.field_name", "key", "v.value")
    return own.unionByName(chunks.select(F.lit("text_raw").alias("field_name"), F.col("row_id").alias("key"), F.col("text_raw").alias("value")))

"""Text primitives as native column expressions (regular expressions and higher-order functions stay in the JVM).

Nulls: every function of a null is null, unless it returns an array, which is then empty.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode scripts told apart, in this order.
SCRIPTS = ("Latin", "Han", "Hiragana", "Katakana", "Hangul", "Cyrillic", "Arabic", "Devanagari", "Thai", "Hebrew")
# Scripts whose runs are cut into character n-grams.
NGRAM_RUNS = (r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+", r"\p{IsHangul}+", r"\p{IsThai}+", r"\p{IsLao}+", r"\p{IsMyanmar}+", r"\p{IsKhmer}+")
NO_SPACE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}]"
# What an identifier is and where its words part.
IDENTIFIER = r"[\p{L}_][\p{L}\p{N}_]*(?:(?:::|[./-])[\p{L}\p{N}_]+)*"
SEPARATORS = r"::|[./\-_]"
CAMEL = r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else fold(x))


def fold(x: str) -> str:
    kept = "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c)[0] != "M")
    return unicodedata.normalize("NFC", kept)


def collapse_whitespace(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_column(text), r"(?U)\s+", " "))


def normalize_lexical(text: Column | str, nfkc: bool = True) -> Column:
    """Compatibility forms unified, lower case, whitespace collapsed. Plain ASCII never leaves the JVM."""
    t = _column(text)
    unified = F.when(t.rlike(r"[^\x00-\x7F]"), _nfkc(t)).otherwise(t) if nfkc else t
    return collapse_whitespace(F.lower(unified))


def fold_accents(text: Column | str) -> Column:
    t = _column(text)
    return F.when(t.rlike(r"[^\x00-\x7F]"), _fold(t)).otherwise(t)


def fold_case(text: Column | str, case_sensitive: bool) -> Column:
    return _column(text) if case_sensitive else F.lower(_column(text))


def split_identifier(token: Column | str) -> Column:
    """Word parts at separators and camel-case boundaries."""
    parts = F.flatten(F.transform(F.split(_column(token), SEPARATORS), lambda p: F.split(p, CAMEL)))
    return F.filter(parts, lambda p: p != "")


def is_compound(token: Column | str) -> Column:
    return F.size(split_identifier(token)) >= 2


def expand_identifier(token: Column | str) -> Column:
    """The token in lower case and, if it has parts: parts, joined, snake and kebab forms and joined segments."""
    t = _column(token)
    parts = F.transform(split_identifier(t), F.lower)
    segments = F.filter(F.transform(F.split(t, SEPARATORS), lambda s: F.filter(F.split(s, CAMEL), lambda p: p != "")), lambda ps: F.size(ps) >= 2)
    joined = F.transform(segments, lambda ps: F.lower(F.array_join(ps, "")))
    forms = F.array(F.array_join(parts, ""), F.array_join(parts, "_"), F.array_join(parts, "-"))
    return F.array_distinct(F.when(F.size(parts) >= 2, F.concat(F.array(F.lower(t)), parts, forms, joined)).otherwise(F.array(F.lower(t))))


def identifier_terms(text: Column | str) -> Column:
    """Expansions of the compound identifiers of a text, repeated as often as they occur."""
    tokens = F.regexp_extract_all(_column(text), F.lit(IDENTIFIER), F.lit(0))
    return F.coalesce(F.flatten(F.transform(F.filter(tokens, is_compound), expand_identifier)), F.array().cast("array<string>"))


def path_terms(path: Column | str) -> Column:
    """Folder names, file name, stem, extension and whole path, in lower case."""
    p = F.lower(F.regexp_replace(F.regexp_replace(_column(path), r"\\", "/"), "^/+", ""))
    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    name = F.element_at(segments, -1)
    dotted = name.rlike(r"^.+\.[^.]*$")
    stem = F.when(dotted, F.array(F.regexp_extract(name, r"(?s)^(.+)\.([^.]*)$", 1), F.regexp_extract(name, r"(?s)^(.+)\.([^.]*)$", 2))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(segments) > 0, F.array_distinct(F.concat(segments, stem, F.array(p)))).otherwise(F.when(p != "", F.array(p)).otherwise(F.array().cast("array<string>")))


def words(text: Column | str) -> Column:
    """Runs of letters, digits and underscores."""
    return F.coalesce(F.regexp_extract_all(_column(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array().cast("array<string>"))


def _run_ngrams(run: Column, low: int, high: int) -> Column:
    n = F.length(run)

    def of(size: Column) -> Column:
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(run, i, size))).otherwise(F.array().cast("array<string>"))

    return F.when(n < low, F.array(run)).otherwise(F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), of)))


def ngrams(text: Column | str, low: int = 2, high: int = 3) -> Column:
    """Character n-grams of the runs of scripts without spaces; shorter runs stay whole."""
    t = _column(text)
    runs = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in NGRAM_RUNS])
    return F.coalesce(F.flatten(F.transform(runs, lambda r: _run_ngrams(r, low, high))), F.array().cast("array<string>"))


def with_analysis(df: DataFrame, text: str, to: str, low: int = 2, high: int = 3, nfkc: bool = True, fold_secondary: bool = True, identifiers: bool = True) -> DataFrame:
    """df with a column struct(terms, secondary_terms, ngrams, identifier_terms) of a text column.

    Staged in columns, as each intermediate is read several times: the normal form, then words, then the folded form.
    Accents are folded once for the whole text; letters, digits and underscores stay what they are, so words pair up.
    """
    none = F.array().cast("array<string>")
    n, w, f = f"_{to}_normal", f"_{to}_words", f"_{to}_folded"
    out = df.withColumn(n, normalize_lexical(text, nfkc)).withColumn(w, words(n))
    secondary = none
    if fold_secondary:
        out = out.withColumn(f, F.when(F.col(n).rlike(r"[^\x00-\x7F]"), words(_fold(F.col(n)))))
        secondary = F.when(F.size(w) == F.size(f), F.filter(F.zip_with(w, f, lambda a, b: F.when((a != b) & (b != ""), b)), lambda x: x.isNotNull())).otherwise(none)
    dense = F.when(F.col(n).rlike(r"[^\x00-\x{24F}]"), ngrams(n, low, high)).otherwise(none)
    value = F.struct(F.col(w).alias("terms"), F.coalesce(secondary, none).alias("secondary_terms"), dense.alias("ngrams"), (identifier_terms(text) if identifiers else none).alias("identifier_terms"))
    return out.withColumn(to, value).drop(n, w, f)


_RUNS = tuple(re.compile(c) for c in ("[\u3005\u3007\u3021-\u3029\u3040-\u3096\u309d-\u309f\u30a1-\u30fa\u30fd-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff6f\uff71-\uff9d\U00020000-\U000323af]+", "[\u1100-\u11ff\u3131-\u318e\uac00-\ud7a3]+", "[\u0e01-\u0e3a\u0e40-\u0e5b]+", "[\u0e81-\u0edf]+", "[\u1000-\u109f]+", "[\u1780-\u17ff]+"))
_NAME = re.compile(r"[^\W\d]\w*(?:(?:::|[./-])\w+)*")


def analyze_words(text: str, low: int = 2, high: int = 3, nfkc: bool = True) -> tuple[list[str], list[str], list[str]]:
    """Terms (folded forms at the end), n-grams and identifier terms of a query's few words, as with_analysis has them for columns."""
    from inkwell.plans.query import split_identifier

    normal = " ".join((unicodedata.normalize("NFKC", text) if nfkc else text).lower().split())
    terms, folded = re.findall(r"\w+", normal), re.findall(r"\w+", fold(normal))
    if len(terms) == len(folded):
        terms = terms + [b for a, b in zip(terms, folded) if a != b]
    grams: list[str] = []
    for runs in _RUNS:
        for run in runs.findall(normal):
            grams += [run] if len(run) < low else [run[i : i + n] for n in range(low, high + 1) for i in range(len(run) - n + 1)]
    names: list[str] = []
    for token in _NAME.findall(text):
        parts = [p.lower() for p in split_identifier(token)]
        if len(parts) >= 2:
            joined = ["".join(own).lower() for own in map(split_identifier, re.split(SEPARATORS, token)) if len(own) >= 2]
            names += dict.fromkeys([token.lower(), *parts, *(glue.join(parts) for glue in ("", "_", "-")), *joined])
    return terms, grams, names


def script_counts(text: Column | str) -> Column:
    """array<struct(script, count)> of the letters of a text, most frequent first, in the order of SCRIPTS among equals."""
    t = _column(text)
    plain = F.regexp_count(t, F.lit("[A-Za-z]"))
    rest = F.regexp_replace(t, r"[\x00-\x7F]+", "")  # what the property tables have to be asked about
    known = [F.struct(F.lit(s).alias("script"), (F.regexp_count(rest, F.lit(rf"\p{{Is{s}}}")) + (plain if s == "Latin" else F.lit(0))).alias("count"), F.lit(i).alias("at")) for i, s in enumerate(SCRIPTS)]
    letters = F.regexp_count(rest, F.lit(r"[\p{L}&&[^" + "".join(rf"\p{{Is{s}}}" for s in SCRIPTS) + "]]"))
    every = F.array(*known, F.struct(F.lit("Other").alias("script"), letters.alias("count"), F.lit(len(SCRIPTS)).alias("at")))
    only_latin = F.when(plain > 0, F.array(F.struct(F.lit("Latin").alias("script"), plain.alias("count")))).otherwise(F.array().cast("array<struct<script: string, count: int>>"))
    present = F.filter(every, lambda x: x["count"] > 0)
    ranked = F.array_sort(present, lambda a, b: F.when(a["count"] != b["count"], b["count"] - a["count"]).otherwise(a["at"] - b["at"]))
    return F.when(t.rlike(r"[^\x00-\x7F]"), F.transform(ranked, lambda x: F.struct(x["script"].alias("script"), x["count"].alias("count")))).otherwise(only_latin)


def language_of(counts: Column | str) -> Column:
    """struct(primary_language, languages, scripts, confidence, mixed) from script_counts: only what scripts tell for sure."""
    c = _column(counts)

    def n(*scripts: str) -> Column:
        return F.aggregate(F.filter(c, lambda x: x["script"].isin(*scripts)), F.lit(0), lambda s, x: s + x["count"])

    total = F.aggregate(c, F.lit(0), lambda s, x: s + x["count"])
    kana = n("Hiragana", "Katakana")
    options = [("ja", kana > 0, n("Hiragana", "Katakana", "Han")), ("ko", n("Hangul") > 0, n("Hangul")), ("zh", (n("Han") > 0) & (kana == 0), n("Han")), ("th", n("Thai") > 0, n("Thai")), ("he", n("Hebrew") > 0, n("Hebrew")), ("ar", n("Arabic") > 0, n("Arabic"))]
    found = F.filter(F.array(*[F.when(has, F.struct(F.lit(code).alias("lang"), count.alias("count"))) for code, has, count in options]), lambda x: x.isNotNull())
    best = F.aggregate(found, F.struct(F.lit("und").alias("lang"), F.lit(0).alias("count")), lambda s, x: F.when(x["count"] > s["count"], F.struct(x["lang"].alias("lang"), x["count"].alias("count"))).otherwise(s))
    return F.struct(
        best["lang"].alias("primary_language"),
        F.transform(found, lambda x: x["lang"]).alias("languages"),
        F.transform(c, lambda x: x["script"]).alias("scripts"),
        F.when(best["lang"] != "und", best["count"] / total).alias("confidence"),
        (F.size(F.filter(c, lambda x: x["count"] / total >= 0.1)) > 1).alias("mixed"),
    )


def has_no_space_script(text: Column | str) -> Column:
    return _column(text).rlike(NO_SPACE)


def estimate_tokens(text: Column | str) -> Column:
    """Characters of scripts without spaces and Hangul, plus a quarter of the others that aren't blank, rounded up."""
    t = _column(text)
    dense = F.regexp_count(t, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]"))
    return (dense + F.ceil((F.regexp_count(t, F.lit(r"(?U)\S")) - dense) / 4)).cast("int")


def find_verified(text: Column | str, phrase: Column, case_sensitive: bool = False) -> Column:
    """Offset (in code points, from 0) of the first occurrence; null if there is none.

    Where lower case changes a text's length, stretches of the raw text are compared one by one.
    """
    t = _column(text)
    if case_sensitive:
        at = F.instr(t, phrase)
        return F.when(at > 0, at - 1)
    low, needle = F.lower(t), F.lower(phrase)
    at = F.instr(low, needle)
    slow = F.filter(F.sequence(F.lit(1), F.greatest(F.length(t) - F.length(phrase) + 1, F.lit(1))), lambda i: F.lower(F.substring(t, i, F.length(phrase))) == needle)
    return F.when(F.length(low) == F.length(t), F.when(at > 0, at - 1)).when(F.contains(low, needle) | (F.size(slow) > 0), F.try_element_at(slow, F.lit(1)) - 1)


def count_lines(text: Column | str, offset: Column) -> Column:
    return F.regexp_count(F.substring(_column(text), F.lit(1), offset.cast("int")), F.lit("\n"))


def snippet(text: Column | str, offset: Column, match_length: Column, before: int = 60, length: int = 240) -> Column:
    """struct(snippet, highlight_start, highlight_end) around a match; the beginning of the text without one."""
    t = _column(text)
    start = F.greatest(F.lit(0), offset - before)
    end = F.least(F.length(t), start + length)
    around = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(t, start + 1, end - start), F.when(end < F.length(t), "…").otherwise(""))
    mark = offset - start + F.when(start > 0, 1).otherwise(0)
    plain = F.when(F.length(t) > length, F.concat(F.substring(t, F.lit(1), F.lit(length)), F.lit("…"))).otherwise(t)
    return F.struct(F.when(offset.isNotNull(), around).otherwise(plain).alias("snippet"), mark.cast("int").alias("highlight_start"), F.least(mark + match_length, F.length(around)).cast("int").alias("highlight_end"))


def link_target(link: Column | str) -> Column:
    """The note a link names: no fragment, folders or .md, lower case."""
    t = F.regexp_replace(_column(link), "(?s)#.*$", "")
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(t, "(?s)^.*/", ""), r"(?i)\.md$", "")))


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(F.element_at(F.split(_column(path), "/"), -1), r"(?<=.)\.[^.]+$", "")


def link_names(path: Column | str, title: Column | str) -> Column:
    """Names by which links reach a note: file stem and title, lower case."""
    return F.array_distinct(F.filter(F.array(F.lower(F.trim(file_stem(path))), F.lower(F.trim(_column(title)))), lambda x: x.isNotNull()))


def path_parts(path: Column | str) -> Column:
    """struct(filename, stem, folder, extension)."""
    p = _column(path)
    name = F.element_at(F.split(p, "/"), -1)
    return F.struct(name.alias("filename"), file_stem(p).alias("stem"), F.when(p.contains("/"), F.regexp_replace(p, "(?s)/[^/]*$", "")).otherwise("").alias("folder"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("extension"))


def join_terms(analysis: Column | str) -> Column:
    """All terms of an analysis in one line, for people to read."""
    a = _column(analysis)
    return F.array_join(F.concat(a["terms"], a["secondary_terms"], a["ngrams"], a["identifier_terms"]), " ")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def utf8_length(text: Column | str) -> Column:
    return F.octet_length(_column(text))


def render_words(template: str, content: str) -> str:
    """A query template filled with a query's words; other variables become empty."""
    return re.sub(r"\{\{\s*([A-Za-z_][\w.]*)\s*\}\}", lambda m: content if m[1] in ("content", "query") else "", template)


def render_template(template: str, variables: dict[str, Column]) -> tuple[Column, list[str], list[str]]:
    """The filled template, the variables used and those that are unknown (they become empty). One pass: values are never expanded."""
    parts, used, missing, at = [], [], [], 0
    for m in re.finditer(r"\{\{\s*([A-Za-z_][\w.]*)\s*\}\}", template):
        parts.append(F.lit(template[at : m.start()]))
        name = m[1]
        if name in variables:
            used += [name] * (name not in used)
            parts.append(F.coalesce(variables[name], F.lit("")))
        else:
            missing += [name] * (name not in missing)
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts), used, missing

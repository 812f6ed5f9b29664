"""Languages of documents and of the segments of mixed-language texts, with confidence.

A text is brought to its canonical form and stripped of markup, code, formulas and headings. Script ranges narrow the
languages a word can be in to those whose samples use that script; within them a word scores by its character
n-grams and its frequency in the samples. Viterbi over the words' scores with a penalty for every switch labels
spans. A text whose best single language can't be beaten by any switch (no other language gains more than the
penalty over any stretch) is labelled without walking it. A language counts as present if a whole sentence of at
least MIN_WORDS words (MIN_HAN characters where words aren't parted) is labelled with it.

The model is fitted on the samples alone, MAX_SAMPLES of them at most. It is small and broadcast: its size depends
on the samples, not on the data. Labels are read in any letter case, with region or script suffixes, as two- or
three-letter codes of any language in ISO 639, which the running Java knows. Segments are places in the text as it was
given: words of the text without markup are found again, in order, among its words.

Defined cases: null or empty texts, and texts without a whole sentence, have no language. Repeated rows count
once. No samples: no language is known and nothing is reported. Texts of any length are read whole.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.canonical import canonicalizer
from inkwell.llm.markup import prose, without_opaque
from inkwell.session import cut

MAX_SAMPLES = 20_000
SWITCH, FLOOR = 8.0, -6.0
MIN_WORDS, MIN_HAN, AGREE = 4, 6, 0.8
CACHE, TOGETHER = 300_000, 500_000
# Bibliographic three-letter codes that differ from the terminological ones, with their two-letter codes.
BIBLIOGRAPHIC = dict(x.split(":") for x in "alb:sq arm:hy baq:eu bur:my chi:zh cze:cs dut:nl fre:fr geo:ka ger:de gre:el ice:is mac:mk mao:mi may:ms per:fa rum:ro slo:sk tib:bo wel:cy".split())

_TOKEN = re.compile(r"[぀-ヿㇰ-ㇿ]+|[㐀-鿿豈-﫿]+|[.!?。！？｡\n]+|[^\W぀-ヿㇰ-ㇿ㐀-鿿豈-﫿]+")
_KANA_HAN = re.compile(r"[぀-鿿豈-﫿]")
_END = frozenset(".!?。！？｡\n")


def script_of(word: str) -> str:
    code = ord(word[0])
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "latin"
    for name, low, high in (("greek", 0x370, 0x400), ("cyrillic", 0x400, 0x530), ("hebrew", 0x590, 0x600), ("arabic", 0x600, 0x780), ("thai", 0xE00, 0xE80), ("kana", 0x3040, 0x3100), ("han", 0x3400, 0xA000), ("hangul", 0xAC00, 0xD7A4), ("hangul", 0x1100, 0x1200), ("han", 0xF900, 0xFB00)):
        if low <= code < high:
            return name
    return "other"


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text)


class LanguageModel:
    """Scores of words by language; built on the driver from labelled sentences."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = sorted({code for code, _ in samples})
        self.canonical = canonicalizer()
        self.scripts: dict[str, list[int]] = {}
        grams = [defaultdict(Counter) for _ in self.langs]
        words = [Counter() for _ in self.langs]
        used = [Counter() for _ in self.langs]
        for code, text in samples:
            i = self.langs.index(code)
            for w in words_of(self.canonical(text).lower()):
                if w[0] in _END:
                    continue
                words[i][w] += 1
                used[i][script_of(w)] += 1
                for n, g in _grams(w):
                    grams[i][n][g] += 1
        for script in {s for u in used for s in u}:
            self.scripts[script] = [i for i, u in enumerate(used) if u[script] >= 0.02 * max(1, sum(u.values()))]
        self.words = words
        self.word_total = [sum(w.values()) + 200 for w in words]
        self.grams = [{n: dict(c) for n, c in g.items()} for g in grams]
        self.gram_total = [{n: sum(c.values()) for n, c in g.items()} for g in grams]
        self.gram_kinds = {n: len({x for g in grams for x in g[n]}) + 1 for n in (1, 2, 3, 4)}
        self._ids: dict[str, int] = {}
        self._table = np.zeros((1024, len(self.langs)), dtype=np.float32)
        self._sizes = np.zeros(1024, dtype=np.int32)  # characters, negative where words aren't parted
        self._fill = 0

    def score(self, word: str) -> np.ndarray:
        """Log-scores by language, the best 0 and none below FLOOR."""
        out = np.full(len(self.langs), FLOOR, dtype=np.float32)
        allowed = self.scripts.get(script_of(word), [])
        if not allowed:
            return np.zeros(len(self.langs), dtype=np.float32)
        if len(allowed) == 1:
            out[allowed[0]] = 0
            return out
        parts = list(_grams(word))
        raw = []
        for i in allowed:
            s = sum(math.log((self.grams[i].get(n, {}).get(g, 0) + 0.2) / (self.gram_total[i].get(n, 0) + 0.2 * self.gram_kinds[n])) for n, g in parts)
            raw.append(s / math.sqrt(len(parts)) + math.log((self.words[i].get(word, 0) + 0.1) / self.word_total[i]))
        best = max(raw)
        for i, s in zip(allowed, raw):
            out[i] = max(FLOOR, s - best)
        return out

    def ids(self, words: list[str]) -> np.ndarray:
        """Rows of the score table; -1 for the end of a sentence, -2 for identifiers and numbers."""
        known = self._ids
        try:
            return np.fromiter([known[w] for w in words], dtype=np.int64, count=len(words))
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
            self._fill = 0
        for w in words:
            if w in known:
                continue
            if w[0] in _END:
                known[w] = -1
            elif any(c.isdigit() or c == "_" for c in w):
                known[w] = -2
            else:
                if self._fill == len(self._table):
                    self._table = np.concatenate([self._table, np.zeros_like(self._table)])
                    self._sizes = np.concatenate([self._sizes, np.zeros_like(self._sizes)])
                self._table[self._fill] = self.score(w)
                self._sizes[self._fill] = -len(w) if _unparted(w[0]) else len(w)
                known[w] = self._fill
                self._fill += 1
        return np.fromiter([known[w] for w in words], dtype=np.int64, count=len(words))

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words: scores, characters, and whether they are of a script that doesn't part words."""
        sizes = self._sizes[ids]
        return self._table[ids], np.abs(sizes), sizes < 0


def _grams(word: str) -> Iterator[tuple[int, str]]:
    padded = f"\x02{word}\x03" if word[0] < "぀" or word[0] >= "가" else word
    for n in (1, 2, 3, 4):
        for i in range(len(padded) - n + 1):
            yield n, padded[i : i + n]


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word when every switch costs `switch`."""
    n = len(scores)
    if not n:
        return np.zeros(0, dtype=np.int64)
    total = scores.sum(0)
    best = int(total.argmax())
    ahead = scores - scores[:, best : best + 1]
    if (np.maximum(ahead, 0).sum(0) <= switch).all():
        return np.full(n, best, dtype=np.int64)
    gain = np.cumsum(ahead, axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    low[1:] = low[:-1]
    low[0] = 0
    rise = (gain - low).max(0)
    states = [best, *np.flatnonzero(rise > switch).tolist()]
    if len(states) == 1:
        return np.full(n, best, dtype=np.int64)
    rows = scores[:, states].tolist()
    k = range(len(states))
    value, back = rows[0][:], []
    for row in rows[1:]:
        top = max(k, key=value.__getitem__)
        bar = value[top] - switch
        came = []
        for j in k:
            if value[j] >= bar:
                came.append(j)
                value[j] += row[j]
            else:
                came.append(top)
                value[j] = bar + row[j]
        back.append(came)
    at = max(k, key=value.__getitem__)
    path = [at]
    for came in reversed(back):
        at = came[at]
        path.append(at)
    return np.array(states, dtype=np.int64)[path[::-1]]


def _confidence(total: np.ndarray, words: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Softmax of summed scores (a row for each group), which count as the square root of their number: words aren't independent."""
    mean = total.astype(np.float64) / np.sqrt(words)[:, None]
    return 1 / np.exp(np.minimum(mean - mean[np.arange(len(lang)), lang][:, None], 50)).sum(1)


Language, Segment = tuple[str, int, float], tuple[int, int, str, float]


def label_texts(model: LanguageModel, texts: list[str | None], segments: bool = False) -> tuple[list[list[Language]], list[list[Segment]]]:
    """Of each text the (language, characters, confidence) of its whole sentences, most characters first, and its segments.

    All texts of the list are scored together; only those in which a switch may pay are walked one by one.
    """
    langs: list[list[Language]] = [[] for _ in texts]
    spans: list[list[Segment]] = [[] for _ in texts]
    plains: list[str] = [""] * len(texts)
    tokens: list[str] = []
    bounds = [0]
    for i, t in enumerate(texts):
        if t and model.langs:
            plains[i] = _lower(prose(model.canonical(t)))
            tokens += words_of(plains[i])
        bounds.append(len(tokens))
    every = model.ids(tokens)
    word = every >= 0
    if not word.any():
        return langs, spans
    ids, kinds = every[word], len(model.langs)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[word]
    scores, size, joined = model.rows(ids)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    ends = np.append(starts[1:], len(owner))
    best = np.add.reduceat(scores, starts, axis=0).argmax(1)
    labels = np.repeat(best, ends - starts)
    ahead = np.maximum(scores - scores[np.arange(len(labels)), labels][:, None], 0)
    for k in np.flatnonzero((np.add.reduceat(ahead, starts, axis=0) > SWITCH).any(1)):
        labels[starts[k] : ends[k]] = viterbi(scores[starts[k] : ends[k]])

    # sentences
    new = np.diff(owner, prepend=-1) != 0
    new |= np.diff(np.cumsum(every == -1)[word], prepend=0) != 0
    first = np.flatnonzero(new)
    sentence = np.cumsum(new) - 1
    count = len(first)
    votes = np.bincount(sentence * kinds + labels, weights=size, minlength=count * kinds).reshape(count, kinds)
    chars, lang = votes.sum(1), votes.argmax(1)
    n_words = np.bincount(sentence[size > 1], minlength=count)
    n_joined = np.bincount(sentence, weights=np.where(joined, size, 0), minlength=count)
    fit = np.add.reduceat(scores, first, axis=0)
    sure = fit[np.arange(count), lang] >= fit.max(1) - 1e-4
    whole = ((n_words >= MIN_WORDS) & (n_joined == 0) | (n_joined >= MIN_HAN)) & (votes.max(1) >= AGREE * chars) & sure
    if whole.any():
        group = owner[first][whole].astype(np.int64) * kinds + lang[whole]
        names, at = np.unique(group, return_inverse=True)
        total = np.zeros((len(names), kinds))
        np.add.at(total, at, fit[whole])
        words = np.bincount(at, weights=np.bincount(sentence, minlength=count)[whole])
        sure_of = _confidence(total, words, names % kinds)
        for name, c, p in zip(names.tolist(), np.bincount(at, weights=chars[whole]).tolist(), sure_of.tolist()):
            langs[name // kinds].append((model.langs[name % kinds], int(c), p))
        for own in langs:
            own.sort(key=lambda x: (-x[1], x[0]))

    if segments:
        cuts = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
        sure_of = _confidence(np.add.reduceat(scores, cuts, axis=0), np.diff(np.append(cuts, len(labels))), labels[cuts])
        places: list[tuple[int, int]] = []
        for i in owner[starts].tolist():
            places += _places(model, texts[i], plains[i], every[bounds[i] : bounds[i + 1]])
        for a, b, p in zip(cuts.tolist(), np.append(cuts[1:], len(labels)).tolist(), sure_of.tolist()):
            spans[owner[a]].append((places[a][0], places[b - 1][1], model.langs[labels[a]], p))
    return langs, spans


def languages_in(model: LanguageModel, text: str | None) -> list[Language]:
    """(language, characters, confidence) of the whole sentences of a text, most characters first."""
    return label_texts(model, [text])[0][0]


@lru_cache(4096)
def _unparted(ch: str) -> bool:
    return "぀" <= ch <= "鿿" or "豈" <= ch <= "﫿"


def segments_in(model: LanguageModel, text: str | None) -> list[Segment]:
    """(start, end, language, confidence) of the spans of one language, positions in the given text."""
    return label_texts(model, [text], True)[1][0]


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := ch.lower()) == 1 else ch for ch in text)


def _places(model: LanguageModel, text: str, plain: str, ids: np.ndarray) -> list[tuple[int, int]]:
    """Where each word of the text without markup stands in the given text.

    What remains of a text without its markup is in the order of the text, so each word is the next one alike among the
    words of the text; code, formulas and tags are blanked out first. A word that only arose (from a character
    reference) stands where the one before it ends.
    """
    form = model.canonical(text)
    back = model.canonical.origins(text)
    at = (lambda i: i) if back is None else (lambda i: back[min(i, len(back) - 1)])
    low = _lower(form)
    if plain == low:
        return [(at(m.start()), at(m.end())) for m, i in zip(_TOKEN.finditer(plain), ids.tolist()) if i >= 0]
    known: dict[str, list[int]] = defaultdict(list)
    spans = []
    for m in _TOKEN.finditer(_lower(without_opaque(form))):
        known[m[0]].append(len(spans))
        spans.append(m.span())
    out, k, last = [], 0, (0, 0)
    for m, i in zip(_TOKEN.finditer(plain), ids.tolist()):
        if i < 0:
            continue
        own = known.get(m[0], ())
        if (j := bisect.bisect_left(own, k)) < len(own):
            k = own[j] + 1
            last = spans[own[j]]
        else:
            last = (last[1], last[1])
        out.append((at(last[0]), at(last[1])))
    return out


def fit(samples: DataFrame) -> LanguageModel:
    """The model of (sample_id, lang_code, sample_text); the MAX_SAMPLES first by id are used."""
    rows = samples.where("lang_code is not null and sample_text is not null").select("sample_id", "lang_code", "sample_text").distinct().orderBy("sample_id", "lang_code", "sample_text").limit(MAX_SAMPLES).collect()
    return LanguageModel([(r["lang_code"], r["sample_text"]) for r in rows])


def label_languages(df: DataFrame, model: LanguageModel, key: str, text: str, segments: bool = False) -> DataFrame:
    """(key, langs[, segments]) of every row: the languages of its whole sentences, most text first; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, langs array<struct<lang: string, chars: int, confidence: double>>" + (", segments array<struct<start: int, end: int, lang: string, confidence: double>>" if segments else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            texts, begin = pdf["_t"].tolist(), 0
            while begin < len(texts):
                end, chars = begin, 0
                while end < len(texts) and (end == begin or chars < TOGETHER):
                    chars += len(texts[end] or "")
                    end += 1
                found, spans = label_texts(own, texts[begin:end], segments)
                out = {"k": pdf["_k"].iloc[begin:end].reset_index(drop=True), "langs": [[{"lang": a, "chars": b, "confidence": c} for a, b, c in x] for x in found]}
                if segments:
                    out["segments"] = [[{"start": a, "end": b, "lang": c, "confidence": p} for a, b, c, p in x] for x in spans]
                yield pd.DataFrame(out)
                begin = end

    return df.selectExpr(f"`{key}` as _k", f"`{text}` as _t").mapInPandas(run, schema).withColumnRenamed("k", key)


@lru_cache(1)
def three_letter_codes() -> dict[str, str]:
    """Three-letter codes of ISO 639 with their two-letter codes, as the running Java knows them, and the bibliographic ones."""
    locale = SparkContext._active_spark_context._jvm.java.util.Locale
    return {locale(code).getISO3Language(): code for code in locale.getISOLanguages()} | BIBLIOGRAPHIC


def label_code(label: Column) -> Column:
    """The two-letter code a label means; null if it names none."""
    first = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    table = F.create_map(*[F.lit(x) for pair in sorted(three_letter_codes().items()) for x in pair])
    code = F.when(F.length(first) == 3, F.coalesce(F.try_element_at(table, first), first)).otherwise(first)
    return F.when((code != "") & (code != "und"), code)


def label_codes(labels: Column) -> Column:
    """The set of codes in an array of labels, sorted."""
    found = F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), label_code), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(found))


def text_segments(chunks: DataFrame, documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(ref_table, ref_key, text_lang, text_confidence, start, end, lang, confidence): the language of most of each text and its spans.

    Every chunk and document comes out: one row for each span, one with null spans where there are no words. text_lang is null
    in texts without a whole sentence. Positions are code points of text_raw and text.
    """
    texts = chunks.where("row_id is not null").select(F.struct(F.lit("chunks").alias("ref_table"), F.col("row_id").alias("ref_key")).alias("id"), F.col("text_raw").alias("text"))
    texts = texts.unionByName(documents.where("doc_id is not null").select(F.struct(F.lit("documents").alias("ref_table"), F.col("doc_id").cast("string").alias("ref_key")).alias("id"), "text"))
    done = label_languages(texts, model, "id", "text", segments=True)
    once = done.select("id.ref_table", "id.ref_key", F.get("langs", F.lit(0)).alias("main"), "segments").dropDuplicates(["ref_table", "ref_key"])
    each = once.select("ref_table", "ref_key", F.col("main.lang").alias("text_lang"), F.col("main.confidence").alias("text_confidence"), F.explode_outer("segments").alias("s"))
    return each.select("ref_table", "ref_key", "text_lang", "text_confidence", "s.start", "s.end", "s.lang", "s.confidence")


def wrong_labels(chunks: DataFrame, sources: DataFrame, documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(ref_table, ref_key, lang_code): records with missing or wrong labels and the languages they really have."""
    once = chunks.where("row_id is not null").select("row_id", F.struct("source_id", "language_codes").alias("own"), "text_raw")
    packed = once.select(F.struct("row_id", "own").alias("id"), "text_raw")
    labelled = cut(label_languages(packed, model, "id", "text_raw").select("id.row_id", "id.own.source_id", "id.own.language_codes", "langs").dropDuplicates(["row_id"]), "languages")  # read twice below
    true = F.array_sort(F.transform("langs", lambda x: x["lang"]))
    from_chunks = labelled.where(true != label_codes(F.col("language_codes"))).select(F.lit("chunks").alias("ref_table"), F.col("row_id").alias("ref_key"), F.explode(true).alias("lang_code"))

    by_lang = labelled.select("source_id", F.explode("langs").alias("l")).groupBy("source_id", F.col("l.lang").alias("lang")).agg(F.sum("l.chars").alias("chars"))
    of_source = by_lang.groupBy("source_id").agg(F.array_sort(F.collect_list("lang")).alias("true"), F.max_by("lang", F.struct("chars", "lang")).alias("main"))  # as many entries as the model has languages
    labels = sources.where("source_id is not null").select("source_id", label_code(F.col("primary_language")).alias("main_label"), label_codes(F.col("languages")).alias("labels")).dropDuplicates(["source_id"])
    wrong = of_source.join(labels, "source_id").where(~F.col("main").eqNullSafe(F.col("main_label")) | (F.col("true") != F.col("labels")))
    from_sources = wrong.select(F.lit("sources").alias("ref_table"), F.col("source_id").alias("ref_key"), F.explode("true").alias("lang_code"))

    kept = documents.where("doc_id is not null").select(F.struct("doc_id", "lang").alias("id"), "text")
    main = label_languages(kept, model, "id", "text").where("size(langs) > 0").select("id.doc_id", "id.lang", F.col("langs")[0]["lang"].alias("lang_code"))
    from_documents = main.where(~F.col("lang_code").eqNullSafe(label_code(F.col("lang")))).select(F.lit("documents").alias("ref_table"), F.col("doc_id").cast("string").alias("ref_key"), "lang_code").distinct()
    return from_chunks.unionByName(from_sources).unionByName(from_documents)

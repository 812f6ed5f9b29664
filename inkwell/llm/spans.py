"""Long exact spans shared between records, by recompression.

A text is a string of tokens (a word of up to MAX_WORD letters with the character after it, else one character).
Rounds name equal things alike everywhere: a run of one symbol becomes a new symbol, then pairs do, where the first
is in the left and the second in the right half of the alphabet as that round's bit of their names tells. A name
is a 64-bit fingerprint of what it stands for, so names agree over all records without an exchange in each round.
Only symbols up to the round's length take part. Whether two symbols merge depends on them alone; so inside a
string that stands in two records all symbols agree, but for `margin` characters at either end. There are as many
rounds of pairs as min_chars leaves room for; at 200 all four, with symbols of up to 28 characters.

The high-level symbols that the last round leaves reveal what records share. Of every stretch of WINDOW characters the
symbol with the least name is taken, and named together with `context` characters to either side, which a shared span
of min_chars that holds the symbol there holds as well: as 2 * context + WINDOW - 1 + the longest symbol is no more
than min_chars and context no less than margin, two records that share a span of min_chars have such a symbol in
common, inside the span: none is missed.

Symbols are counted with partial aggregation and only those of two different texts are joined back. Equal texts are one
record until the end (each task emits a text once; then by text name). Symbols in at most HOT places are verified
pair by pair: their texts are compared left and right from there, which gives the span exactly. All others, from
boilerplate or large groups of near copies, are verified by class: the stretches of min_chars around them are named,
those in two different texts are the classes, and what a class covers is shared. So no pairs are made within a hot
symbol; pairs of records, where they are asked for, are expanded from the classes at the end, in blocks, and once for
neighbouring classes of the same texts. Coverage needs no pairs at all: with hot=0 everything goes by class.

Of equal neighbouring high-level symbols, which only repetitions have, the outermost are kept. The rest is derived from
the texts: a repetition is taken with its first and last character and its period, and two of them are compared at
the shifts that between them cover all that any shift would (of repetitions, spans are given at those alone).

Defined cases: null texts and ids are left out, empty and short texts share nothing. Repeated rows count once.
Texts are read whole, whatever their length. Positions and lengths are in code points. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import cut

MIN_CHARS = 200
MAX_WORD, RUN_LENGTH, PAIR_LENGTHS = 12, 6, (8, 10, 12, 14)
WINDOW, HOT, BLOCK = 44, 64, 256
BATCH_CHARS = 1_000_000
#: Up to so many symbols or text names (8 or 16 bytes each) are broadcast to pick rows by; beyond, they are joined by shuffle.
BROADCAST_KEYS = 500_000
_BASE, _K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15 | 1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def rounds_for(min_chars: int) -> tuple[tuple[int, ...], int]:
    """The lengths of the rounds of pairs, and the context a symbol is named with."""
    for k in range(len(PAIR_LENGTHS), -1, -1):
        margin = MAX_WORD + 1 + RUN_LENGTH + sum(PAIR_LENGTHS[:k])
        longest = max(MAX_WORD + 1, 2 * PAIR_LENGTHS[k - 1] if k else 0)
        context = (min_chars - longest - WINDOW + 1) // 2
        if context >= max(margin, 16):
            return PAIR_LENGTHS[:k], context
    raise ValueError("min_chars is too small")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _K1
    x ^= x >> np.uint64(27)
    x *= _K2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are part of words: letters, digits and marks of scripts that part words by spaces."""
    table = np.zeros(0x110000, dtype=bool)
    for code in (*range(0x30, 0x2E80), *range(0xAC00, 0xD7A4)):
        table[code] = chr(code).isalnum()
    table[0x300:0x370] = True
    return table


class _Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, _BASE, np.uint64))])
                self.down = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, inverse, np.uint64))])


_POWERS = _Powers()


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Sums so far of code times power; two of them give the name of any stretch."""
    _POWERS.reach(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _K3 * _POWERS.up[: len(codes)], out=sums[1:])
    return sums


def _names(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((sums[end] - sums[start]) * _POWERS.down[start])


def _slide(values: np.ndarray, width: int, of) -> np.ndarray:
    """of(values[i : i + width]) for every i with a full window, by doubling."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = of(out[:-reach], out[reach:])
        reach *= 2
    return of(out[: len(out) - (width - reach)], out[width - reach :]) if width > reach else out


def _merge(starts: np.ndarray, fused: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and new names without the symbols that the one before swallows."""
    return starts[~joins], fused[~joins]


def symbols(codes: np.ndarray, first: np.ndarray, sums: np.ndarray, pair_lengths: tuple[int, ...] = PAIR_LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and names of the symbols after all rounds; first marks the first character of each text."""
    n = len(codes)
    letter = _letters()[codes]
    begins = first.copy()
    begins[1:] |= ~letter[:-1]
    starts = np.flatnonzero(begins)
    lengths = np.diff(starts, append=n)
    if (lengths > MAX_WORD + 1).any():
        begins |= np.repeat(lengths > MAX_WORD + 1, lengths)
        starts = np.flatnonzero(begins)
        lengths = np.diff(starts, append=n)
    names = _names(sums, starts, starts + lengths)
    # runs
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = (names[1:] == names[:-1]) & ~first[starts[1:]]
    if same.any():
        heads = np.flatnonzero(~same)
        size = np.diff(heads, append=len(starts))
        short = (size > 1) & (size * lengths[heads] <= RUN_LENGTH)
        fused = names.copy()
        fused[heads[short]] = _mix(names[heads[short]] ^ (size[short].astype(np.uint64) * _K3))
        starts, names = _merge(starts, fused, same & np.repeat(short, size))
    # pairs
    for number, most in enumerate(pair_lengths):
        lengths = np.diff(starts, append=n)
        left = ((names >> np.uint64(7 + number)) & np.uint64(1)).astype(bool)
        fits = lengths <= most
        pair = np.zeros(len(starts), dtype=bool)
        pair[1:] = left[:-1] & ~left[1:] & fits[:-1] & fits[1:] & ~first[starts[1:]]
        at = np.flatnonzero(pair)
        fused = names.copy()
        fused[at - 1] = _mix(names[at - 1] * _K1 + names[at] + np.uint64(number + 1))
        starts, names = _merge(starts, fused, pair)
    return starts, names


def high_symbols(texts: list[str], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: the index of the text, where the context begins, and the name of every high-level symbol that is taken."""
    pair_lengths, context = rounds_for(min_chars)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    n = int(sizes.sum())
    empty = np.zeros(0, np.int64)
    if n < min_chars:
        return empty, empty, empty
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    first = np.zeros(n, dtype=bool)
    first[bounds[:-1][sizes > 0]] = True
    with np.errstate(over="ignore"):
        sums = _prefixes(codes)
        starts, names = symbols(codes, first, sums, pair_lengths)
        grid = np.full(n + 2 * (WINDOW - 1), np.iinfo(np.uint32).max, dtype=np.uint32)
        grid[starts + WINDOW - 1] = (names >> np.uint64(32)).astype(np.uint32)
        least = _slide(_slide(grid, WINDOW, np.minimum), WINDOW, np.maximum)
        taken = np.flatnonzero(least[starts] == grid[starts + WINDOW - 1])
        lo, hi = starts[taken] - context, np.append(starts[1:], n)[taken] + context
        owner = np.searchsorted(bounds, starts[taken], side="right") - 1
        whole = (lo >= bounds[owner]) & (hi <= bounds[owner + 1])
        taken, lo, hi, owner = taken[whole], lo[whole], hi[whole], owner[whole]
        high = _mix(names[taken] * _K2 ^ _names(sums, lo, hi)).view(np.int64)
    inner = np.zeros(len(lo), dtype=bool)  # in the middle of a long repetition
    if len(lo) > 2:
        equal = (high[1:] == high[:-1]) & (owner[1:] == owner[:-1])
        inner[1:-1] = equal[1:] & equal[:-1]
    return owner[~inner], (lo - bounds[owner])[~inner], high[~inner]


_SCHEMA = "sym long, h1 long, h2 long, pos int"


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, h1, h2): h1 and h2 together are the text's name."""
    named = df.selectExpr(f"`{key}` as id", f"`{text}` as text").where("id is not null and text is not null")
    return named.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(20260101), "text").alias("h2"))


def high_level_symbols(keyed: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(sym, h1, h2, pos) of every high-level symbol taken, pos where its context begins; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist()))
            texts = batch.column("text").to_pylist()
            todo: list[int] = []
            chars = 0
            for i, k in enumerate(keys):
                if k in seen:
                    continue
                seen.add(k)
                todo.append(i)
                chars += len(texts[i])
                if chars >= BATCH_CHARS or i == len(keys) - 1:
                    yield one(keys, texts, todo)
                    todo, chars = [], 0
            if todo:
                yield one(keys, texts, todo)

    def one(keys: list, texts: list, todo: list[int]) -> pa.RecordBatch:
        owner, at, sym = high_symbols([texts[i] for i in todo], min_chars)
        names = np.array([keys[i] for i in todo], dtype=np.int64).reshape(-1, 2)[owner]
        return pa.RecordBatch.from_arrays([pa.array(sym), pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1])), pa.array(at.astype(np.int32))], names=["sym", "h1", "h2", "pos"])

    return keyed.where(F.length("text") >= min_chars).select("h1", "h2", "text").mapInArrow(run, _SCHEMA)


def _pick(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """One (h1, h2, text) for each key."""
    n = keys.count()
    chosen = keyed.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, ["h1", "h2"], "left_semi")
    ids = Window.partitionBy("h1", "h2").orderBy("id")
    return chosen.withColumn("_n", F.row_number().over(ids)).where("_n = 1").select("h1", "h2", "text")


def _period(stretch: str) -> int:
    """The period of a stretch that repeats itself at least about twice, else 0."""
    d = stretch.find(stretch[: len(stretch) // 2], 1)
    return d if d > 0 and stretch[d:] == stretch[:-d] else 0


def _repetition(text: str, at: int, d: int) -> tuple[int, int]:
    """First and last + 1 of the whole repetition of period d around a position inside it."""
    return at - _common_suffix(text, at, text, at + d), at + d + _common_prefix(text, at, text, at + d)


def _shifts(x: str, p: int, y: str, q: int, seed: int) -> list[tuple[int, int]]:
    """(position in x, in y) at which to compare the repetitions around p and q; none if there is no repetition.

    At shifts between those that align both starts and both ends the shorter one lies in the longer one; steps of its length
    cover what any of them would. Beyond, what is shared shrinks with each period, so the next shift is enough.
    """
    d = _period(x[p : p + seed])
    if not d:
        return []
    (la, ha), (lb, hb) = _repetition(x, p, d), _repetition(y, q, d)
    low, high = sorted((lb - la, hb - ha))
    first, last = q - p - (q - p - low) // d * d, q - p + (high - q + p) // d * d
    step = min(ha - la, hb - lb) // d * d
    starts = ((max(la, lb - s), s, min(ha, hb - s)) for s in sorted({first - d, *range(first, last, step), last, last + d}))
    return [(at, at + s) for at, s, end in starts if at < end]


class Shared(NamedTuple):
    """What records share.

    spans: (a1, a2, b1, b2, start_a, start_b, length) between different texts, maximal, (a1, a2) < (b1, b2) their names.
    windows: (w1, w2, h1, h2, start): stretches of min_chars, alike named alike, each in two different texts at least.
    members: (id, h1, h2, chars): which records have which text.
    """

    spans: DataFrame
    windows: DataFrame
    members: DataFrame


def _windows(hot: DataFrame, keyed: DataFrame, min_chars: int) -> DataFrame:
    """Every stretch of min_chars around the hot symbols that stands in two different texts."""
    _, context = rounds_for(min_chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h1, h2, at, text in zip(pdf["h1"], pdf["h2"], pdf["at"], pdf["text"]):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                last = len(codes) - min_chars
                here = np.zeros(max(0, last + 1), dtype=bool)
                done = -1  # the end of the repetition last looked at
                for pos in sorted(at):
                    lo, hi = pos, pos + 1
                    if pos >= done and (d := _period(text[pos : pos + 2 * context])):
                        lo, hi = _repetition(text, pos, d)
                        done = hi
                    here[max(0, lo - min_chars + 2 * context) : hi] = True
                start = np.flatnonzero(here)
                if not len(start):
                    continue
                with np.errstate(over="ignore"):
                    sums, other = _prefixes(codes), _prefixes(codes ^ np.uint32(0x5A5A5))
                    w1, w2 = (_names(x, start, start + min_chars).view(np.int64) for x in (sums, other))
                yield pd.DataFrame({"w1": w1, "w2": w2, "h1": h1, "h2": h2, "start": start.astype(np.int32)})

    at = hot.groupBy("h1", "h2").agg(F.collect_set("pos").alias("at"))  # bounded by the text's length
    named = at.join(_pick(keyed, hot.select("h1", "h2").distinct()), ["h1", "h2"]).mapInPandas(run, "w1 long, w2 long, h1 long, h2 long, start int")
    named = cut(named, "windows")
    classes = named.groupBy("w1", "w2").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("w1", "w2")
    return cut(named.join(classes, ["w1", "w2"], "left_semi"), "classes")


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, hot: int | None = None) -> Shared:
    """What the records of df share; hot: symbols in more places than that are verified by class (HOT by default)."""
    most = HOT if hot is None else hot
    _, context = rounds_for(min_chars)
    keyed = _keyed(df, key, text)
    found = high_level_symbols(keyed, min_chars)  # read twice: naming anew costs less than keeping all names on disk
    counts = cut(found.groupBy("sym").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("sym", (F.col("n") > most).alias("hot")), "shared")
    kept = F.broadcast(counts) if counts.count() <= BROADCAST_KEYS else counts
    shared = cut(found.join(kept, "sym").dropDuplicates(["sym", "h1", "h2", "pos"]), "symbols")
    members = keyed.select("id", "h1", "h2", F.length("text").alias("chars")).distinct()
    windows = _windows(shared.where("hot"), keyed, min_chars)
    spans_schema = "a1 long, a2 long, b1 long, b2 long, start_a int, start_b int, length int"
    if most == 0:
        return Shared(df.sparkSession.createDataFrame([], spans_schema), windows, members)
    cold = shared.where("not hot")
    a = cold.select("sym", F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("pos").alias("pa"))
    b = cold.select("sym", F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("pos").alias("pb"))
    pairs = a.join(b, "sym").where("a1 < b1 or (a1 = b1 and a2 < b2)")  # at most HOT for each row
    lines = pairs.groupBy("a1", "a2", "b1", "b2", (F.col("pb") - F.col("pa")).alias("shift")).agg(F.collect_set("pa").alias("at"))
    candidates = cut(lines, "candidates")
    keys = candidates.selectExpr("a1 as h1", "a2 as h2").unionByName(candidates.selectExpr("b1 as h1", "b2 as h2")).distinct()
    texts = _pick(keyed, keys)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a1, a2, b1, b2, shift, at, x, y in zip(*(pdf[c] for c in ("a1", "a2", "b1", "b2", "shift", "at", "x", "y"))):
                done = -1
                for p in sorted(at):
                    if p < done:
                        continue
                    q = p + shift
                    left, right = _common_suffix(x, p, y, q), _common_prefix(x, p, y, q)
                    done = p + max(1, right)
                    if left + right >= min_chars:
                        rows.append((a1, a2, b1, b2, p - left, q - left, left + right))
                    for v, w in _shifts(x, p, y, q, 2 * context):
                        left, right = _common_suffix(x, v, y, w), _common_prefix(x, v, y, w)
                        if left + right >= min_chars:
                            rows.append((a1, a2, b1, b2, v - left, w - left, left + right))
            yield pd.DataFrame(rows, columns=["a1", "a2", "b1", "b2", "start_a", "start_b", "length"])

    with_texts = candidates.join(texts.toDF("a1", "a2", "x"), ["a1", "a2"]).join(texts.toDF("b1", "b2", "y"), ["b1", "b2"])
    spans = with_texts.select("a1", "a2", "b1", "b2", "shift", "at", "x", "y").mapInPandas(verify, spans_schema).distinct()  # repetitions are found from several places
    return Shared(cut(spans, "spans"), windows, members)


def _common_prefix(x: str, p: int, y: str, q: int) -> int:
    most = min(len(x) - p, len(y) - q)
    have, step = 0, 256
    while have < most:
        step = min(step, most - have)
        if x[p + have : p + have + step] == y[q + have : q + have + step]:
            have += step
            step *= 2
        elif step == 1:
            break
        else:
            most = have + step - 1 if step > 1 else have
            step = max(1, step // 2)
    return have


def _common_suffix(x: str, p: int, y: str, q: int) -> int:
    most = min(p, q)
    have, step = 0, 256
    while have < most:
        step = min(step, most - have)
        if x[p - have - step : p - have] == y[q - have - step : q - have]:
            have += step
            step *= 2
        elif step == 1:
            break
        else:
            most = have + step - 1 if step > 1 else have
            step = max(1, step // 2)
    return have


def class_pairs(windows: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2): pairs of texts that share a window, each class of texts expanded once, in blocks of BLOCK.

    Neighbouring windows mostly have the same texts. Of the windows of one set of texts those are expanded that, in the
    set's least text, don't follow a window of the same set: one at least, the first.
    """
    texts = windows.groupBy("w1", "w2", "h1", "h2").agg(F.min("start").alias("start"))
    sets = texts.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2", "start")).alias("least"), F.bit_xor(F.xxhash64("h1", "h2")).alias("x"), F.sum(F.xxhash64("h2", "h1") % 1_000_003).alias("s"))
    order = Window.partitionBy("least.h1", "least.h2").orderBy("least.start")
    mark = F.struct("n", "x", "s")
    follows = (F.lag("least.start").over(order) == F.col("least.start") - 1) & (F.lag(mark).over(order) == mark)
    once = sets.withColumn("_f", F.coalesce(follows, F.lit(False))).where("not _f").select("w1", "w2", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = texts.select("w1", "w2", "h1", "h2").join(once, ["w1", "w2"]).withColumn("own", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int"))
    cells = own.select("w1", "w2", "h1", "h2", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    a = cells.where("own <= other").select("w1", "w2", F.col("own").alias("i"), F.col("other").alias("j"), F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    b = cells.where("other <= own").select("w1", "w2", F.col("other").alias("i"), F.col("own").alias("j"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    both = a.join(b, ["w1", "w2", "i", "j"]).where("i < j or a1 < b1 or (a1 = b1 and a2 < b2)")
    return both.select("a1", "a2", "b1", "b2").distinct()


def document_pairs(shared: Shared, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: pairs of records that share a span, equal texts included."""
    members = shared.members
    texts = shared.spans.select("a1", "a2", "b1", "b2").distinct()
    if shared.windows.limit(1).count():
        texts = texts.unionByName(class_pairs(shared.windows))
    x = members.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("id").alias("x"))
    y = members.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("id").alias("y"))
    between = texts.join(x, ["a1", "a2"]).join(y, ["b1", "b2"]).select("x", "y")
    several = members.where(F.col("chars") >= min_chars)
    copies = several.join(several.groupBy("h1", "h2").count().where("count > 1").drop("count"), ["h1", "h2"], "left_semi")
    within = copies.select("h1", "h2", F.col("id").alias("x")).join(copies.select("h1", "h2", F.col("id").alias("y")), ["h1", "h2"]).where("x < y").select("x", "y")
    return between.unionByName(within).where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def shared_shares(shared: Shared, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, chars, shared_chars, share) of every record: how much of it stands in other records too."""
    spans, members = shared.spans, shared.members
    own = spans.selectExpr("a1 as h1", "a2 as h2", "start_a as lo", "start_a + length as hi").unionByName(spans.selectExpr("b1 as h1", "b2 as h2", "start_b as lo", "start_b + length as hi"))
    own = own.unionByName(shared.windows.select("h1", "h2", F.col("start").alias("lo"), (F.col("start") + min_chars).alias("hi"))).distinct()
    order = Window.partitionBy("h1", "h2").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    covered = own.withColumn("_reach", F.coalesce(F.max("hi").over(order), F.lit(0))).groupBy("h1", "h2").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "_reach"))).alias("shared"))
    copies = members.groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    joined = members.join(copies, ["h1", "h2"]).join(covered, ["h1", "h2"], "left")
    part = F.when((F.col("copies") > 1) & (F.col("chars") >= min_chars), F.col("chars")).otherwise(F.coalesce("shared", F.lit(0)))
    return joined.select("id", "chars", part.cast("long").alias("shared_chars"), F.when(F.col("chars") > 0, F.round(part / F.col("chars"), 6)).otherwise(0.0).alias("share"))

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import spans as sp


def _brute(texts, n=200):
    grams = [{t[i : i + n] for i in range(len(t) - n + 1)} if t else set() for t in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grams[i] & grams[j]}


def _texts(seed):
    rng = random.Random(seed)
    words = ["lantern", "the", "quiet", "Gewächshaus", "索引の", "关于", "x" * 30, "a", "-" * 40, "== ", "ha ha ha ha ", "\n\n", "😀"]
    make = lambda n: "".join(rng.choice(words) + rng.choice(["", " ", ", ", "."]) for _ in range(n))
    out = [make(rng.randint(1, 120)) for _ in range(12)]
    for _ in range(12):
        base = rng.choice(out)
        if len(base) > 210:
            n = rng.choice([199, 200, 201, 240])
            at = rng.randint(0, max(0, len(base) - n))
            out.append(make(rng.randint(0, 30)) + base[at : at + n] + make(rng.randint(0, 30)))
    line = make(25)[:150]
    return [*out, "", None, "-" * 500, "a" + "-" * 260, "-" * 199, line + make(20), make(15) + line, out[0]]


def test_pairs_against_brute_force(spark):
    for seed in (1, 2):
        texts = _texts(seed)
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")
        for hot in (64, 0):
            found = sp.shared_spans(df, hot=hot)
            assert {tuple(r) for r in sp.document_pairs(found).collect()} == _brute(texts)
            assert {r["id"]: r["shared_chars"] for r in sp.shared_shares(found).collect()} == {i: n for i, n in _covered(texts).items() if texts[i] is not None}


def test_hot_boilerplate_is_split(spark, monkeypatch):
    monkeypatch.setattr(sp, "HOT", 8)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = " ".join(word() for _ in range(26))[:170]
    texts = [" ".join(word() for _ in range(20)) + line + " ".join(word() for _ in range(20)) for _ in range(30)]
    texts.append(texts[3][20:260])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in sp.document_pairs(sp.shared_spans(df)).collect()} == _brute(texts) == {(3, 30)}


def test_a_line_in_a_tenth_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 16)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = " ".join(word() for _ in range(40))[:200]
    texts = [" ".join(word() for _ in range(30)) + (line if i % 10 == 0 else "#") + " ".join(word() for _ in range(30)) for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sp.shared_spans(df)
    sizes = sorted(r["count"] for r in found.windows.groupBy("w1", "w2").count().collect())
    assert found.spans.count() == 0 and sizes[-1] == 100 and sum(sizes) < 1000  # one class of all and those of chance neighbours, no pairs
    assert {tuple(r) for r in sp.document_pairs(found).collect()} == {(i, j) for i in range(0, 1000, 10) for j in range(i + 10, 1000, 10)}
    assert {r["id"]: r["shared_chars"] for r in sp.shared_shares(sp.shared_spans(df, hot=0)).collect()} == _covered(texts)


def test_near_copies(spark):
    rng = random.Random(6)
    words = [["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120)] for _ in range(2)]
    texts = []
    for i in range(90):
        own = list(words[i % 2])
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"<{i}>"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (8, 0):
        found = sp.shared_spans(df, hot=hot)
        assert {tuple(r) for r in sp.document_pairs(found).collect()} == _brute(texts)
        assert {r["id"]: r["shared_chars"] for r in sp.shared_shares(found).collect()} == _covered(texts)


def test_shares_and_spans(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(5))
    a, b, c = (" ".join(word() for _ in range(60)) for _ in range(3))
    df = spark.createDataFrame([(1, a + "#" + b), (2, b + "|" + c), (3, c[:100]), (4, a), (4, a), (5, c), (6, c)], "doc_id long, text string")
    found = sp.shared_spans(df)
    shares = {r["id"]: r["shared_chars"] for r in sp.shared_shares(found).collect()}
    assert shares == {1: len(a) + len(b), 2: len(b) + len(c), 3: 0, 4: len(a), 5: len(c), 6: len(c)}
    assert sorted(r["length"] for r in found.spans.collect()) == sorted([len(a), len(b), len(c)])


def _covered(texts, n=200):
    texts = [t or "" for t in texts]
    owners = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - n + 1):
            owners.setdefault(t[k : k + n], set()).add(i)
    return {i: len({c for k in range(len(t) - n + 1) if len(owners[t[k : k + n]]) > 1 for c in range(k, k + n)}) for i, t in enumerate(texts)}


def test_repetitions_are_covered_whole(spark):
    df = spark.createDataFrame([(0, "a" + "-" * 1000), (1, "b" + "-" * 300)], "doc_id long, text string")
    got = {r["id"]: r["shared_chars"] for r in sp.shared_shares(sp.shared_spans(df)).collect()}
    assert got == {0: 1000, 1: 300}
    assert got == {r["id"]: r["shared_chars"] for r in sp.shared_shares(sp.shared_spans(df, hot=0)).collect()}


def test_repetitions_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    for hot in (64, 8, 0):
        monkeypatch.setattr(sp, "HOT", hot)
        texts = set()
        for unit in ("-", "ab", "= - ", "one two three, ", "".join(rng.choice("abcdefgh ") for _ in range(41))):
            left, right = ("".join(rng.choice("klmnopqr ") for _ in range(60)) for _ in range(2))
            for n in (150, 199, 200, 205, 230, 260, 700, 1500):
                at = rng.randrange(len(unit))
                texts.add(rng.choice([left, left[30:], left[:20] + "%", ""]) + (unit * 1600)[at : at + n] + rng.choice([right, right[:30], "%" + right[9:], ""]))
        texts = sorted(texts)
        found = sp.shared_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert {tuple(r) for r in sp.document_pairs(found).collect()} == _brute(texts)
        assert {r["id"]: r["shared_chars"] for r in sp.shared_shares(found).collect()} == _covered(texts)


def test_empty(spark):
    df = spark.createDataFrame([(1, None), (None, "x" * 300), (2, "")], "doc_id long, text string")
    assert sp.document_pairs(sp.shared_spans(df)).count() == 0
    assert sp.document_pairs(sp.shared_spans(df.limit(0))).count() == 0 == sp.shared_shares(sp.shared_spans(df.limit(0), hot=0)).count()


@given(st.text(max_size=40), st.text(max_size=40), st.text(max_size=60), st.integers(0, 30))
@settings(max_examples=100, deadline=None)
def test_common_parts(left, right, mid, k):
    x, y = left + mid + "1" + right, right + mid + "2" + left
    p, q = len(left), len(right)
    n = 0
    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
        n += 1
    assert sp._common_prefix(x, p, y, q) == n
    m = 0
    while m < min(p, q) and x[p - m - 1] == y[q - m - 1]:
        m += 1
    assert sp._common_suffix(x, p, y, q) == m

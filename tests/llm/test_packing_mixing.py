import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import mixing, packing, tokens


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20), st.just(50))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_item_once(histogram, limit):
    slots, containers = packing.plan(histogram, limit)
    used, seen = defaultdict(int), defaultdict(set)
    for length, a, b, each, first in slots:
        for rank in range(a, b):
            assert rank not in seen[length]
            seen[length].add(rank)
            used[first + (rank - a) // each] += length
    assert {x: len(r) for x, r in seen.items()} == histogram
    assert all(set(r) == set(range(len(r))) for r in seen.values())
    assert max(used.values(), default=0) <= limit and set(used) == set(range(containers))
    total = sum(x * n for x, n in histogram.items())
    assert containers <= 11 / 9 * -(-total // limit) + 1 or containers <= best_fit(histogram, limit)


def best_fit(histogram, limit):
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(limit - length)
    return len(rooms)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 20)
    rng = random.Random(1)
    items = [(i, rng.choice([5, 5, 5, 17, 33, 64, 65, 130, 200, 0]), "x") for i in range(300)] + [(300, None, "x"), (None, 7, "x"), (301, 10**4, "x"), (0, 5, "x")]
    items[0] = (0, 5, "x")
    df = spark.createDataFrame(items, "doc_id long, tokens long, container_id string")
    limits = spark.createDataFrame([(1, 64), (2, 200), (3, None), (4, 0)], "limit_id int, token_limit int")
    out = packing.pack(df, limits).collect()
    want = {i: n or 0 for i, n, _ in items if i is not None}
    for limit_id, limit in ((1, 64), (2, 200)):
        own = [r for r in out if r["limit_id"] == limit_id]
        size, used = defaultdict(int), defaultdict(int)
        for r in own:
            size[r["doc_id"]] += r["length"]
            used[r["container_id"]] += r["length"]
        assert dict(size) == want
        assert max(used.values()) <= limit
        pieces = defaultdict(int)
        for r in own:
            pieces[r["doc_id"]] += 1
        assert all(pieces[i] == max(1, -(-n // limit)) for i, n in want.items())
        assert sum(want.values()) / (len(used) * limit) > 0.95
    assert {r["limit_id"] for r in out} == {1, 2}
    assert packing.pack(df.limit(0), limits).count() == 0


def test_water_fill():
    have, shares, caps = {"a": 100, "b": 10, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 4, "c": 1}
    assert mixing.feasible_total(have, shares, caps) == 4 * 10 / 0.3
    got = mixing.water_fill(have, shares, caps, 300)
    assert got["b"] == 40 and abs(sum(got.values()) - 300) < 1e-9 and abs(got["a"] / got["c"] - 2.5) < 1e-9
    assert mixing.water_fill(have, shares, caps, 10**6) == {"a": 200, "b": 40, "c": 1000}
    assert mixing.water_fill({}, {}, {}, 10) == {}


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["big", "big", "big", "small", "none"]), rng.randint(1, 50)) for i in range(4000)] + [(4000, None, 5), (None, "big", 5), (4001, "big", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    df = df.unionAll(df.limit(100))
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, targets, total=mixing.EXACT)
    r = {x["source"]: x for x in report.collect()}
    assert abs(r["big"]["actual_share"] - 0.4) < 0.01 and abs(r["small"]["actual_share"] - 0.6) < 0.01 and r["absent"]["chosen"] == 0
    got = chosen.collect()
    assert len({x["doc_id"] for x in got}) == len(got) and all(1 <= x["copies"] <= (1 if x["source"] == "big" else 3) for x in got)
    assert {tuple(x) for x in got} == {tuple(x) for x in mixing.mix(df.repartition(3), targets, total=mixing.EXACT)[0].collect()}
    targets = spark.createDataFrame([("big", 0.2, 1), ("small", 0.8, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    everything = {x["source"]: x for x in mixing.mix(df, targets)[1].collect()}
    assert everything["small"]["clamped"] and everything["small"]["chosen"] == 3 * everything["small"]["available"] and not everything["big"]["clamped"]
    assert abs(sum(x["chosen"] for x in everything.values()) - sum(t or 0 for i, s, t in rows if i is not None and s)) <= 50  # what small lacks big takes over
    plan = {x["source"]: x for x in mixing.plan_shares(df, targets).collect()}
    assert all(abs(plan[s]["planned"] - everything[s]["chosen"]) <= 50 and plan[s]["clamped"] == everything[s]["clamped"] for s in plan)
    assert mixing.mix(df.limit(0), targets)[0].count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "x" * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 100


def test_limits_and_targets_beyond_the_bounds_are_refused(spark):
    import pytest

    items = spark.createDataFrame([(1, "a", 5)], "doc_id long, source string, tokens long")
    many = spark.range(packing.MAX_LIMITS + 1).selectExpr("cast(id as string) as limit_id", "cast(id + 1 as int) as token_limit")
    with pytest.raises(ValueError, match="limits"):
        packing.pack(items, many)
    targets = spark.range(mixing.MAX_SOURCES + 1).selectExpr("cast(id as string) as source", "1.0D as target_share", "1 as max_repeats")
    with pytest.raises(ValueError, match="targets"):
        mixing.mix(items, targets)
    with pytest.raises(ValueError, match="targets"):
        mixing.mix(items, spark.createDataFrame([("a", 0.5, 1), ("a", 0.4, 1)], "source string, target_share double, max_repeats int"))

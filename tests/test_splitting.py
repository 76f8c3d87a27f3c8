from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators.splitting import LIMITS, balanced_cuts, split_sentences

SENT = "sent_key string, toks array<string>, breaks array<struct<k:int,s:int>>, cuts map<string,array<int>>, rungs array<array<int>>, loaded_at timestamp, level string, pieces int, split string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), min_size=0, max_size=80), st.integers(1, 13), st.integers(0, 3), st.dictionaries(st.integers(-3, 90), st.integers(0, 100), max_size=20))
def test_pieces_fit_cover_and_overlap(flags, limit, overlap, strength):
    if overlap >= limit:
        with pytest.raises(ValueError):
            balanced_cuts([0], limit, overlap)
        return
    words = [0]
    for f in flags:
        words.append(words[-1] + f)
    pieces = balanced_cuts(words, limit, overlap, strength)
    if not flags:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(flags)
    assert all(words[b] - words[a] <= limit for a, b in pieces)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert c <= b < d and words[b] - words[c] == min(overlap, words[b])


def test_cuts_prefer_the_strongest_boundary():
    assert balanced_cuts(range(11), 6, 0, {4: 20, 5: 45, 6: 80}) == [(0, 6), (6, 10)]
    assert balanced_cuts(range(11), 6, 0, {}) == [(0, 5), (5, 10)]


def run(spark, data):
    return {(r.sent_key, r.level): r for r in split_sentences(spark.createDataFrame(data, SENT)).collect()}


def test_defined_cases(spark):
    words = [f"w{i}" for i in range(10)]
    t = datetime(2024, 1, 1)
    rest = ("x", 1, "y")
    data = [
        ("plain", words, None, None, None, t, *rest),
        ("cut", words, [(3, 45), (None, None), None, (99, 5)], {"starter": [8, 4, 4, -1, 99, 0, 10], "beginner": [5], "advanced": None}, [[5], None], t, *rest),
        ("marks", [",", ".", "—"] * 9, None, None, None, t, *rest),
        ("empty", [], None, {}, None, t, *rest),
        ("null", None, None, None, None, t, *rest),
        (None, words, None, None, None, t, *rest),
        ("late", words, None, {x: [2, 4, 6, 8] for x in LIMITS}, None, datetime(2024, 2, 1), *rest),
        ("late", words, None, None, None, t, *rest),
        ("nulltok", [None, *words], None, None, None, None, *rest),
        ("long", ["w"] * 20000, None, None, None, t, *rest),
    ]
    got = run(spark, data)
    assert {k for k in got if k[0] == "plain"} == {("plain", x) for x in ("starter", "beginner", "intermediate")}
    assert {k[1] for k in got if k[0] == "cut"} == {"intermediate"}
    assert not {k for k in got if k[0] in ("marks", "empty", "null", None, "late")}
    assert ("nulltok", "starter") in got
    assert all(p.b - p.a <= 13 for p in got["long", "advanced"].pieces)
    assert got["plain", "starter"].longest == 10
    assert all(p.b - p.a <= 4 for p in got["plain", "starter"].pieces)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_found_levels_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    data = []
    for i in range(300):
        toks = None if i % 41 == 0 else [rng.choice(["w", "w", "w", ",", None]) for _ in range(rng.randint(0, 40))]
        cuts = None if i % 11 == 0 else {x: None if rng.random() < 0.1 else [rng.choice([None, -2, 0, 3, 7, 12, 18, 25, 33, 60]) for _ in range(rng.randint(0, 9))] for x in LIMITS if rng.random() < 0.8}
        data.append((f"s{i}", toks, None, cuts, None, datetime(2024, 1, 1), "x", 1, "y"))
    want = set()
    for key, toks, _, cuts, *_ in data:
        n = len(toks or [])
        for level, limit in LIMITS.items():
            edges = sorted({0, n, *(k for k in (cuts or {}).get(level) or [] if k and 0 < k < n)})
            if any(sum(t == "w" for t in toks[a:b]) > limit for a, b in zip(edges, edges[1:])):
                want.add((key, level))
    assert set(run(spark, data)) == want

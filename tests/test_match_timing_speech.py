from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions import symbols
from lectern.functions.match import best_alternative, matched_words, score, score_udf, within, words_match
from lectern.operators.timing import align, parse_sections, run_ends
from lectern.streaming.speech import Limits, Loop, Take, endpoints, long_take, transcript


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abü", max_size=9), st.text("abü", max_size=9), st.integers(0, 3))
def test_banded_distance(a, b, most):
    assert within(a, b, most) == (edits(a, b) <= most)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["haus", "hauss", "drei", "3", "vier", "weg", "baum"]), max_size=7), st.lists(st.sampled_from(["haus", "drei", "3", "weg", "baums"]), max_size=7))
def test_alignment_is_the_best_one(ref, hyp):
    cost = list(range(len(hyp) + 1))
    for i, r in enumerate(ref, 1):
        last, cost[0] = cost[0], i
        for j, h in enumerate(hyp, 1):
            last, cost[j] = cost[j], min(cost[j] + 1, cost[j - 1] + 1, last + (0 if words_match(r, h) else 3))
    assert len(ref) + len(hyp) - 2 * sum(matched_words(ref, hyp)) == cost[-1]


@pytest.mark.parametrize(
    "ref,hyp,want",
    [
        ("Das Haus ist groß.", "das haus ist gross", 1.0), ("drei Hunde", "3 hunde", 1.0), ("Der Hund", "der mond scheint", 0.5), ("", "x", 1.0), ("— …", "", 1.0),
        ("Tür auf", "tur auf", 1.0), ("zwei", "drei", 0.0), ("alpha beta gamma delta", "beta alpha gamma delta", 0.75), (None, None, 1.0),
    ],
)
def test_scores(ref, hyp, want):
    assert score(ref, hyp)["score"] == want


def test_discount_and_tokens():
    got = score("Gregor schlief — fest", "schlief fest", [True, False, False, False])
    assert (got["score"], got["matched"], got["total"]) == (1.0, 2, 2)
    assert [t["ok"] for t in got["tokens"]] == [None, True, None, True]
    assert best_alternative("a b", ["x", "a b", "a b"])[0] == 1


def test_score_udf_on_nulls(spark):
    df = spark.createDataFrame([("a b", None, None), (None, "x", [True]), ("a", "a", [None])], "r string, h string, d array<boolean>")
    assert [r.s.score for r in df.select(score_udf("r", "h", "d").alias("s")).collect()] == [0.0, 1.0, 1.0]


def test_alignment_of_lengths():
    assert align([3, 4], [3, 4]) == [(1, 1), (1, 1)] and align([7], [3, 4]) == [(1, 2)] and align([3, 4], [7]) == [(2, 1)]
    assert align([], [1]) is None and align([30], [1]) is None and align([1], [1, 1, 1, 1, 1]) is None


def test_run_ends():
    assert run_ends(["in", "haus"], [0.2, 0.8], ["In", "—", "Haus."], len) == [0.2, 0.2, 0.8]
    assert run_ends(["inhaus"], [0.9], ["in", "haus"], len) == [0.3, 0.9]
    assert run_ends(["ein", "tausend"], [0.3, 1.0], ["1000"], lambda r: 10) == [1.0]
    assert run_ends(["x" * 50], [1.0], ["a", "b"], len) is None


def test_random_timings_are_monotone():
    rng = random.Random(1)
    for _ in range(200):
        runs = ["w" * rng.randint(1, 8) for _ in range(rng.randint(1, 10))]
        words, k = [], 0
        while k < len(runs):
            step = rng.choice([1, 1, 2])
            words.append("".join(runs[k : k + step]))
            k += step
        ends = run_ends(words, [float(i + 1) for i in range(len(words))], runs, len)
        assert ends is None or (ends == sorted(ends) and ends[-1] == len(words))


def test_section_lists():
    assert parse_sections("1, 3-4", 5) == {0, 2, 3}
    with pytest.raises(ValueError):
        parse_sections("6", 5)


def frames(*parts):
    out, t = [], 0.0
    for ms, peak in parts:
        for _ in range(int(ms / 20)):
            out.append((t, peak))
            t += 20
    return out


def events(take, rows):
    return [e for t, p in rows if (e := take.step(t, p))]


def test_takes():
    assert events(Take(), frames((500, 0.01), (600, 0.5), (1200, 0.0))) == ["speech", "stop"]
    assert events(Take(), frames((10200, 0.005))) == ["nothing"]
    assert events(Take(), frames((100, 0.5), (500, 0.0))) == []
    assert events(Take(), frames((31000, 0.5))) == ["speech", "stop"]
    assert events(Take(long_take(20)), frames((600, 0.5), (1500, 0.0))) == ["speech"]
    take = Take(long_take(20))
    assert [e for t, p in frames((600, 0.5), (2000, 0.0)) if (e := take.step(t, p, interim=True))] == ["speech", "stop"]
    loud_room = Take()
    assert events(loud_room, frames((3000, 0.018), (400, 0.03))) == []


def test_endpoints_by_take(spark):
    rows = [(k, t, p) for k, parts in {"a": ((600, 0.5), (1200, 0.0)), "b": ((10200, 0.0),)}.items() for t, p in frames(*parts)]
    df = spark.createDataFrame(rows[::-1], "take string, t double, peak double")
    assert {(r.take, r.event) for r in endpoints(df).collect()} == {("a", "speech"), ("a", "stop"), ("b", "nothing")}
    assert endpoints(df.limit(0)).collect() == []


def test_transcripts():
    assert transcript([(1, "interim", ["ab "]), (1, "final", [" abc", "abd"]), (0, "final", ["old"])], 1) == [["abc", "abd"]]
    assert transcript([(2, "interim", ["ab"]), (2, "interim", ["abc"])], 2) == [["abc"]] and transcript([], 1) == []


def test_loop():
    loop = Loop()
    assert [loop.scored(x) for x in (True, False, False, False, False)] == ["advance", "again", "again", "advance", "again"]
    assert Loop("stop").scored(True) == "wait" and Loop("repeat").scored(True) == "again"


@pytest.mark.parametrize("e,ok", [("", True), ("🌲", True), ("🌲🔥", True), ("🌲🔥💧", False), ("8️⃣", True), ("a", False), ("🌲 🔥", False), ("👨‍👩‍👧", True), ("∈", False), ("❄️", True), ("⬇", True)])
def test_symbols(e, ok):
    assert symbols.sane(e) is ok


def test_symbol_repairs():
    assert symbols.without_gender(" 🏃‍♂️ ") == "🏃" and symbols.rejoined("👨👩👧") == "👨‍👩‍👧" and symbols.rejoined("🌲🔥💧") == "🌲🔥💧" and symbols.sane_run("1️⃣2️⃣")

from __future__ import annotations

import random

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.repetition import RULES, Words, plan_rules, repeated_share, repetition, repetitive


def brute(text):
    words = [w.lower() for w in regex.findall(r"\p{L}+", text or "")]
    seen, covered = set(), [False] * len(words)
    for i in range(len(words) - 4):
        run = tuple(words[i : i + 5])
        if run in seen:
            covered[i : i + 5] = [True] * 5
        seen.add(run)
    return sum(covered) / len(words) if words else 0.0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab B.ä\n1", max_size=80)), min_size=1, max_size=8))
def test_share_equals_brute_force_and_rules_only_reject(texts):
    words = Words(pa.array(texts, pa.string()))
    share = repeated_share(words)
    assert share == pytest.approx([brute(t) for t in texts])
    for rule in RULES.values():
        assert all(rule(words, 0.3)[share >= 0.3])


def texts(n=200):
    rng = random.Random(2)
    out = []
    for i in range(n):
        sentence = " ".join(rng.choice("der die das haus baum weg geht sieht ruft".split()) for _ in range(rng.randint(4, 30)))
        out.append(". ".join([sentence] * rng.choice([1, 1, 2, 5])) if i % 17 else None)
    return out


def test_any_order_of_rules_gives_the_same(spark, monkeypatch):
    data = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = {i for i, t in data if brute(t) >= 0.3 - 1e-9}
    for order in (list(RULES), [], list(reversed(RULES))):
        monkeypatch.setattr("lectern.llm.repetition.plan_rules", lambda *_, order=order: order)
        assert {r.doc_id for r in repetitive(df, "doc_id", "text").collect()} == want
    assert set(plan_rules(pa.array([t for _, t in data], pa.string()))) <= set(RULES)


def test_table_cases(spark):
    loop = "immer wieder dieselbe lange Zeile hier " * 3000
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "12 34", "k"), (4, loop, "k"), (4, loop, "k"), (None, loop, "k"), (5, "ein Satz", None)], "doc_id long, text string, key string")
    shares = sorted(((r.doc_id, r.words, r.share > 0.99) for r in repetition(df, "doc_id", "text").collect()), key=str)
    assert shares == sorted([(1, 0, False), (2, 0, False), (3, 0, False), (4, 18000, True), (4, 18000, True), (None, 18000, True), (5, 2, False)], key=str)
    assert sorted((r.doc_id for r in repetitive(df, "doc_id", "text").collect()), key=str) == [4, 4, None]
    assert repetitive(df.limit(0), "doc_id", "text").collect() == [] and repetition(df.limit(0), "doc_id", "text").collect() == []

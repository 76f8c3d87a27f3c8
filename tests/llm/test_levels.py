from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pytest

from lectern.llm import levels
from lectern.llm.levels import advanced_units, coverage_steps, reading_levels, sentence_shape

COMMON = [f"wört{chr(97 + i)}" for i in range(20)]
RARE = [f"selten{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
T = datetime(2024, 1, 1)
DOC = "doc_id long, text string, source string, words int, key string"
SENT = "sent_key string, book_id string, sec_idx int, toks array<string>, loaded_at timestamp, words int"
GLOSS = "gloss_id long, lang string, forms map<string,string>, freq map<string,double>, loaded_at timestamp, word string"
BOOK = "book_id string, stats struct<sentences:int,words:int,avg_sentence_len:double,vocab_below_zipf4:double>, uncommon int"
RATE = "unit string, unit_key string, level string, rater string"


def sentence(rng, length, rare):
    return [rng.choice(RARE) if rng.random() < rare else rng.choice(COMMON) for _ in range(length)]


def text(rng, n, length, rare):
    return " ".join(" ".join(s).capitalize() + "." for s in (sentence(rng, length, rare) for _ in range(n)))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    forms = {w: w for w in COMMON + RARE}
    gloss = [(1, "de", forms, {w: 1.5 for w in RARE}, T, "x"), (1, "de", forms, {w: 1.5 for w in RARE}, T, "x"), (2, "de", None, None, T, "x"), (3, None, {"a": None}, {"b": None}, None, None)]
    shapes = {1: (10, 24, 0.4), 2: (10, 24, 0.05), 3: (20, 7, 0.4), 4: (20, 7, 0.05), 5: (1, 24, 0.4)}
    docs = [(i, text(rng, *s), "retelling", 1, "k") for i, s in shapes.items()]
    docs += [
        (6, text(rng, 10, 24, 0.4), "study_sheet", 1, "k"), (7, None, None, 1, "k"), (8, "", None, 1, "k"), (9, " ".join([text(rng, 1, 24, 0.4)] * 9), "preface", 1, "k"),
        (10, "\n".join(" ".join(sentence(rng, 24, 0.4)) for _ in range(8)), None, 1, "k"), (11, "**1. " + text(rng, 10, 24, 0.4), None, 1, "k"),
        (12, text(rng, 10, 24, 0.4).encode().decode("cp1252"), None, 1, "k"), (None, text(rng, 10, 24, 0.4), "preface", 1, "k"),
    ]
    sents = [(f"b:{sec}:{i}", "b", sec, [*sentence(rng, 24 if sec == 0 else 6, 0.4), "."], T, 1) for sec in (0, 1) for i in range(20)]
    sents += [sents[0], ("b:2:0", "b", 2, None, T, 1), ("b:3:0", "b", 3, [], T, 1), ("b:4:0", "b", 4, [None, "."], None, 1), (None, "b", 5, ["x"], T, 1)]
    books = [("hard", (10, 200, None, 0.5), 1), ("zero", (10, 200, 0.0, 0.5), 1), ("easy", (10, 80, 8.0, 0.5), 1), ("plain", (10, 200, 20.0, 0.3), 1), ("none", None, 1), ("hard", (10, 200, None, 0.5), 1)]
    make = spark.createDataFrame
    return make(docs, DOC), make(sents, SENT), make(gloss, GLOSS), make(books, BOOK), make([("document", "4", "beginner", "r"), ("document", "2", " Intermediate", "r"), ("document", "1", None, "r")], RATE)


def test_advanced_units(tables):
    got = {(r.unit, r.unit_key) for r in advanced_units(*tables[:4]).collect()}
    assert got == {("document", "1"), ("document", "10"), ("document", "12"), ("document", None), ("section", "b:0"), ("book", "hard"), ("book", "zero")}


def test_all_levels(tables):
    got = {(r.unit, r.unit_key): r.level for r in reading_levels(*tables).collect()}
    assert got["document", "1"] == "advanced" and got["document", "2"] == "intermediate" and got["document", "3"] == "intermediate" and got["document", "4"] == "beginner"
    assert got["section", "b:0"] == "advanced" and got["section", "b:1"] != "advanced" and got["book", "easy"] != "advanced"
    assert not {("document", k) for k in ("5", "6", "7", "8", "9", "11")} & set(got)


def test_empty_tables(tables):
    empty = [t.limit(0) for t in tables]
    assert advanced_units(*empty[:4]).collect() == [] and reading_levels(*empty).collect() == []
    assert {r.unit for r in advanced_units(tables[0], tables[1], empty[2], tables[3]).collect()} <= {"book"}


def test_coverage_ranks_count_every_word_of_a_vocabulary_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(levels, "MAX_WORDS", 1, raising=False)  # no such limit may come back
    rng = random.Random(5)
    zipf = {w: 0.3 + 0.03 * i for i, w in enumerate(RARE)}
    docs = [(i, text(rng, 10, 24, 0.2 + 0.05 * i), "retelling", 1, "k") for i in range(8)]
    docs += [docs[3], (3, text(rng, 10, 24, 0.6), "preface", 1, "k")]  # one delivered twice, and its number for another text
    sents = [(f"b:{sec}:{i}", "b", sec, [*sentence(rng, 12, 0.3 + 0.2 * sec), "."], T, 1) for sec in range(3) for i in range(20)]
    gloss = [(1, "de", {w: w for w in COMMON + RARE}, zipf, T, "x")]
    make = spark.createDataFrame
    got = reading_levels(make(docs, DOC), make([*sents, sents[0]], SENT), make(gloss, GLOSS), make([], BOOK), make([], RATE)).collect()

    def rank(words):
        step = {w: int(round(z / 0.05, 6)) for w, z in zipf.items()}
        steps = sorted((step.get(w, 70) for w in words), reverse=True)
        last = next(s for i, s in enumerate(steps, 1) if i >= 0.83 * len(steps) - 1e-9)
        return 0 if last == 70 else len(COMMON) + sum(s >= last for s in step.values())

    want = [("document", str(d[0]), rank(d[1].lower().replace(".", "").split())) for d in docs]
    want += [("section", f"b:{sec}", rank([w for s in sents if s[2] == sec for w in s[3][:-1]])) for sec in range(3)]
    assert sum(r > len(COMMON) for *_, r in want) > 8
    assert sorted((r.unit, r.unit_key, r.coverage_rank if r.coverage_rank > len(COMMON) else 0) for r in got) == sorted(want)


def test_languages_are_told_by_all_common_words(spark, monkeypatch):
    monkeypatch.setattr(levels, "MAX_WORDS", 1, raising=False)
    rng = random.Random(6)
    english = [f"word{chr(97 + i)}" for i in range(20)]
    seldom = [f"seldom{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    # The frequent words that no gloss lists are common in the language of their texts.
    pools = [(english, 0.6), (["oftena", "oftenb", "oftenc"], 0.95), (seldom, 1.0)]

    def plain(n):
        return [rng.choice(next(pool for pool, most in pools if x < most)) for x in (rng.random() for _ in range(n))]

    docs = [(i, " ".join(" ".join(plain(24)).capitalize() + "." for _ in range(10)), "retelling", 1, "k") for i in range(5)]
    docs += [(9, text(rng, 10, 24, 0.4), "retelling", 1, "k")]
    gloss = [(1, "de", {w: w for w in COMMON + RARE}, {w: 1.5 for w in RARE}, T, "x"), (2, "en", {w: w for w in english + seldom}, {w: 1.5 for w in seldom}, T, "x")]
    make = spark.createDataFrame
    assert [r.unit_key for r in advanced_units(make(docs, DOC), make([], SENT), make(gloss, GLOSS), make([], BOOK)).collect()] == ["9"]


def test_coverage_equals_brute_force():
    rng = np.random.default_rng(1)
    owner = np.sort(rng.integers(0, 30, 400))
    steps = rng.integers(0, 120, 400)
    got = coverage_steps(steps, owner, 31, 0.83)
    for u in range(31):
        mine = np.sort(steps[owner == u])[::-1]
        want = -1 if not len(mine) else next(s for s in mine if (mine >= s).mean() >= 0.83 - 1e-9)
        assert got[u] == want


def test_sentence_shape():
    assert sentence_shape("Kapitel 3\n\nDer Hund bellt. „Wer da?“ rief Anna.\r\n\r\nSie ging\nheim!", False) == (3, 10)
    assert sentence_shape("eins zwei\ndrei vier fünf\n\n", True) == (2, 5)
    assert sentence_shape("", False) == (0, 0)

from __future__ import annotations

import random
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from lectern.operators.frequency import canonical_term, gloss_terms, latest_by, term_frequency

GLOSS = "gloss_id long, lang string, forms map<string,string>, words map<string,struct<l:string>>, freq map<string,double>, loaded_at timestamp, term string, records int, mark string"


def brute(rows, rare=2, share=0.25):
    last = {}
    for r in rows:
        if r[0] not in last or r[5] > last[r[0]][5]:
            last[r[0]] = r
    occ, held, total = Counter(), defaultdict(set), Counter()
    for i, lang, forms, words, freq, _, *_ in last.values():
        total[lang] += 1
        for group, holds in ((list((forms or {}).values()), True), (list(words or {}), True), (list(freq or {}), False)):
            for t in group:
                t = t and canonical_term(t)
                if t:
                    occ[lang, t] += 1
                    if holds:
                        held[lang, t].add(i)
    out = {}
    for (lang, t), n in occ.items():
        k = len(held[lang, t])
        out[lang, t] = (n, k, "rare" if k <= rare else "common" if k > share * total[lang] else None)
    return out


def rows(n=60, seed=1):
    rng = random.Random(seed)
    lemmas = ["gehen", " Gehen", "GEHEN\t", unicodedata.normalize("NFD", "tür"), "tür", "", None, "haus", "x", "y", "z"]
    out = []
    for i in range(n):
        forms = None if i % 9 == 0 else {f"f{j}": rng.choice(lemmas) for j in range(rng.randint(0, 6))}
        words = None if i % 7 == 0 else {w: ("l",) for w in rng.sample([x for x in lemmas if x is not None], 3)}
        freq = None if i % 5 == 0 else {w: 1.0 for w in rng.sample([x for x in lemmas if x], 2)}
        for d in range(2 if i % 10 == 0 else 1):
            out.append((i, rng.choice(["de", "en", None]) if not d else out[-1][1], forms if not d else {"f": "neu"}, words, freq, datetime(2024, 1, 1 + d), "clash", 7, "clash"))
    return out


def test_terms_match_brute_force(spark):
    data = rows()
    got = {(r.lang, r.term): (r.occurrences, r.records, r.mark) for r in gloss_terms(spark.createDataFrame(data, GLOSS)).collect()}
    assert got == brute(data)


def test_empty_and_all_null(spark):
    assert gloss_terms(spark.createDataFrame([], GLOSS)).collect() == []
    assert gloss_terms(spark.createDataFrame([(None,) * 9, (None,) * 9], GLOSS)).collect() == []


def test_records_without_id_count_each(spark):
    data = [(None, "de", {"a": "x"}, None, None, datetime(2024, 1, 1), None, None, None)] * 3
    (row,) = gloss_terms(spark.createDataFrame(data, GLOSS)).collect()
    assert (row.records, row.total_records, row.mark) == (3, 3, "common")


def test_many_languages_take_the_join(spark, monkeypatch):
    monkeypatch.setattr("lectern.operators.frequency.MAX_LITERAL_LANGS", 1)
    df = spark.createDataFrame([("de", ["a", "a"]), ("en", ["a"]), (None, ["b"])], "lang string, t array<string>")
    got = {(r.lang, r.term): (r.occurrences, r.records, r.total_records) for r in term_frequency(df, F.col("t"), F.col("t"), F.col("lang")).collect()}
    assert got == {("de", "a"): (2, 1, 1), ("en", "a"): (1, 1, 1), (None, "b"): (1, 1, 1)}


def test_latest_by_ties_and_hot_key(spark):
    data = [(1, i % 3, i) for i in range(300)] + [(2, 0, 1), (2, 0, 2), (None, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(data, "k int, v int, x int")
    got = latest_by(df, "k", "v").collect()
    assert len(got) == 4 and {r.v for r in got if r.k == 1} == {2}
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, latest_by(df.orderBy(F.desc("x")), "k", "v").collect()), key=str)

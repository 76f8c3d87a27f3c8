from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from lectern.llm.lookalikes import consistent_symbols, consistent_tokens


def spell(spark, words):
    df = spark.createDataFrame([(i, [w]) for i, w in enumerate(words)], "key long, toks array<string>")
    return [(r.toks[0], r.changed) for r in sorted(consistent_tokens(df, "key", "toks").collect(), key=lambda r: r.key)]


def test_token_forms(spark):
    cases = {
        "Ｍａｎｔｅｌ": "Mantel", "𝐝𝐞𝐫": "der", "Fenﬆer": "Fenster", "ﬁeld": "field", "．": ".", "KKind": "KKind",
        unicodedata.normalize("NFD", "Brücke"): "Brücke", "St​raße": "Straße", "o\xadne": "one", "happ﻿y": "happy", "Se‍fa": "Sefa",
        "Buch ": "Buch", "\xa0sang": "sang", "a b": "a b", "Dеr": "Der", "Τhe": "The", "windοw": "window", "½": "1⁄2", "①": "1",
    }
    assert spell(spark, list(cases)) == [(v, 1) for v in cases.values()]


def test_proper_tokens_stay(spark):
    words = ["über", "Мирна", "Ζιφέρη", "„", "“", "—", "…", "Tür", "a-b", "naïve", "日本", "🐈‍⬛", "", "Ã¼ber", "M�dchen", "´"]
    assert spell(spark, words) == [(w, 0) for w in words]


def test_symbols(spark):
    cases = [
        ("❄", "❄️", True), ("❄️", "❄️", False), ("❄️️", "❄️", True), ("❄︎", "❄️", True), ("🔥️", "🔥", True), ("🔥", "🔥", False), ("１️⃣", "1️⃣", True), ("1⃣", "1️⃣", True),
        ("🐕‍", "🐕", True), ("‍🔑", "🔑", True), ("🐈‍⬛", "🐈‍⬛", False), ("🏴‍☠", "🏴‍☠️", True), ("🔑‍🌙", "🔑🌙", True), ("👨‍👩‍👧", "👨‍👩‍👧", False),
        ("🌙\xa0", "🌙", True), ("⁠🪨", "🪨", True), ("", "", False), (None, None, False), ("☀🏽", "☀🏽", False),
    ]
    df = spark.createDataFrame([(i, c[0], "x", "y") for i, c in enumerate(cases)], "seq long, e string, key string, changed string")
    got = [(r.e, r.changed) for r in sorted(consistent_symbols(df, "seq", F.col("e")).collect(), key=lambda r: r.key)]
    assert got == [c[1:] for c in cases]


def test_table_cases(spark):
    df = spark.createDataFrame([("a", ["ﬁx", None, "x"]), ("a", ["ﬁx", None, "x"]), ("b", None), ("c", []), (None, ["Ａ"]), ("d", ["w"] * 50000 + ["ﬁ"])], "k string, toks array<string>")
    got = sorted(((r.key, r.toks[:3] if r.toks else r.toks, r.changed) for r in consistent_tokens(df, "k", "toks").collect()), key=str)
    assert got == sorted([("a", ["fix", None, "x"], 1), ("a", ["fix", None, "x"], 1), ("b", None, 0), ("c", [], 0), (None, ["A"], 1), ("d", ["w", "w", "w"], 1)], key=str)
    assert consistent_tokens(df.limit(0), "k", "toks").collect() == []

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw,want",
    [
        ("a--b", "a — b"), ("a —b", "a — b"), ("a — b", "a — b"), ("x\r\ny", "x\ny"), ("[Illustration: a cat] b", " b"), ("_a_ ~b= c·d", "a b c d"),
        ("— a", "— a"), ("", ""), (None, None), ("a———b", "a — — — b"),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, T.clean) == want


def test_markers(spark):
    assert one(spark, "x *** START OF THE PROJECT GUTENBERG A *** body *** END OF THIS PROJECT GUTENBERG A *** y", T.strip_markers) == " body "
    assert one(spark, "no markers", T.strip_markers) == "no markers"


def test_paragraphs_and_lines(spark):
    assert one(spark, "a\n b\n \n\n c \n\n\n", T.paragraphs) == ["a b", "c"]
    assert one(spark, "a\n\n b c \n", T.lines) == ["a", "b c"]


@pytest.mark.parametrize("p,want", [("Chapter 3", True), ("XIV.", True), ("The Old House", True), ("he said", False), ("It was dark.", False), ("The House of the Old Man by the Sea of Pines", False), ("Die Verwandlung", True), ("", False)])
def test_titles(spark, p, want):
    assert one(spark, p, T.looks_like_title) is want


def test_trim_by_patterns(spark):
    cut = lambda c: T.trim_regex(c, "^Start", "^End")
    assert one(spark, "a\nStart b\nc\nEnd d", cut) == "Start b\nc\n"
    assert one(spark, "nothing", cut) == "nothing"


def test_ids_ignore_form_and_blanks(spark):
    assert one(spark, "Tür  zu", T.sentence_id) == one(spark, "Tür zu ", T.sentence_id)
    assert one(spark, None, T.sentence_id) is None


@pytest.mark.parametrize("a,b,want", [("drei", "3", True), ("3", "4", False), ("haus", "hauss", True), ("haus", "maus", True), ("haus", "hxxs", False), ("verwandlung", "verwantlunk", True), ("eins", "zwei", False)])
def test_word_match(spark, a, b, want):
    from lectern.functions.match import words_match

    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.word_match(F.col("a"), F.col("b")).alias("m")).first().m is want
    assert words_match(a, b) is want


def test_numbers_and_durations(spark):
    assert [one(spark, w, T.num_canon) for w in ("007", "zwölf", "0", "dreizehn")] == ["7", "12", "0", None]
    assert [one(spark, w, T.opus_seconds) for w in ("Playback length: 1h:2m:3.456s", "Playback length: 2m:1s", "x")] == [3723.46, 121.0, None]


def test_variants(spark):
    assert one(spark, "they", T.orth_variants) == ["tey", "thei", "tei"]
    assert one(spark, "haus", T.orth_variants) == []
    assert one(spark, "boot", T.orth_proposals) == ["bot"]


def test_headword_leaks(spark):
    leak = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(T.leaks_headword(F.col("a"), F.col("b")).alias("m")).first().m
    assert leak("Schrein", "ein kleiner schreiner") and leak("wandern", "er wandert weit") and not leak("Haus", "ein Gebäude") and not leak("gehen", "er geht")


def test_tokens_and_slices(spark):
    row = spark.createDataFrame([(["Ein", "Satz", "-", "Teil", "."], "11000")], "toks array<string>, sp string")
    got = row.select(T.join_tokens(F.col("toks"), F.col("sp")).alias("all"), T.slice_text(F.col("toks"), F.col("sp"), F.lit(0), F.lit(1)).alias("cut"), T.slice_text(F.col("toks"), F.col("sp"), F.lit(0), F.lit(1), raw=True).alias("raw"), T.token_word_count(F.col("toks"), F.col("sp")).alias("n")).first()
    assert (got["all"], got.cut, got.raw) == ("Ein Satz -Teil.", "Ein", "Ein ")

"""Forgiving comparison of what was said or written with the reference text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as t

from lectern.functions.text import NUMBER_WORDS

#: Share of matched words that passes.
PASS = 0.75
_DROPPED = re.compile("[^a-z0-9äöü]")


@lru_cache(100_000)
def norm_word(word: str) -> str:
    return _DROPPED.sub("", unicodedata.normalize("NFC", word).lower().replace("ß", "ss"))


def norm_words(text: str) -> list[str]:
    """Words of what was said; characters that belong to no word part words."""
    return _DROPPED.sub(" ", unicodedata.normalize("NFC", text).lower().replace("ß", "ss")).split()


def number_of(word: str) -> int | None:
    return int(word) if word.isascii() and word.isdigit() else NUMBER_WORDS.get(word)


def within(a: str, b: str, most: int) -> bool:
    """Whether two words are at most so many edits apart; works on a band as wide as the limit."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                new[j] = i
            else:
                new[j] = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        row = new
    return row.get(len(b), far) <= most


@lru_cache(200_000)
def words_match(ref: str, hyp: str) -> bool:
    """Equal, or the same number, or close; two different numbers never match."""
    if not ref or not hyp or ref == hyp:
        return bool(ref) and ref == hyp
    a, b = number_of(ref), number_of(hyp)
    if a is not None and b is not None:
        return a == b
    return within(ref, hyp, 1 if len(ref) <= 5 else 2)


def matched_words(ref: list[str], hyp: list[str]) -> list[bool]:
    """Which reference words some spoken word matches, in order.

    A mismatch costs more than leaving both words out, so the best alignment is a longest common subsequence under
    the forgiving match; among equals the latest pairs are taken.
    """
    n, m = len(ref), len(hyp)
    length = [[0] * (m + 1) for _ in range(n + 1)]
    same = [[words_match(r, h) for h in hyp] for r in ref]
    for i in range(n):
        for j in range(m):
            length[i + 1][j + 1] = length[i][j] + 1 if same[i][j] and length[i][j] + 1 >= max(length[i][j + 1], length[i + 1][j]) else max(length[i][j + 1], length[i + 1][j])
    marks, i, j = [False] * n, n, m
    while i and j:
        if same[i - 1][j - 1] and length[i][j] == length[i - 1][j - 1] + 1:
            marks[i - 1] = True
            i, j = i - 1, j - 1
        elif length[i][j] == length[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return marks


def score(reference: str | None, hypothesis: str | None, discount: list[bool] | None = None) -> dict:
    """Score, matched and total words, and for each displayed token whether it was said (None: not scored).

    Discounted words take part in the alignment but missing them costs nothing. Nothing to score is a full score.
    """
    shown = (reference or "").split()
    norm = [norm_word(w) for w in shown]
    marks = iter(matched_words([w for w in norm if w], norm_words(hypothesis or "")))
    tokens, matched, total = [], 0, 0
    for k, (display, word) in enumerate(zip(shown, norm)):
        ok = next(marks) if word else None
        if word and discount and k < len(discount) and discount[k]:
            ok = True if ok else None
        elif word:
            total += 1
            matched += ok
        tokens.append({"display": display, "ok": ok})
    return {"score": matched / total if total else 1.0, "matched": matched, "total": total, "tokens": tokens}


def best_alternative(reference: str, alternatives: list[str], discount: list[bool] | None = None) -> tuple[int, dict]:
    """Number and score of the best of several transcripts; the earliest of equals."""
    scored = [score(reference, a, discount) for a in alternatives]
    best = max(range(len(scored)), key=lambda k: (scored[k]["score"], -k))
    return best, scored[best]


# Spelled out, since a worker that imports this module has no session to parse a type string.
_TOKEN = t.StructType([t.StructField("display", t.StringType()), t.StructField("ok", t.BooleanType())])
SCORE = t.StructType([t.StructField("score", t.DoubleType()), t.StructField("matched", t.IntegerType()), t.StructField("total", t.IntegerType()), t.StructField("tokens", t.ArrayType(_TOKEN))])
_SCORE_ARROW = pa.struct([("score", pa.float64()), ("matched", pa.int32()), ("total", pa.int32()), ("tokens", pa.list_(pa.struct([("display", pa.string()), ("ok", pa.bool_())])))])


@F.arrow_udf(SCORE)
def score_udf(reference: pa.Array, hypothesis: pa.Array, discount: pa.Array) -> pa.Array:
    return pa.array([score(r, h, d) for r, h, d in zip(reference.to_pylist(), hypothesis.to_pylist(), discount.to_pylist())], _SCORE_ARROW)

"""Repetition inside a single document.

The share of a document is the part of its words that lies in runs of five or more words which already occurred
earlier in it. Words are unbroken runs of letters, case disregarded. A cascade of cheap rules, each of which can only
reject, comes before the exact count; the order of the rules is chosen on a sample by rejection per cost and has no
influence on the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow import as_array, by_bytes

#: Words in a repeated run, and the share from which a document counts as repetitive.
RUN_WORDS = 5
THRESHOLD = 0.3
#: Texts on which the order of the rules is estimated.
SAMPLE_TEXTS = 500
#: Characters handled at once.
BLOCK = 8_000_000


class Words:
    """The words of some texts as integers, ordered by text."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern_regex(pc.utf8_lower(as_array(texts).fill_null("")), r"\PL+")
        words = pc.list_flatten(lists)
        owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
        coded = words.filter(pa.array(full)).dictionary_encode()
        self.n = len(texts)
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(coded) else np.zeros(0, np.int64)
        self.owner = owner[full]
        self.count = np.bincount(self.owner, minlength=self.n)

    def keep(self, rows: np.ndarray) -> "Words":
        """The same restricted to some texts, which keep their numbers."""
        out = object.__new__(Words)
        mask = np.zeros(self.n, bool)
        mask[rows] = True
        chosen = mask[self.owner]
        out.n, out.ids, out.owner = self.n, self.ids[chosen], self.owner[chosen]
        out.count = np.bincount(out.owner, minlength=self.n)
        return out


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) if len(keys) else keys


def _grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the word runs of a size that stay inside one text, and an exact code for (text, run)."""
    n = len(words.ids)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = int(words.ids.max()) + 1
    code = words.ids.copy()
    for step in range(1, size):
        # Codes are ranked anew at each step, so that they never overflow or collide.
        if step > 1:
            code = _ranked(code)
        code = code[: n - step] * base + words.ids[step:]
    starts = np.flatnonzero(words.owner[: n - size + 1] == words.owner[size - 1 :])
    code = _ranked(code[starts])
    return starts, code * words.n + words.owner[starts]


def _covered(words: Words, size: int, all_copies: bool) -> np.ndarray:
    """Share of each text's words inside runs of a size that recur; with ``all_copies`` the first copy counts too."""
    starts, code = _grams(words, size)
    marks = np.zeros(len(words.ids) + 1, np.int64)
    if len(starts):
        _, first, inverse, times = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        again = times[inverse] > 1 if all_copies else first[inverse] != np.arange(len(code))
        np.add.at(marks, starts[again], 1)
        np.add.at(marks, starts[again] + size, -1)
    covered = np.cumsum(marks)[:-1] > 0
    return np.bincount(words.owner, weights=covered, minlength=words.n) / np.maximum(words.count, 1)


def repeated_share(words: Words, size: int = RUN_WORDS) -> np.ndarray:
    """The exact share of each text."""
    return _covered(words, size, all_copies=False)


def _enough_words(words: Words, threshold: float) -> np.ndarray:
    """A repeated run needs one word more than its length."""
    return words.count > RUN_WORDS


def _few_distinct(words: Words, threshold: float) -> np.ndarray:
    """Every word of a repeated run has occurred before, so new words bound the share from above."""
    pairs = np.unique(words.ids * words.n + words.owner)
    distinct = np.bincount(pairs % words.n, minlength=words.n)
    return 1 - distinct / np.maximum(words.count, 1) >= threshold - 1e-9


def _recurring_pairs(words: Words, threshold: float) -> np.ndarray:
    """Words of a repeated run lie in word pairs that recur."""
    return _covered(words, 2, all_copies=True) >= threshold - 1e-9


def _recurring_triples(words: Words, threshold: float) -> np.ndarray:
    """Words of a repeated run lie in word triples that recur."""
    return _covered(words, 3, all_copies=True) >= threshold - 1e-9


RULES: dict[str, Callable[[Words, float], np.ndarray]] = {
    "enough_words": _enough_words,
    "few_distinct": _few_distinct,
    "recurring_pairs": _recurring_pairs,
    "recurring_triples": _recurring_triples,
}


def plan_rules(texts: pa.Array, threshold: float = THRESHOLD) -> list[str]:
    """Rule names by rejection per cost on a sample; a rule that rejects nothing the earlier ones let through is left out."""
    words = Words(texts)
    if not words.n:
        return list(RULES)
    alive, left, order = np.arange(words.n), dict(RULES), []
    while left and len(alive):
        scored = []
        part = words.keep(alive)
        for name, rule in left.items():
            began = time.perf_counter()
            passed = rule(part, threshold)[alive]
            scored.append(((~passed).sum() / (time.perf_counter() - began + 1e-6), name, passed))
        score, name, passed = max(scored, key=lambda s: s[:2])
        if score <= 0:
            break
        order.append(name)
        del left[name]
        alive = alive[passed]
    return order


def _measurer(order: list[str] | None, threshold: float):
    """With rules only the documents at or over the threshold come out; without, all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BLOCK):
            words = Words(as_array(batch.column("text")))
            alive, part = np.arange(words.n), words
            for name in order or ():
                alive = alive[RULES[name](part, threshold)[alive]]
                part = words.keep(alive)
            share = repeated_share(part)[alive]
            if order is not None:
                hit = share >= threshold - 1e-9
                alive, share = alive[hit], share[hit]
            keys = batch.column("key").take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([keys, pa.array(words.count[alive].astype(np.int32)), pa.array(share)], ["key", "words", "share"])

    return run


def repetition(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, share) of every row; null, empty and wordless texts have share 0."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(_measurer(None, THRESHOLD), f"key {dict(docs.dtypes)[key]}, words int, share double").withColumnRenamed("key", key)


def repetitive(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, words, share) of the rows whose share reaches the threshold, by the cascade.

    The order of the rules comes from up to ``SAMPLE_TEXTS`` texts; any order gives the same rows. Repeated rows come
    out each for itself. ``threshold`` must be above 0.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sample = [r[0] for r in slim.select("text").where(F.col("text").isNotNull()).limit(SAMPLE_TEXTS).collect()]
    order = plan_rules(pa.array(sample, pa.string()), threshold)
    # The exact count closes the cascade whatever the sample said.
    return slim.mapInArrow(_measurer(order, threshold), f"key {dict(docs.dtypes)[key]}, words int, share double").withColumnRenamed("key", key)

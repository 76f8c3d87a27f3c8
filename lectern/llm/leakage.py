"""Evaluation passages leaking into training text.

Word n-grams of the passages are kept as a sorted set that every task gets; windows of the documents are looked up in
it, hits are extended to maximal equal runs, and each run is extended word by word, over exchanged, omitted and added
words, to the longest alignment through it that is valid. Passages are taken in blocks of bounded size, so that what is broadcast never grows with the evaluation set.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow import as_array, by_bytes
from lectern.llm.mojibake import repair

#: Words of a seed. With one word in eight exchanged, some run of at least four words is always left whole: twelve
#: words with one exchanged keep six in a row, sixteen with two keep five.
SEED_WORDS = 4
#: Words of the passage a leak holds in a row, and the words for each exchanged one.
MIN_WORDS = 12
WORDS_PER_ERROR = 7
#: A first sentence that so many items share is an instruction, no part of the passage.
INSTRUCTION_ITEMS = 3
#: Seeds of one broadcast block.
BLOCK_SEEDS = 1_000_000

_JOIN = r"(?:[-'’‐‑­]|[-‐­][ \t]*\r?\n[ \t]*(?:[0-9]+[ \t|.:)\]]*)?)"
_WORD = re.compile(rf"[^\W\d_]+(?:{_JOIN}[^\W\d_]+)*")
_LETTER = re.compile(r"[\W\d_]+")
_DIGRAPH = re.compile(r"([aou])e")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+")


def fold(word: str) -> str:
    """One form for case, accents, their ASCII spellings, hyphens and apostrophes."""
    word = word.lower()
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word.replace("ß", "ss")) if not unicodedata.combining(c))
    if not word.isalpha():
        word = _LETTER.sub("", word)
    return _DIGRAPH.sub(r"\1", word).replace("ss", "s")


class Folder(dict):
    """Folded forms of raw words, computed once each."""

    def __missing__(self, raw: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[raw] = folded = fold(raw)
        return folded


def clean(text: str) -> str:
    """NFC with garbled places restored."""
    return text if text.isascii() else unicodedata.normalize("NFC", repair(text)[0])


def words_of(text: str, folder: Folder) -> list[str]:
    return [folder[raw] for raw in _WORD.findall(clean(text))]


def passages(items: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """Folded words of each item without its instruction line; null and empty items have none."""
    folder = Folder()
    split = [(key, _SENTENCE.split(text.strip(), maxsplit=1)) for key, text in items if text]
    shared = Counter(parts[0] for _, parts in split if len(parts) > 1)
    return [(key, words_of(parts[1] if len(parts) > 1 and shared[parts[0]] >= INSTRUCTION_ITEMS else " ".join(parts), folder)) for key, parts in split]


class SeedIndex:
    """The seeds of some passages: sorted codes and, for each, the places it stands at."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.keys = [key for key, _ in items]
        vocabulary: dict[str, int] = {}
        self.words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for _, words in items]
        self.vocabulary = vocabulary
        self.base = len(vocabulary) + 1
        if self.base ** SEED_WORDS >= 2**63:
            raise ValueError("a block of passages has too many distinct words")
        codes, owner, place = [], [], []
        for i, ids in enumerate(self.words):
            code = self.codes(ids)
            codes.append(code)
            owner.append(np.full(len(code), i))
            place.append(np.arange(len(code)))
        codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.seeds = codes[order]
        self.owner = np.concatenate(owner)[order] if len(order) else codes
        self.place = np.concatenate(place)[order] if len(order) else codes

    def codes(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - SEED_WORDS + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code = ids[:n].copy()
        for step in range(1, SEED_WORDS):
            code = code * self.base + ids[step : step + n]
        return code

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known seeds and their first places in the sorted list; -1 stands for a word of no passage."""
        known = np.concatenate([[0], np.cumsum(ids < 0)])
        n = len(ids) - SEED_WORDS + 1
        if n <= 0 or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.flatnonzero(known[SEED_WORDS : SEED_WORDS + n] == known[:n])
        code = ids[starts].copy()
        for step in range(1, SEED_WORDS):
            code = code * self.base + ids[starts + step]
        at = np.searchsorted(self.seeds, code)
        found = at < len(self.seeds)
        found[found] = self.seeds[at[found]] == code[found]
        return starts[found], at[found]


def _reach(doc: list[int], item: list[int], most: int) -> list[tuple[int, int]]:
    """For each number of errors up to ``most``, the most words of the passage that equal the start of ``doc`` up to so many errors, and
    the words of ``doc`` these take. The last word of both is equal, so errors at the end are never taken in.

    Diagonals are extended by one error at a time to the furthest equal word (Landau and Vishkin).
    """
    n, m = len(item), len(doc)
    out: list[tuple[int, int]] = []
    furthest: dict[int, int] = {}
    for errors in range(most + 1):
        best = out[-1] if out else (0, 0)
        row: dict[int, int] = {}
        for k in range(-errors, errors + 1):  # words of the text less words of the passage
            i = max(furthest.get(k, -2) + 1, furthest.get(k + 1, -2) + 1, furthest.get(k - 1, -1)) if errors else 0
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and item[i] == doc[i + k]:
                i += 1
            row[k] = i
            while i > best[0] and i + k > 0 and item[i - 1] != doc[i + k - 1]:
                i -= 1
            if i > best[0] and i + k > 0:
                best = (i, i + k)
        furthest = row
        out.append(best)
        if best[0] == n:
            break
    return out


def _runs(seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(document start, document end, item start) of the longest runs of equal words that the seeds make up."""
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for d, i in seeds:
        by_diagonal[d - i].append(d)
    runs = []
    for diagonal, starts in by_diagonal.items():
        starts = sorted(set(starts))
        begin = prev = starts[0]
        for s in [*starts[1:], None]:
            if s is None or s > prev + 1:
                runs.append((begin, prev + SEED_WORDS, begin - diagonal))
                begin = s
            prev = s
    return sorted(runs)


def _align(doc: np.ndarray, item: np.ndarray, run: tuple[int, int, int]) -> tuple[int, int, int, int] | None:
    """(words of the passage, errors, document start, document end) of the longest valid alignment through a run."""
    a, b, x = run
    middle = (a + b) // 2  # both ways from here, as a word at the edge of the run may stand for its double beyond it
    y = x + middle - a
    most = len(item) // WORDS_PER_ERROR
    left = _reach(doc[max(0, middle - y - most) : middle][::-1].tolist(), item[:y][::-1].tolist(), most)
    right = _reach(doc[middle : middle + len(item) - y + most].tolist(), item[y:].tolist(), most)
    best = None
    for e, (before, back) in enumerate(left):
        for f, (after, on) in enumerate(right):
            length = before + after
            if length >= MIN_WORDS and (e + f) * WORDS_PER_ERROR <= length and (best is None or (length, -e - f) > (best[0], -best[1])):
                best = (length, e + f, middle - back, middle + on)
    return best


def _rank(got: tuple[int, int, int, int]) -> tuple[int, int, int]:
    return got[0], -got[1], -got[2]


def verify(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
    """(words of the passage, errors, document start, document end) of the longest valid alignment, if any."""
    return max((got for run in _runs(seeds) if (got := _align(doc, item, run))), key=_rank, default=None)


def verify_all(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """The longest valid alignment, then the longest before and after it in the document, and so on: all are disjoint there."""
    out = []
    parts = [(0, len(doc), [(run, got) for run in _runs(seeds) if (got := _align(doc, item, run))])]
    while parts:
        lo, hi, known = parts.pop()
        inside = []
        for (a, b, x), got in known:
            if got[2] < lo or got[3] > hi:
                start, end = max(a, lo), min(b, hi)
                again = _align(doc[lo:hi], item, (start - lo, end - lo, x + start - a)) if end - start >= SEED_WORDS else None
                if again is None:
                    continue
                (a, b, x), got = (start, end, x + start - a), (*again[:2], again[2] + lo, again[3] + lo)
            inside.append(((a, b, x), got))
        if inside:
            best = max((got for _, got in inside), key=_rank)
            out.append(best)
            parts += [(lo, best[2], [k for k in inside if k[0][0] < best[2]]), (best[3], hi, [k for k in inside if k[0][1] > best[3]])]
    return sorted(out, key=lambda got: got[2])


def _scan(index: SeedIndex, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, get = Folder(), index.vocabulary.get
        for batch in by_bytes(batches, "text"):
            texts = as_array(batch.column("text")).to_pylist()
            rows, keys, spans = [], [], []
            ids, owner, begin = [], [], []
            for row, text in enumerate(texts):
                begin.append(len(ids))
                if text:
                    ids += [get(w, -1) for w in words_of(text, folder)]
                    ids += [-1] * SEED_WORDS  # no seed across two texts
            begin.append(len(ids))
            ids, begin = np.array(ids, np.int64), np.array(begin)
            spots, at = index.hits(ids)
            which = np.searchsorted(begin, spots, side="right") - 1
            pairs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for spot, first, row in zip(spots.tolist(), at.tolist(), which.tolist()):
                code = index.seeds[first]
                while first < len(index.seeds) and index.seeds[first] == code:
                    pairs[row, int(index.owner[first])].append((spot - int(begin[row]), int(index.place[first])))
                    first += 1
            for (row, item), seeds in sorted(pairs.items()):
                doc = ids[begin[row] : begin[row + 1]]
                for got in verify_all(doc, index.words[item], seeds) if every else filter(None, [verify(doc, index.words[item], seeds)]):
                    rows.append(row)
                    keys.append(index.keys[item])
                    spans.append(got)
            out = [
                batch.column("key").take(pa.array(rows, pa.int64())),
                pa.array(keys, pa.int64()),
                *[pa.array([s[i] for s in spans], pa.int32()) for i in range(4)],
            ]
            if rows:
                yield pa.RecordBatch.from_arrays(out, ["key", "item_id", "words", "errors", "start_word", "end_word"])

    return run


def _item_blocks(items: DataFrame, item_key: str, item_text: str) -> Iterator[SeedIndex]:
    """Indexes over all items, each of bounded size; one block for an evaluation set of usual size."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).cast("long"), item_text).dropDuplicates().orderBy(item_key, item_text).toLocalIterator()
    for key, text in rows:
        block.append((key, text))
        size += len(text.split())
        if size >= BLOCK_SEEDS:
            yield SeedIndex(passages(block))
            block, size = [], 0
    if block:
        yield SeedIndex(passages(block))


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str = "item_id", item_text: str = "text", every: bool = False) -> DataFrame:
    """(key, item_id, words, errors, start_word, end_word): each document and item it leaks, with the longest leak.

    With ``every``, all leaks of an item that are disjoint in the document, a row for each.

    A leak is at least ``MIN_WORDS`` words in a row of the passage with at most one word in ``WORDS_PER_ERROR``
    exchanged, left out or put in, whatever the case, punctuation, layout, line numbers, hyphenation or accents.
    Null and empty texts and items have none; items of the same id leak together; repeated rows come out each.
    """
    kind = dict(docs.dtypes)[key]
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, item_id long, words int, errors int, start_word int, end_word int"
    found = None
    for index in _item_blocks(items, item_key, item_text):
        part = slim.mapInArrow(_scan(index, every), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("key", key)


def remove_span(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without some word intervals, each given as counted by this module."""
    text = clean(text)
    marks = [m.span() for m in _WORD.finditer(text)]
    for a, b in sorted(spans, reverse=True):
        if 0 <= a < b <= len(marks):
            text = text[: marks[a][0]].rstrip() + " " + text[marks[b - 1][1] :].lstrip(" ,;:.!?")
    return text.strip()


def decontaminate(docs: DataFrame, key: str, text: str, items: DataFrame, mode: str = "documents") -> DataFrame:
    """The corpus without leaking documents, or with the leaking spans cut out (``mode='spans'``). Keys must be unique."""
    found = leaks(docs, key, text, items, every=mode == "spans")
    if mode == "documents":
        return docs.join(found.select(key).distinct(), key, "left_anti")
    spans = found.groupBy(key).agg(F.collect_set(F.struct("start_word", "end_word")).alias("__spans"))

    @F.pandas_udf("string")
    def cut(texts, spans_of):
        import pandas as pd

        return pd.Series([remove_span(t, [(s["start_word"], s["end_word"]) for s in merged(sp)]) if sp is not None else None for t, sp in zip(texts, spans_of)])

    def merged(spans):
        out: list[dict] = []
        for s in sorted(({"start_word": x["start_word"], "end_word": x["end_word"]} for x in spans), key=lambda s: (s["start_word"], s["end_word"])):
            if out and s["start_word"] < out[-1]["end_word"]:
                out[-1]["end_word"] = max(out[-1]["end_word"], s["end_word"])
            else:
                out.append(s)
        return out

    joined = docs.join(spans, key, "left")
    hit = F.col("__spans").isNotNull()
    return joined.withColumn(text, F.when(hit, cut(F.when(hit, F.col(text)), F.col("__spans"))).otherwise(F.col(text))).select(*docs.columns)

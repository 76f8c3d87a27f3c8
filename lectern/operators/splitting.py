"""Cutting oversized items at natural boundaries with balanced targets.

For an item of W units and a limit of L units, with an overlap of o units between neighbours, the least piece count is
n = ceil((W - o) / (L - o)). The n - 1 cuts are first placed at equal distances; each is then snapped to the strongest
boundary nearby. If a piece breaks the limit, n grows by one and the windows shrink, until every piece fits; with no
window left the equal targets themselves fit, so the search always ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow import as_array, flat_strings

#: Words a piece of each level may have.
LIMITS = {"starter": 4, "beginner": 6, "intermediate": 9, "advanced": 13}
#: Words that a piece repeats from the one before.
OVERLAP = 1
#: Strength of a boundary that only a rung names.
RUNG_STRENGTH = 100


def balanced_cuts(words: Sequence[int], limit: int, overlap: int = 0, strength: dict[int, float] | None = None) -> list[tuple[int, int]]:
    """Pieces (start, end) of a token list, in tokens; ``words`` holds the running word count, one entry more than tokens.

    Each piece has at most ``limit`` words, its repeated words included. All pieces but the first start ``overlap``
    words before the end of the one before. Without words or below the limit there is one piece. ``overlap`` must be
    less than ``limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    words = np.asarray(words, dtype=np.int64)
    n_tokens, total = len(words) - 1, int(words[-1])
    if total <= limit:
        return [(0, n_tokens)] if n_tokens > 0 else []
    marks = sorted((k, s) for k, s in (strength or {}).items() if 0 < k < n_tokens)
    spots = np.array([k for k, _ in marks], dtype=np.int64)
    force = np.array([s for _, s in marks], dtype=np.float64)
    at_word = words[spots] if len(spots) else spots
    count = -(-(total - overlap) // (limit - overlap))
    while True:
        step = total / count
        # A window of under half a step keeps cuts in order; it closes as pieces near single words.
        window = 0.45 * step if step >= 2 else 0.0
        cuts, last = [], 0
        for i in range(1, count):
            target = i * step
            lo, hi = np.searchsorted(at_word, [target - window, target + window + 1e-9])
            best = None
            for j in range(lo, hi):
                if at_word[j] <= last or at_word[j] >= total:
                    continue
                key = (-force[j], abs(at_word[j] - target), int(spots[j]))
                if best is None or key < best[0]:
                    best = (key, int(spots[j]), int(at_word[j]))
            if best is None:
                want = max(last + 1, round(target))
                token = int(np.searchsorted(words, want, side="left"))
                best = (None, token, want)
            cuts.append(best[1])
            last = best[2]
        pieces = _pieces(words, cuts, overlap)
        if all(words[b] - words[a] <= limit for a, b in pieces):
            return pieces
        if count >= total:  # single words with what they repeat
            cuts = [int(np.searchsorted(words, w, side="left")) for w in range(limit - overlap, total, limit - overlap)]
            return _pieces(words, cuts, overlap)
        count += 1


def _pieces(words: np.ndarray, cuts: list[int], overlap: int) -> list[tuple[int, int]]:
    edges = [0, *cuts, len(words) - 1]
    pieces = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        if i and overlap:
            back = max(0, int(words[a]) - overlap)
            a = int(np.searchsorted(words, back, side="right")) - 1
        pieces.append((a, b))
    return pieces


def clean_positions(positions, n_tokens: int) -> list[int]:
    """Positions strictly inside the sentence, unique and in order."""
    return sorted({k for k in positions or () if k is not None and 0 < k < n_tokens})


def split_levels(words: np.ndarray, breaks, cuts: dict, rungs, limits: dict[str, int], overlap: int) -> list[dict]:
    """The levels whose stored pieces break the limit, each with all pieces after the repair."""
    n_tokens = len(words) - 1
    found = []
    strength = None
    for level, limit in limits.items():
        edges = [0, *clean_positions(cuts.get(level), n_tokens), n_tokens]
        sizes = [int(words[b] - words[a]) for a, b in zip(edges, edges[1:])]
        if max(sizes, default=0) <= limit:
            continue
        if strength is None:
            strength = {}
            for spot in breaks or ():
                if spot and spot["k"] is not None:
                    strength[spot["k"]] = max(strength.get(spot["k"], 0.0), float(spot["s"] or 0))
            for depth, rung in enumerate(rungs or ()):
                for k in rung or ():
                    if k is not None:
                        strength[k] = max(strength.get(k, 0.0), RUNG_STRENGTH - depth)
        pieces = []
        for a, b, size in zip(edges, edges[1:], sizes):
            if size <= limit:
                pieces.append((a, b))
                continue
            inner = {k - a: s for k, s in strength.items() if a < k < b}
            pieces += [(a + x, a + y) for x, y in balanced_cuts(words[a : b + 1] - words[a], limit, overlap, inner)]
        found.append({"level": level, "longest": max(sizes), "pieces": [{"a": a, "b": b} for a, b in pieces]})
    return found


def oversized(cuts: pa.Array, starts: np.ndarray, sizes: np.ndarray, running: np.ndarray, limits: dict[str, int]) -> np.ndarray:
    """Rows with a stored piece over the limit of some level, from the columns of a whole batch.

    ``running`` counts the words before each token of the batch, ``starts`` and ``sizes`` place the rows in it.
    """
    n = len(sizes)
    bad = np.zeros(n, bool)
    some = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
    maps = cuts.take(pa.array(some))
    offsets = maps.offsets.to_numpy()
    keys = maps.keys.slice(offsets[0], offsets[-1] - offsets[0])
    items = maps.items.slice(offsets[0], offsets[-1] - offsets[0])
    entry_row = np.repeat(some, np.diff(offsets))
    spots = pc.fill_null(pc.list_flatten(items), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entry = pc.list_parent_indices(items).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.flatnonzero(sizes > 0)
    ends = starts + sizes
    for level, limit in limits.items():
        own = pc.fill_null(pc.equal(keys, level), False).to_numpy(zero_copy_only=False)[entry] if len(entry) else np.zeros(0, bool)
        row, spot = entry_row[entry[own]], spots[own]
        inside = (spot > 0) & (spot < sizes[row])
        edge_row = np.concatenate([row[inside], rows, rows])
        edge = np.concatenate([starts[row[inside]] + spot[inside], starts[rows], ends[rows]])
        order = np.lexsort((edge, edge_row))
        edge_row, words = edge_row[order], running[edge[order]]
        over = (np.diff(words) > limit) & (edge_row[1:] == edge_row[:-1])
        bad[edge_row[1:][over]] = True
    return bad


SPLIT = "array<struct<level: string, longest: int, pieces: array<struct<a: int, b: int>>>>"
_SPLIT_ARROW = pa.list_(pa.struct([("level", pa.string()), ("longest", pa.int32()), ("pieces", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))


def _splitter(limits: dict[str, int], overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            toks = as_array(batch.column("toks"))
            flat, _ = flat_strings(toks)
            is_word = pc.fill_null(pc.match_substring_regex(flat, r"[\pL\pN]"), False)
            running = np.concatenate([[0], np.cumsum(is_word.to_numpy(zero_copy_only=False).astype(np.int64))])
            sizes = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            chosen = np.flatnonzero(oversized(as_array(batch.column("cuts")), starts, sizes, running, limits))
            breaks, cuts, rungs = (as_array(batch.column(c)).take(pa.array(chosen)).to_pylist() for c in ("breaks", "cuts", "rungs"))
            out: list[list[dict]] = [[] for _ in range(n)]
            for i, row in enumerate(chosen):
                part = running[starts[row] : ends[row] + 1]
                out[row] = split_levels(part - part[0], breaks[i], dict(cuts[i] or ()), rungs[i], limits, overlap)
            yield pa.RecordBatch.from_arrays([batch.column("sent_key"), batch.column("loaded_at"), pa.array(out, _SPLIT_ARROW)], ["sent_key", "loaded_at", "split"])

    return run


def split_sentences(sentences: DataFrame, limits: dict[str, int] = LIMITS, overlap: int = OVERLAP) -> DataFrame:
    """(sent_key, level, longest, pieces) for each sentence and level with a piece over the limit.

    ``longest`` is the word count of the longest stored piece, ``pieces`` all pieces after the repair as token
    intervals; those made by the repair start ``overlap`` words early. Of a sentence delivered again only the latest
    delivery counts. Null or missing cuts mean one piece; null, repeated, unordered or outside positions make no
    difference; null or empty token lists and null keys give no row.
    """
    slim = sentences.where(F.col("sent_key").isNotNull()).select("sent_key", "loaded_at", "toks", "breaks", "cuts", "rungs")
    cut = slim.mapInArrow(_splitter(dict(limits), overlap), f"sent_key string, loaded_at timestamp, split {SPLIT}")
    # A null loaded_at counts as the oldest; among equals the greatest result wins, so the answer is defined.
    latest = cut.groupBy("sent_key").agg(F.max(F.struct("loaded_at", "split")).alias("m"))
    return latest.select("sent_key", F.explode("m.split").alias("s")).select("sent_key", "s.level", "s.longest", "s.pieces")

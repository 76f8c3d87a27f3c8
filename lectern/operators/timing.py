"""Word timings: aligning spoken words with displayed runs."""

from __future__ import annotations

from collections.abc import Callable

#: Cost of each unit beyond one, most units on one side, and the cost a word that is still plausible. Fixed values.
EXTRA, GROUP, PLAUSIBLE = 2.0, 3, 3.0


def align(words: list[int], runs: list[int]) -> list[tuple[int, int]] | None:
    """Groups (words, runs) that pair spoken lengths with displayed ones: one word for up to three runs, or the reverse.

    None if nothing fits or the fit is implausible.
    """
    if not words or not runs:
        return None
    # From long to short on either side, so that among equals the earliest start wins.
    steps = [(k, 1) for k in range(GROUP, 1, -1)] + [(1, k) for k in range(GROUP, 0, -1)]
    upto_w, upto_r = [0], [0]
    for sums, lengths in ((upto_w, words), (upto_r, runs)):
        for n in lengths:
            sums.append(sums[-1] + n)
    best: dict[tuple[int, int], tuple[float, tuple[int, int]]] = {(0, 0): (0.0, (0, 0))}
    for i in range(1, len(words) + 1):
        for j in range(1, len(runs) + 1):
            for a, b in steps:
                before = best.get((i - a, j - b))
                if before is None:
                    continue
                cost = before[0] + abs((upto_w[i] - upto_w[i - a]) - (upto_r[j] - upto_r[j - b])) + EXTRA * (a + b - 2)
                if (i, j) not in best or cost < best[i, j][0]:
                    best[i, j] = (cost, (a, b))
    end = best.get((len(words), len(runs)))
    if end is None or end[0] / len(words) > PLAUSIBLE:
        return None
    groups, i, j = [], len(words), len(runs)
    while i or j:
        a, b = best[i, j][1]
        groups.append((a, b))
        i, j = i - a, j - b
    return groups[::-1]


def run_ends(phonemes: list[str], word_ends: list[float], runs: list[str], solo: Callable[[str], int]) -> list[float] | None:
    """End time of every displayed run; fused runs share their word's time by solo length, mere marks take the end before."""
    spoken = [k for k, r in enumerate(runs) if any(c.isalnum() for c in r)]
    lengths = [max(1, solo(runs[k])) for k in spoken]
    groups = [(1, 1)] * len(spoken) if len(phonemes) == len(spoken) else align([len(p) for p in phonemes], lengths)
    if groups is None:
        return None
    ends: dict[int, float] = {}
    w = r = 0
    start = 0.0
    for a, b in groups:
        w += a
        stop, part, total = word_ends[w - 1], 0, sum(lengths[r : r + b])
        for k in range(r, r + b):
            part += lengths[k]
            ends[spoken[k]] = stop if k == r + b - 1 else start + (stop - start) * part / total
        r, start = r + b, stop
    out, last = [], 0.0
    for k in range(len(runs)):
        last = ends.get(k, last)
        out.append(round(last, 3))
    return out


def parse_sections(spec: str, n: int) -> set[int]:
    """Zero-based sections of a list such as 1,3-5; a section that does not exist is an error."""
    chosen: set[int] = set()
    for part in spec.split(","):
        first, _, last = part.strip().partition("-")
        chosen.update(range(int(first), int(last or first) + 1))
    if outside := sorted(k for k in chosen if not 1 <= k <= n):
        raise ValueError(f"no section {outside}; there are {n}")
    return {k - 1 for k in chosen}

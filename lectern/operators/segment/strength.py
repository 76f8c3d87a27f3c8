"""Where a parsed sentence may be cut, and how strongly."""

from __future__ import annotations

from collections.abc import Callable

from lectern.operators.segment.parse import DASHES, FINITE, NOMINAL, PREDICATE, RELATIVE, VERBAL, Parsed

FORWARD, BACK, FREE = 1, -1, 0
STRONG_MARKS = frozenset({";", ":", "--"})
SEVER_PENALTY = 35


def bracket_end(p: Parsed, i: int) -> bool:
    """Right member of an analytic verb form, with no infinitive marker of its own."""
    r = p.roles
    return bool(r.bracket) and p.dep[i] == r.bracket and p.tag[i] in r.bracket_tags and not any(p.dep[c] in r.zu_deps or p.tag[c] in r.zu_tags for c in p.kids[i])


def _argument(p: Parsed, i: int) -> bool:
    return p.dep[i] in p.roles.subject or p.dep[i] in p.roles.object


def _preposition(p: Parsed, i: int) -> int:
    if p.governs_right(i) or p.head[i] > i:
        return FORWARD
    return BACK if p.head[i] < i else FREE


#: The decision list of leaning: the first rule that applies gives the verdict.
LEANINGS: list[tuple[Callable[[Parsed, int], bool], Callable[[Parsed, int], int] | int]] = [
    (lambda p, i: p.punct[i], FREE),
    (lambda p, i: p.pos[i] in ("CCONJ", "SCONJ") or p.dep[i] in p.roles.coord | p.roles.marker or p.tag[i] in RELATIVE or p.tag[i] in p.roles.infinitive, FORWARD),
    (lambda p, i: p.tag[i] == "PTKNEG" and i + 1 < len(p) and p.pos[i + 1] in VERBAL, FORWARD),
    (lambda p, i: p.dep[i] in p.roles.fused, lambda p, i: FORWARD if p.head[i] > i else BACK),
    (lambda p, i: p.pos[i] == "DET", lambda p, i: FORWARD if p.head[i] > i else FREE),
    (lambda p, i: p.pos[i] == "ADP", _preposition),
    (lambda p, i: p.pos[i] == "PRON" and p.head[i] > i and _argument(p, i), FORWARD),
    (lambda p, i: p.pos[i] == "PRON" and p.head[i] == i - 1 and p.pos[i - 1] in VERBAL and _argument(p, i), BACK),
    (lambda p, i: p.head[i] < i and bracket_end(p, i), BACK),
    (lambda p, i: p.pos[i] in ("ADV", "NUM") and p.head[i] == i + 1, FORWARD),
    (lambda p, i: p.pos[i] in ("ADV", "ADJ") and p.head[i] > i and p.pos[p.head[i]] == "ADJ", FORWARD),
]


def lean(p: Parsed, i: int) -> int:
    """Whether a token may not end a piece (FORWARD), may not start one (BACK), or stands free."""
    for applies, verdict in LEANINGS:
        if applies(p, i):
            return verdict if isinstance(verdict, int) else verdict(p, i)
    return FREE


def word_gap(p: Parsed, k: int) -> bool:
    """Whether a blank stands before token k."""
    return p.blank[k - 1]


def allowed(p: Parsed, k: int) -> bool:
    """Whether a cut between tokens k - 1 and k tears nothing apart."""
    a, b = k - 1, k
    if "-" in (p.text[a], p.text[b]):
        return False
    if not p.punct[a] and not p.punct[b] and not word_gap(p, k):
        return False
    if p.punct[b] and not p.opens(b):
        return False
    if p.opens(a):
        return False
    c = p.content_before[k]
    if c is not None and (c == a or p.pos[c] in ("CCONJ", "SCONJ")) and lean(p, c) == FORWARD:
        return False
    if not p.punct[b] and lean(p, b) == BACK:
        return False
    return not (p.pos[a] in VERBAL and p.pos[b] in VERBAL)


def heads_clause(p: Parsed, i: int) -> bool:
    r = p.roles
    bracket = bracket_end(p, i) and p.pos[p.head[i]] in VERBAL
    if p.dep[i] in r.clause:
        return not bracket
    if p.pos[i] not in VERBAL or p.dep[i] == "ROOT" or p.head[i] == i or bracket:
        return False
    return any(p.dep[c] in r.marker for c in p.kids[i]) or (p.tag[i] in FINITE and p.dep[i] in r.conj)


def severs(p: Parsed, k: int) -> bool:
    """Whether a cut parts a verb from a complement to its right."""
    c = p.content_before[k]
    if c is None or p.pos[c] not in VERBAL:
        return False
    benign = p.roles.benign - PREDICATE if p.lemma[c] in p.roles.copula else p.roles.benign
    return any(x >= k and not p.punct[x] and p.dep[x] not in benign for x in p.kids[c])


def _past_marks(p: Parsed, k: int) -> int:
    while k < len(p) and p.punct[k] and not p.opens(k):
        k += 1
    return k


def _finite(p: Parsed, i: int) -> bool:
    return p.tag[i] in FINITE and p.pos[i] in VERBAL


def comma(p: Parsed, k: int, clause_edges: set[int]) -> int:
    """Strength right after a comma: clause seam, list, apposition, or other."""
    r = p.roles
    c = p.content_before[k]
    if k in clause_edges or (r.clause_comma and (_finite(p, k) or (c == k - 2 and _finite(p, c)))):
        return 85
    in_list = (p.pos[k] == "ADJ" and p.pos[p.head[k]] in NOMINAL | {"ADJ"}) or (p.dep[k] in r.conj and p.pos[k] in NOMINAL | {"ADJ", "NUM"})
    return 15 if in_list else 60 if p.dep[k] in r.phrase else 50


def _closes_speech(p: Parsed, k: int) -> bool:
    j = k - 1
    while j > 0 and p.punct[j] and p.text[j] not in p.roles.closers:
        j -= 1
    return p.punct[j] and p.text[j] in p.roles.closers


def break_strengths(p: Parsed) -> dict[int, int]:
    """Strength of every position where the sentence may be cut."""
    r, n = p.roles, len(p)
    low, high = p.edges
    locked: set[int] = set()
    clause_edges: set[int] = set()
    phrase_edges: dict[int, int] = {}

    def edge(k: int, s: int) -> None:
        if 0 < k < n:
            phrase_edges[k] = max(phrase_edges.get(k, 0), s)

    for i in range(n):
        if p.pos[i] == "ADJ" and p.head[i] > i and p.pos[p.head[i]] in NOMINAL:
            locked.update(range(low[i] + 1, i + 1))
        if p.punct[i]:
            continue
        after = _past_marks(p, high[i] + 1)
        if heads_clause(p, i):
            clause_edges |= {low[i], after}
        if _argument(p, i):
            edge(low[i], 45)
            edge(after, 45)
        elif p.dep[i] in r.modifier and p.pos[i] != "ADP" and p.pos[p.head[i]] in VERBAL:
            edge(low[i], 30)
        elif p.dep[i] not in r.fused:
            edge(low[i], 20)

    def verbal_conjunct(i: int) -> bool:
        return any(p.dep[c] in r.conj and p.pos[c] in VERBAL for c in p.kids[i])

    out = {}
    for k in range(1, n):
        if k in locked or not allowed(p, k):
            continue
        a, b, h = k - 1, k, p.head[k]
        signals = [5, phrase_edges.get(k, 0)]
        if p.punct[a] and p.text[a] in STRONG_MARKS or p.text[b] == "(" or p.text[a] == ")":
            signals.append(100)
        if (p.text[b] in DASHES and p.dashes.get(b)) or (p.text[a] in DASHES and p.dashes.get(a) is False):
            signals.append(100)
        if _closes_speech(p, k):
            signals.append(90)
        if k in clause_edges:
            signals.append(85)
        if p.dep[b] in r.marker or (p.dep[b] in r.conj and p.pos[b] in VERBAL):
            signals.append(80)
        if p.dep[b] in r.coord:
            signals.append(80 if p.pos[h] in VERBAL or verbal_conjunct(h) or verbal_conjunct(b) else 40)
        if p.pos[b] == "ADP" and low[b] == b and p.governs_right(b) and p.dep[b] not in r.particle:
            signals.append(10 if p.pos[h] in NOMINAL | {"PRON", "NUM"} or p.lemma[h] in r.copula else 65)
        if p.tag[b] in r.infinitive:
            signals.append(10 if p.dep[h] in r.tight_infinitive else 65)
        if p.dep[b] in r.phrase:
            signals.append(60)
        listed = False
        if p.text[a] == ",":
            after_comma = comma(p, k, clause_edges)
            listed = after_comma <= 15
            signals.append(after_comma)
        s = max(signals)
        if listed and s < 80:
            s = 15
        if k not in clause_edges and s < 85 and severs(p, k):
            s = max(1, s - SEVER_PENALTY)
        out[k] = s
    return out

"""The annotator contract: a parsed sentence as columns, the roles of its labels by language, and a rule annotator."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

VERBAL = frozenset({"VERB", "AUX"})
NOMINAL = frozenset({"NOUN", "PROPN"})
DASHES = frozenset("—–")


@dataclass(frozen=True)
class Roles:
    """What labels mean in one language's tag sets. Fixed values of the two label schemes."""

    clause: frozenset
    marker: frozenset
    coord: frozenset
    conj: frozenset
    phrase: frozenset
    subject: frozenset
    object: frozenset
    infinitive: frozenset
    fused: frozenset
    benign: frozenset
    modifier: frozenset
    particle: frozenset
    bracket: str | None
    bracket_tags: frozenset
    zu_deps: frozenset
    zu_tags: frozenset
    tight_infinitive: frozenset
    clause_comma: bool
    copula: frozenset
    openers: frozenset
    closers: frozenset


def _s(words: str) -> frozenset:
    return frozenset(words.split())


# Label and mark sets.
ROLES = {
    "en": Roles(
        clause=_s("advcl ccomp relcl acl parataxis csubj"), marker=_s("mark"), coord=_s("cc"), conj=_s("conj"), phrase=_s("appos"),
        subject=_s("nsubj nsubjpass csubj expl"), object=_s("dobj obj attr dative oprd"), infinitive=_s("TO"),
        fused=_s("det poss predet amod compound nummod quantmod aux auxpass neg prt case expl"), benign=_s("prep advmod npadvmod prt cc conj mark dep"),
        modifier=_s("advmod npadvmod"), particle=_s("prt"), bracket=None, bracket_tags=frozenset(), zu_deps=frozenset(), zu_tags=frozenset(),
        tight_infinitive=_s("acl relcl"), clause_comma=False, copula=_s("be"), openers=_s("“ ‘ \" ' ( — –"), closers=_s("” ’"),
    ),
    "de": Roles(
        clause=_s("rc oc par re"), marker=_s("cp"), coord=_s("cd"), conj=_s("cj"), phrase=_s("app"),
        subject=_s("sb sbp"), object=_s("oa da og"), infinitive=_s("PTKZU"), fused=_s("nk pm ng svp nmc ac adc cm avc pnc"), benign=_s("mo svp cd cj par re"),
        modifier=_s("mo"), particle=_s("svp"), bracket="oc", bracket_tags=_s("VVPP VAPP VMPP VVINF VAINF VMINF"), zu_deps=_s("pm"), zu_tags=_s("PTKZU"),
        tight_infinitive=_s("rc acl relcl"), clause_comma=True, copula=frozenset(), openers=_s("„ ‚ » \" ' ( — –"), closers=_s("“ ‘ «"),
    ),
}
FINITE = _s("VVFIN VAFIN VMFIN VBD VBZ VBP MD")
RELATIVE = _s("WDT WP WP$ PRELS PRELAT PWS PWAT PWAV")
#: Relations that stop being detachable under a copula.
PREDICATE = _s("prep acomp attr oprd advmod npadvmod dep")


@dataclass
class Parsed:
    """Columns of a sentence: text, blank after, tag, pos, dep, head (a root points at itself) and lemma."""

    text: list[str]
    blank: list[bool]
    tag: list[str]
    pos: list[str]
    dep: list[str]
    head: list[int]
    lemma: list[str]
    lang: str = "en"
    roles: Roles = field(init=False)

    def __post_init__(self) -> None:
        self.roles = ROLES["de" if self.lang == "de" else "en"]

    def __len__(self) -> int:
        return len(self.text)

    @cached_property
    def punct(self) -> list[bool]:
        return [p == "PUNCT" or not any(c.isalnum() for c in t) for t, p in zip(self.text, self.pos)]

    @cached_property
    def kids(self) -> list[list[int]]:
        kids: list[list[int]] = [[] for _ in self.text]
        for i, h in enumerate(self.head):
            if h != i:
                kids[h].append(i)
        return kids

    @cached_property
    def edges(self) -> tuple[list[int], list[int]]:
        """First and last token of each subtree."""
        low, high = list(range(len(self))), list(range(len(self)))
        for i in range(len(self)):
            seen, j = {i}, self.head[i]
            while j not in seen:
                low[j], high[j] = min(low[j], i), max(high[j], i)
                seen.add(j)
                j = self.head[j]
        return low, high

    def governs_right(self, i: int) -> bool:
        return any(k > i for k in self.kids[i])

    @cached_property
    def content_before(self) -> list[int | None]:
        """For each position the last token before it that is no mark."""
        out: list[int | None] = []
        last = None
        for i in range(len(self) + 1):
            out.append(last)
            if i < len(self) and not self.punct[i]:
                last = i
        return out

    @cached_property
    def dashes(self) -> dict[int, bool]:
        """Dash positions: True opens, False closes; they alternate."""
        spots = [i for i, t in enumerate(self.text) if t in DASHES]
        return {k: n % 2 == 0 for n, k in enumerate(spots)}

    def opens(self, i: int) -> bool:
        """Whether a mark belongs to what follows it."""
        return self.punct[i] and self.text[i] in self.roles.openers and self.dashes.get(i, True)

    @cached_property
    def _words(self) -> tuple[list[int], list[int], list[int]]:
        """Run of each token, prefix count of tokens that first give a run a letter or digit, and the next such token of the run."""
        run, r = [], 0
        for i in range(len(self)):
            run.append(r)
            r += self.blank[i]
        worded = [any(c.isalnum() for c in t) for t in self.text]
        seen: set[int] = set()
        prefix = [0]
        for i in range(len(self)):
            first = worded[i] and run[i] not in seen
            seen |= {run[i]} if worded[i] else set()
            prefix.append(prefix[-1] + first)
        following = [len(self)] * (len(self) + 1)
        for i in range(len(self) - 1, -1, -1):
            following[i] = i if worded[i] else following[i + 1]
        return run, prefix, following

    def count(self, a: int, b: int) -> int:
        """Blank-separated pieces with a letter or digit in the text of [a, b); not additive where no blank stands."""
        if a >= b:
            return 0
        run, prefix, following = self._words
        n = prefix[b] - prefix[a]
        if a and run[a] == run[a - 1]:  # the slice begins inside a run
            k = following[a]
            begun = next((j for j in range(a) if run[j] == run[a] and following[j] == j), None)
            n += begun is not None and k < b and run[k] == run[a]
        return n


def rule_annotate(toks: list[str], sp: str, pos: list[str] | None, lang: str) -> Parsed:
    """A shallow parse from parts of speech alone; no parity with a statistical parser is claimed.

    The first verb is the root; determiners, adjectives and numbers hang on the next noun, nouns on the preposition
    before them or on the nearest verb, subordinators and later verbs make clauses.
    """
    n = len(toks)
    pos = list(pos) if pos and len(pos) == n else ["PUNCT" if not any(c.isalnum() for c in t) else "X" for t in toks]
    pos = [p or "X" for p in pos]
    german = lang == "de"
    verbs = [i for i in range(n) if pos[i] in VERBAL]
    root = verbs[0] if verbs else next((i for i in range(n) if pos[i] != "PUNCT"), 0)
    head, dep = [root] * n, ["punct" if p == "PUNCT" else "dep" for p in pos]
    marked = None
    for i in range(n):
        p = pos[i]
        noun = next((j for j in range(i + 1, min(n, i + 6)) if pos[j] in NOMINAL), None)
        verb = next((v for v in verbs if v > i), verbs[-1] if verbs else root)
        if p == "SCONJ":
            head[i], dep[i], marked = verb, "cp" if german else "mark", verb
        elif p == "CCONJ":
            head[i], dep[i] = root, "cd" if german else "cc"
        elif p in ("DET", "ADJ", "NUM") and noun is not None and not any(pos[j] in VERBAL or pos[j] == "PUNCT" for j in range(i, noun)):
            head[i], dep[i] = noun, "nk" if german else "det" if p == "DET" else "amod"
        elif p == "ADP":
            head[i], dep[i] = max([v for v in verbs if v < i], default=root), "mo" if german else "prep"
        elif p in NOMINAL or p == "PRON":
            before = next((j for j in range(i - 1, max(-1, i - 5), -1) if pos[j] not in ("DET", "ADJ", "NUM")), None)
            if before is not None and pos[before] == "ADP":
                head[i], dep[i] = before, "nk" if german else "pobj"
            else:
                left = max([v for v in verbs if v < i], default=None)
                head[i] = left if left is not None else verb
                dep[i] = ("oa" if german else "dobj") if left is not None else ("sb" if german else "nsubj")
        elif p == "ADV":
            head[i], dep[i] = min(verbs, key=lambda v: abs(v - i), default=root), "mo" if german else "advmod"
        elif p in VERBAL and i != root:
            clause = ("re" if german else "advcl") if marked == i else ("cj" if german else "conj")
            head[i], dep[i] = root, clause
        if i == root:
            head[i], dep[i] = i, "ROOT"
        if head[i] == i and i != root:
            head[i] = root
    blank = [x == "1" for x in sp.ljust(n, "0")[:n]]
    tag = [{"VERB": "VVFIN" if german else "VBD", "AUX": "VAFIN" if german else "VBD"}.get(p, p) for p in pos]
    return Parsed(list(toks), blank, tag, pos, dep, head, [t.lower() for t in toks], lang)

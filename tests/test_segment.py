from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators.segment.flat import Flat, flat_levels, merge_atoms
from lectern.operators.segment.levels import LEVELS, collapse, derive_levels, rungs
from lectern.operators.segment.parse import Parsed, rule_annotate
from lectern.operators.segment.strength import BACK, FORWARD, FREE, allowed, break_strengths, lean
from lectern.operators.segment.udf import segment, segment_flat, segment_one


def parsed(rows, lang):
    """Rows of (text, blank, tag, pos, dep, head)."""
    text, blank, tag, pos, dep, head = (list(c) for c in zip(*rows))
    return Parsed(text, [bool(b) for b in blank], tag, pos, dep, head, [t.lower() for t in text], lang)


#: "Der alte Mann, der im Garten saß, rief laut und schlief."
DE = parsed(
    [
        ("Der", 1, "ART", "DET", "nk", 2), ("alte", 1, "ADJA", "ADJ", "nk", 2), ("Mann", 0, "NN", "NOUN", "sb", 9), (",", 1, "$,", "PUNCT", "punct", 2),
        ("der", 1, "PRELS", "PRON", "sb", 7), ("im", 1, "APPRART", "ADP", "mo", 7), ("Garten", 1, "NN", "NOUN", "nk", 5), ("saß", 0, "VVFIN", "VERB", "rc", 2),
        (",", 1, "$,", "PUNCT", "punct", 9), ("rief", 1, "VVFIN", "VERB", "ROOT", 9), ("laut", 1, "ADJD", "ADV", "mo", 9), ("und", 1, "KON", "CCONJ", "cd", 9),
        ("schlief", 0, "VVFIN", "VERB", "cj", 11), (".", 0, "$.", "PUNCT", "punct", 9),
    ],
    "de",
)
#: "She gave up the house because her brother needed a pair of old shoes."
EN = parsed(
    [
        ("She", 1, "PRP", "PRON", "nsubj", 1), ("gave", 1, "VBD", "VERB", "ROOT", 1), ("up", 1, "RP", "ADP", "prt", 1), ("the", 1, "DT", "DET", "det", 4), ("house", 1, "NN", "NOUN", "dobj", 1),
        ("because", 1, "IN", "SCONJ", "mark", 8), ("her", 1, "PRP$", "PRON", "poss", 7), ("brother", 1, "NN", "NOUN", "nsubj", 8), ("needed", 1, "VBD", "VERB", "advcl", 1), ("a", 1, "DT", "DET", "det", 10),
        ("pair", 1, "NN", "NOUN", "dobj", 8), ("of", 1, "IN", "ADP", "prep", 10), ("old", 1, "JJ", "ADJ", "amod", 13), ("shoes", 0, "NNS", "NOUN", "pobj", 11), (".", 0, ".", "PUNCT", "punct", 1),
    ],
    "en",
)


def test_leaning():
    assert [lean(DE, i) for i in (0, 1, 5, 11)] == [FORWARD] * 4
    assert lean(DE, 2) == FREE and lean(EN, 2) == BACK and lean(EN, 0) == FORWARD


def test_strengths_of_recorded_parses():
    de, en = break_strengths(DE), break_strengths(EN)
    assert de[4] == 85 and de[9] == 85 and de[11] == 80 and not {1, 2, 3, 6, 12} & set(de)
    assert en[5] == 85 and en[11] == 20 and 2 not in en and 13 not in en and en[3] == 45


def test_levels_of_recorded_parses():
    for p in (DE, EN):
        levels = derive_levels(p, break_strengths(p))
        assert levels["advanced"] == sorted(levels["advanced"])
    assert derive_levels(EN, break_strengths(EN))["advanced"] == [5]
    levels = derive_levels(DE, break_strengths(DE))
    assert levels["intermediate"] == [9] and levels["beginner"] == [4, 9] and " ".join(DE.text[: levels["beginner"][0]]) == "Der alte Mann ,"


def test_never_inside_words_or_before_marks():
    p = parsed([("wo", 0, "MD", "AUX", "aux", 2), ("n't", 1, "RB", "PART", "neg", 2), ("go", 1, "VB", "VERB", "ROOT", 2), ("out", 0, "RP", "ADP", "prt", 2), ("-", 0, "HYPH", "PUNCT", "punct", 2), ("of", 0, ",", "ADP", "prep", 2), (".", 0, ".", "PUNCT", "punct", 2)], "en")
    assert not any(allowed(p, k) for k in (1, 4, 5, 6))


WORDS = st.lists(st.tuples(st.sampled_from(["der", "Haus", "geht", ",", "—", "und", "weil", "alte", "in", "er", "“", "(", ")", "-", "oft", "…"]), st.booleans(), st.sampled_from(["DET", "NOUN", "VERB", "PUNCT", "CCONJ", "SCONJ", "ADJ", "ADP", "PRON", "ADV", None])), max_size=45)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.sampled_from(["de", "en", "fr"]))
def test_properties_of_any_sentence(tokens, lang):
    toks, sp, pos = [t for t, _, _ in tokens], "".join("01"[b] for _, b, _ in tokens), [p for _, _, p in tokens]
    p = rule_annotate(toks, sp, pos, lang)
    breaks, cuts, steps = segment_one(p)
    cuts = dict(cuts)
    spots = {b["k"] for b in breaks}
    nested = [set(cuts.get(x, ())) for x in LEVELS]
    assert all(a <= b for a, b in zip(nested, nested[1:])) and all(s <= spots for s in nested)
    assert all(set(s) <= nested[0] for s in steps) and all(set(a) < set(b) for a, b in zip(steps, steps[1:]))
    for a in range(len(p)):
        for b in range(a + 1, len(p) + 1):
            text = "".join(t + " " * q for t, q in zip(p.text[a:b], p.blank[a:b]))
            assert p.count(a, b) == sum(any(c.isalnum() for c in w) for w in text.split())
    for x, own in flat_levels(p).items():
        assert own == sorted(set(own)) and all(0 < k < len(p) for k in own)
        spans = Flat(p).spans(LEVELS[x])
        assert not spans or (spans[0][0] == 0 and spans[-1][1] == len(p) and all(s[1] == t[0] for s, t in zip(spans, spans[1:])))


def test_merging_of_atoms():
    assert merge_atoms([1, 1, 1], [3, 3], 1, 3, 5) == [(0, 3)]
    assert merge_atoms([2, 2], [1], 1, 9, 9) == [(0, 1), (1, 2)]
    assert merge_atoms([2, 3], [4], 1, 3, 5) == [(0, 2)] and merge_atoms([2, 3], [3], 1, 3, 5) == [(0, 1), (1, 2)]
    assert merge_atoms([1, 3, 3], [0, 0], 2, 3, 5) == [(0, 2), (2, 3)]
    assert merge_atoms([3, 1, 3], [1, 1], 2, 3, 5, severs=lambda a, b: (a, b) == (1, 3)) == [(0, 2), (2, 3)]
    assert merge_atoms([2, 2, 2], [3, 4], 1, 4, 4) == [(0, 1), (1, 3)]
    assert merge_atoms([2, 2], [3], 1, 4, 4, may_join=lambda a, b: False) == [(0, 1), (1, 2)]


def test_flat_pieces_of_recorded_parse():
    spans = Flat(EN).spans(LEVELS["intermediate"])
    assert [" ".join(EN.text[a:b]) for a, b in spans] == ["She gave up the house", "because her brother needed", "a pair of old shoes ."]


def test_ladder_collapses_when_steps_do_not_interact():
    assert collapse([2, 4, 6, 8], [[4], [4, 6]], 10) in ([[4]], [[4, 6]], [[4], [4, 6]])
    assert collapse([3], [], 6) == []
    assert rungs(DE, [], {}) == []


def test_tables(spark):
    schema = "sent_key string, toks array<string>, sp string, pos array<string>, lang string, cuts int"
    df = spark.createDataFrame([("a", ["Der", "Hund", "bellt", "laut", "weil", "er", "will", "."], "11111100", None, "de", 1), ("b", None, None, None, None, 1), ("c", [], "", [], "en", 1), ("d", [None, "x"], "10", [None, None], None, 1), ("e", ["w"] * 400, "1" * 400, ["NOUN"] * 400, "en", 1)], schema)
    got = {r.sent_key: r for r in segment(df).collect()}
    assert len(got) == 5 and got["b"].cuts == {} and got["c"].breaks == [] and got["a"].cuts["starter"]
    assert {r.sent_key for r in segment_flat(df).collect()} == set("abcde")
    assert segment(df.limit(0)).collect() == []


@pytest.mark.parametrize("lang", ["de", "en"])
def test_levels_stay_within_one_word_of_the_limit(lang):
    toks = ("der alte Hund lief schnell in den Garten und die Katze schlief " * 6).split()
    pos = ["DET", "ADJ", "NOUN", "VERB", "ADV", "ADP", "DET", "NOUN", "CCONJ", "DET", "NOUN", "VERB"] * 6
    p = rule_annotate(toks, "1" * len(toks), pos, lang)
    for name, cuts in derive_levels(p, break_strengths(p)).items():
        edges = [0, *cuts, len(p)]
        assert max(p.count(a, b) for a, b in zip(edges, edges[1:])) <= LEVELS[name].most + 1

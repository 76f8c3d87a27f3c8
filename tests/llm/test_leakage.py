from __future__ import annotations

import random

import pytest

from lectern.llm import leakage
from lectern.llm.leakage import decontaminate, fold, leaks, passages

ITEM = "Ein Hochrad beurkundete den amtlichen Apotheker unter dem Fernrohr denn Marwine barg die galvanische Sternwarte während der Wetterhahn nieste und das Zollamt zögerte"
WORDS = ITEM.split()
FILLER = "Der Garten liegt still am Fluss und niemand geht heute mehr über den Steg"


def found(spark, texts, items=((7, ITEM, "c"),)):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    its = spark.createDataFrame(list(items), "item_id long, text string, key string")
    return {(r.doc_id, r.item_id) for r in leaks(docs, "doc_id", "text", its).collect()}


def test_what_counts(spark):
    swapped = [w if i not in (5, 14) else "Rübe" for i, w in enumerate(WORDS)]
    dropped = [w for i, w in enumerate(WORDS) if i not in (6, 15)]
    shuffled = WORDS[:]
    random.Random(1).shuffle(shuffled)
    spelled = ITEM.replace("ä", "ae").replace("ö", "oe")
    texts = [
        f"{FILLER}. {ITEM}. {FILLER}",
        " ".join(WORDS[4:16]),
        " ".join(WORDS[4:14]),
        f"{FILLER} {' '.join(swapped)}",
        " ".join(dropped),
        " ".join(shuffled),
        spelled.upper(),
        "\n".join(f"{i + 1} | {' '.join(WORDS[i * 4 : i * 4 + 4])}" for i in range(6)),
        ITEM.replace("Apotheker", "Apo-\n  theker").replace("Sternwarte", "Stern-\r\nwarte"),
        ITEM.replace("ä", "a").replace("ö", "o"),
        FILLER,
        None,
        "",
        "x " * 100000 + ITEM,
        " ".join([ITEM] * 30),
    ]
    assert {d for d, _ in found(spark, texts)} == {0, 1, 3, 4, 6, 7, 8, 9, 13, 14}


def test_instruction_is_no_passage(spark):
    line = "Lies den folgenden langen Abschnitt bitte ganz genau durch und beantworte danach die Frage darunter auf Deutsch."
    items = [(i, f"{line} {' '.join(WORDS[i : i + 13])}", "c") for i in range(4)]
    assert found(spark, [line], items) == set()
    assert [len(w) for _, w in passages([(i, t) for i, t, _ in items])] == [13] * 4


def test_items_of_every_kind(spark):
    assert found(spark, [ITEM], [(1, None, "c"), (2, "", "c"), (None, ITEM, "c"), (3, ITEM, "c"), (3, ITEM, "c"), (4, ITEM, "c"), (5, "kurz", "c")]) == {(0, 3), (0, 4)}
    assert found(spark, [ITEM], []) == set() and found(spark, []) == set()


def test_blocks_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(WORDS[i:] + [f"Rest{i}"]), "c") for i in range(5)]
    whole = found(spark, [ITEM], items)
    monkeypatch.setattr(leakage, "BLOCK_SEEDS", 20)
    assert found(spark, [ITEM], items) == whole != set()


@pytest.mark.parametrize("a,b", [("Straße", "STRASSE"), ("Öhrenau", "Oehrenau"), ("Selmé", "selme"), ("Winter-Dachs", "winterdachs"), ("Mühle", "Muhle"), ("don't", "dont")])
def test_folded_forms(a, b):
    assert fold(a) == fold(b)


def test_removal(spark):
    docs = spark.createDataFrame([(1, f"{FILLER}. {ITEM}. {FILLER}.", "a"), (2, FILLER, "b"), (3, None, "c")], "doc_id long, text string, src string")
    its = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate(docs, "doc_id", "text", its).collect()} == {2, 3}
    cut = {r.doc_id: r.text for r in decontaminate(docs, "doc_id", "text", its, mode="spans").collect()}
    assert cut[2] == FILLER and cut[3] is None
    assert "Hochrad" not in cut[1] and cut[1].startswith(FILLER) and cut[1].endswith(f"{FILLER}.")


def exchanged(words, *spots):
    return " ".join("Rübe" if i in spots else w for i, w in enumerate(words))


def test_exchanged_words_near_the_ends(spark):
    texts = [exchanged(WORDS[:12], 1), exchanged(WORDS[:12], 2), exchanged(WORDS[:12], 10), exchanged(WORDS[:14], 2), exchanged(WORDS[:16], 2, 13), exchanged(WORDS[:11], 3), exchanged(WORDS[:13], 3, 9)]
    assert {d for d, _ in found(spark, [f"{FILLER}. {t}. {FILLER}" for t in texts])} == {0, 1, 2, 3, 4}


def test_exchanged_words_close_together(spark):
    text = exchanged(WORDS[:23], 8, 12, 16)
    docs = spark.createDataFrame([(1, f"{FILLER}. {text}. {FILLER}")], "doc_id long, text string")
    got = leaks(docs, "doc_id", "text", spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()
    assert [(r.words, r.errors, r.end_word - r.start_word) for r in got] == [(23, 3, 23)]


def test_every_copy_is_found_and_removed(spark):
    texts = [" und ".join([ITEM] * 30), f"{' '.join(WORDS[:12])}. {FILLER}. {' '.join(WORDS[10:])}. {FILLER}", f"{ITEM} {' '.join(WORDS[8:])}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    its = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    got = {}
    for r in leaks(docs, "doc_id", "text", its, every=True).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    n = len(WORDS)
    assert {k: sorted(v) for k, v in got.items()} == {0: [(i * (n + 1), i * (n + 1) + n) for i in range(30)], 1: [(0, 12), (26, 26 + n - 10)], 2: [(0, n), (n, 2 * n - 8)]}
    assert leaks(docs, "doc_id", "text", its).count() == 3
    cut = {r.doc_id: r.text for r in decontaminate(docs, "doc_id", "text", its, mode="spans").collect()}
    assert set(cut[0].split()) == {"und"} and cut[1] == f"{FILLER}. {FILLER}" and cut[2] == ""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from lectern.llm.leakage import leaks
from lectern.sources.tables import table

SF = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def run(spark, name):
    return entry.queries()[name](spark, SF)


def test_garbled_tokens_come_out_restored(spark):
    cases = {r.rec_key for r in run(spark, "p1_found").where("src = 'sentences'").collect()}
    rows = run(spark, "p1_restored_tokens").collect()
    stored = {}
    for r in table(spark, SF, "sentences").select("sent_key", "toks").collect():
        stored.setdefault(r.sent_key, []).append(r.toks)
    assert {r.sent_key for r in rows} == cases != set()
    assert all(len(r.toks) == len(stored[r.sent_key][0]) for r in rows) and any(r.toks not in stored[r.sent_key] for r in rows)


def test_every_record_comes_out_in_one_spelling(spark):
    rows = run(spark, "p4_spelled").collect()
    assert len(rows) == table(spark, SF, "sentences").count() + table(spark, SF, "experiment_alice").count()
    assert {(r.src, r.rec_key) for r in rows if r.changed} == {(r.src, r.rec_key) for r in run(spark, "p4_found").collect()} != set()
    assert all((r.e is None) if r.src == "sentences" else (r.toks is None) for r in rows)


def test_no_leak_is_left(spark):
    docs, clean = table(spark, SF, "documents"), run(spark, "p7_clean").cache()
    cases = {r.doc_id for r in run(spark, "p7_found").collect()}
    assert clean.count() == docs.count() and leaks(clean, "doc_id", "text", table(spark, SF, "eval_items")).count() == 0
    old, new = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in (docs, clean))
    assert {k for k in old if old[k] != new[k]} == cases != set()

"""Segmentation of a table of sentences inside Arrow partitions; no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.functions.arrow import as_array
from lectern.operators.segment.flat import flat_levels
from lectern.operators.segment.levels import derive_levels, rungs
from lectern.operators.segment.parse import Parsed, rule_annotate
from lectern.operators.segment.strength import break_strengths

Annotator = Callable[[list[str], str, list[str] | None, str], Parsed]
SCHEMA = "sent_key string, breaks array<struct<k: int, s: int>>, cuts map<string,array<int>>, rungs array<array<int>>"
_TYPES = [pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32())])), pa.map_(pa.string(), pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32()))]


def segment_one(p: Parsed) -> tuple[list[dict], list[tuple[str, list[int]]], list[list[int]]]:
    """(breaks, cuts, rungs) of a sentence; starter cuts that are no clean break become breaks of strength 0."""
    if not len(p):
        return [], [], []
    strengths = break_strengths(p)
    cuts = derive_levels(p, strengths)
    steps = rungs(p, cuts["advanced"], strengths)
    forced = {k: 0 for k in cuts["starter"] if k not in strengths}
    return [{"k": k, "s": s} for k, s in sorted({**strengths, **forced}.items())], [(x, c) for x, c in cuts.items() if c], steps


def segment(sentences: DataFrame, annotate: Annotator = rule_annotate) -> DataFrame:
    """(sent_key, breaks, cuts, rungs) of each sentence; null token lists give empty results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [as_array(batch.column(c)).to_pylist() for c in ("toks", "sp", "pos", "lang")]
            got = [segment_one(annotate([t or "" for t in toks or []], sp or "", pos, lang or "en")) for toks, sp, pos, lang in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("sent_key"), *[pa.array([g[i] for g in got], t) for i, t in enumerate(_TYPES)]], ["sent_key", "breaks", "cuts", "rungs"])

    return sentences.select("sent_key", "toks", "sp", "pos", "lang").mapInArrow(run, SCHEMA)


def segment_flat(sentences: DataFrame, annotate: Annotator = rule_annotate) -> DataFrame:
    """(sent_key, cuts) of the flat segmenter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [as_array(batch.column(c)).to_pylist() for c in ("toks", "sp", "pos", "lang")]
            got = [list(flat_levels(annotate([t or "" for t in toks or []], sp or "", pos, lang or "en")).items()) for toks, sp, pos, lang in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("sent_key"), pa.array(got, _TYPES[1])], ["sent_key", "cuts"])

    return sentences.select("sent_key", "toks", "sp", "pos", "lang").mapInArrow(run, "sent_key string, cuts map<string,array<int>>")

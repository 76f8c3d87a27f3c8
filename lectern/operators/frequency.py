"""Frequency of every distinct term: occurrences, holding records, and a mark for terms outside given bounds.

Per-record term counts are combined by hash inside each Arrow batch, so what is shuffled is at most one row per
distinct term of a batch; Spark's partial aggregation combines these once more before the exchange.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow import as_array, flat_strings, map_distinct

#: A term is rare if at most so many records hold it, common if more than this share of the records of its language do.
RARE_RECORDS = 2
COMMON_SHARE = 0.25
#: Languages whose record totals are put into the plan as literals; beyond that they are joined.
MAX_LITERAL_LANGS = 512


def canonical_term(text: str) -> str | None:
    """NFC, outer white space trimmed, lower case; None if nothing is left."""
    return unicodedata.normalize("NFC", text).strip().lower() or None


def latest_by(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, the one with the greatest version; ties go to the greatest remaining row content.

    Rows without a key are all kept. Built on ``max_by`` so that a key with very many deliveries is combined
    before the shuffle. Maps cannot be ordered, so ties are broken on a hash of the row.
    """
    rest = [c for c in df.columns if c != key]
    tie = F.xxhash64(*[F.map_entries(F.col(f"`{c}`")) if t.startswith("map") else F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes if c != key])
    packed = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(F.col(version), tie)).alias("__row"))
        .select(key, *[F.col("__row").getField(c).alias(c) for c in rest])
    )
    return packed.unionByName(df.where(F.col(key).isNull()).select(key, *rest))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, terms array<string>, held array<string>) -> partial (lang, term, occurrences, records).

    A row with a null term carries the number of records of its language.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lang = as_array(batch.column("lang")).dictionary_encode()
        lang_of = np.where(np.asarray(lang.indices.is_null()), -1, lang.indices.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        words, rows = flat_strings(batch.column("terms"))
        held, held_rows = flat_strings(batch.column("held"))
        both = map_distinct(pa.concat_arrays([words, held]), canonical_term).dictionary_encode()
        codes = np.where(np.asarray(both.indices.is_null()), -1, both.indices.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        size = len(both.dictionary)
        occ_codes, held_codes = codes[: len(words)], codes[len(words) :]
        keep = occ_codes >= 0
        occ_keys, occ = np.unique((lang_of[rows[keep]] + 1) * size + occ_codes[keep], return_counts=True) if size else (np.array([], np.int64),) * 2
        keep = held_codes >= 0
        pairs = np.unique(held_rows[keep] * size + held_codes[keep]) if size else np.array([], np.int64)
        rec_keys, recs = np.unique((lang_of[pairs // size] + 1) * size + pairs % size, return_counts=True) if size else (np.array([], np.int64),) * 2
        keys = np.union1d(occ_keys, rec_keys)
        counts = np.zeros((2, len(keys)), np.int64)
        counts[0, np.searchsorted(keys, occ_keys)] = occ
        counts[1, np.searchsorted(keys, rec_keys)] = recs
        lang_keys, per_lang = np.unique(lang_of, return_counts=True)
        lang_idx = np.concatenate([keys // size - 1 if size else keys, lang_keys])
        names = lang.dictionary.take(pa.array(lang_idx, mask=lang_idx < 0))
        terms = both.dictionary.take(pa.array(keys % size if size else keys)).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                names.cast(pa.string()),
                pa.concat_arrays([terms, pa.nulls(len(lang_keys), pa.string())]),
                pa.array(np.concatenate([counts[0], np.zeros(len(lang_keys), np.int64)])),
                pa.array(np.concatenate([counts[1], per_lang.astype(np.int64)])),
            ],
            ["lang", "term", "occurrences", "records"],
        )


PARTIAL = "lang string, term string, occurrences long, records long"


def term_frequency(
    records: DataFrame,
    terms: Column,
    held: Column,
    lang: Column,
    rare_records: int = RARE_RECORDS,
    common_share: float = COMMON_SHARE,
) -> DataFrame:
    """(lang, term, occurrences, records, total_records, mark) for every distinct term.

    ``terms`` is the array of all occurrences of a record, ``held`` the array of the terms it counts as holding.
    Null arrays and null or blank terms count nothing; a null lang is a group of its own; an empty table gives no row.
    ``mark`` is 'rare', 'common' or null. Records must already be unique.
    """
    spark = records.sparkSession
    slim = records.select(lang.alias("lang"), terms.alias("terms"), held.alias("held"))
    partial = slim.mapInArrow(_combine, PARTIAL)
    counts = partial.groupBy("lang", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    totals = records.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("total_records"))
    few = totals.limit(MAX_LITERAL_LANGS + 1).collect()
    if len(few) <= MAX_LITERAL_LANGS:
        total = F.lit(None).cast("long")
        for name, n in few:
            total = F.when(F.col("lang").eqNullSafe(F.lit(name)), F.lit(int(n))).otherwise(total)
        counts = counts.withColumn("total_records", total)
    else:
        named = totals.withColumnRenamed("lang", "__lang")
        counts = counts.join(named, F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")
    mark = (
        F.when(F.col("records") <= rare_records, "rare")
        .when(F.col("records") > F.col("total_records") * F.lit(common_share), "common")
    )
    return counts.where(F.col("term").isNotNull()).withColumn("mark", mark)


def gloss_terms(gloss: DataFrame, **bounds) -> DataFrame:
    """Lemma frequencies of gloss records, each ``gloss_id`` counted once in its latest delivery.

    Occurrences are the values of ``forms``, the keys of ``words`` and the keys of ``freq``; a record holds a lemma if
    it is a value of ``forms`` or a key of ``words``. A null map counts as empty.
    """
    none = F.array().cast("array<string>")
    slim = gloss.select(
        "gloss_id",
        "lang",
        "loaded_at",
        F.coalesce(F.map_values("forms"), none).alias("f"),
        F.coalesce(F.map_keys("words"), none).alias("w"),
        F.coalesce(F.map_keys("freq"), none).alias("q"),
    )
    once = latest_by(slim, "gloss_id", "loaded_at")
    return term_frequency(once, F.concat("f", "w", "q"), F.concat("f", "w"), F.col("lang"), **bounds)

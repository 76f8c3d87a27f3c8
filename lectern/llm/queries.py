"""Registered queries of the training-text operators."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.leakage import decontaminate, leaks
from lectern.llm.levels import advanced_units, reading_levels
from lectern.llm.lookalikes import consistent_symbols, consistent_tokens
from lectern.llm.mojibake import repair_texts, repair_tokens
from lectern.llm.repetition import repetition, repetitive
from lectern.llm.tokenize import token_ids
from lectern.session import spread
from lectern.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "sentences").select("sent_key", "book_id", "sec_idx", "toks", "loaded_at"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repair_texts(_docs(spark, sf_dir), "doc_id", "text")
    sents = repair_tokens(_sents(spark, sf_dir), "sent_key", "toks").select("sent_key").distinct()
    return docs.select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("rec_key")).unionByName(
        sents.select(F.lit("sentences").alias("src"), F.col("sent_key").alias("rec_key"))
    )


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_texts(_docs(spark, sf_dir), "doc_id", "text")


def p1_restored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_tokens(_sents(spark, sf_dir), "sent_key", "toks")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advanced_units(_docs(spark, sf_dir), _sents(spark, sf_dir), *[table(spark, sf_dir, t) for t in ("gloss", "books")])


def p2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(_docs(spark, sf_dir), _sents(spark, sf_dir), *[table(spark, sf_dir, t) for t in ("gloss", "books", "level_ratings")])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = consistent_tokens(_sents(spark, sf_dir), "sent_key", "toks").where("changed > 0").select("key").distinct()
    symbols = consistent_symbols(table(spark, sf_dir, "experiment_alice"), "seq", F.col("v.e")).where("changed")
    return sents.select(F.lit("sentences").alias("src"), F.col("key").alias("rec_key")).unionByName(
        symbols.select(F.lit("experiment_alice").alias("src"), F.col("key").cast("string").alias("rec_key"))
    )


def p4_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence and symbol record in one spelling; ``changed`` counts tokens, or is 1 for a changed symbol."""
    sents = consistent_tokens(_sents(spark, sf_dir), "sent_key", "toks")
    symbols = consistent_symbols(table(spark, sf_dir, "experiment_alice"), "seq", F.col("v.e"))
    return sents.select(F.lit("sentences").alias("src"), F.col("key").alias("rec_key"), "toks", F.lit(None).cast("string").alias("e"), "changed").unionByName(
        symbols.select(F.lit("experiment_alice").alias("src"), F.col("key").cast("string").alias("rec_key"), F.lit(None).cast("array<string>").alias("toks"), "e", F.col("changed").cast("int").alias("changed"))
    )


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(_docs(spark, sf_dir), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_docs(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_docs(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "eval_items"), every=True)


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_docs(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "eval_items"), mode="spans")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitive(_docs(spark, sf_dir), "doc_id", "text").select("doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(_docs(spark, sf_dir), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p1_restored_tokens, p2_found, p2_levels, p4_found, p4_spelled, p6_ids, p7_found, p7_spans, p7_clean, p8_found, p8_shares)}
_RUNS = r"""WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(coalesce(text, '')), '\pL+') AS words FROM documents),
g AS (SELECT row, i, words[i : i + 4] AS gram FROM w, unnest(range(1, len(words) - 3)) AS u(i)), f AS (SELECT row, i, min(i) OVER (PARTITION BY row, gram) AS first FROM g),
c AS (SELECT row, count(DISTINCT k) AS covered FROM f, unnest(range(i, i + 5)) AS u(k) WHERE i > first GROUP BY row),
shares AS (SELECT w.doc_id, CAST(len(words) AS INTEGER) AS words, CASE WHEN len(words) > 0 THEN coalesce(covered, 0) / len(words) ELSE 0 END AS share FROM w LEFT JOIN c ON w.row = c.row)
"""
ORACLES: dict[str, str] = {
    "p8_found": _RUNS + "SELECT doc_id FROM shares WHERE share >= 0.3",
    "p8_shares": _RUNS + "SELECT doc_id, words, CAST(share AS DOUBLE) AS share FROM shares",
}
MODULES = [sys.modules[__name__]]

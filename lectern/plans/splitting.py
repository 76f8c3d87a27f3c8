"""Registered queries of the splitting operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.splitting import split_sentences
from lectern.session import spread
from lectern.sources.tables import table


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "sentences").select("sent_key", "loaded_at", "toks", "breaks", "cuts", "rungs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(_sents(spark, sf_dir)).select("sent_key", "level")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(_sents(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}

ORACLES = {
    "p5_found": r"""
WITH once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_key ORDER BY loaded_at DESC) AS rn FROM sentences) WHERE rn = 1
), levels AS (SELECT * FROM (VALUES ('starter', 4), ('beginner', 6), ('intermediate', 9), ('advanced', 13)) AS l(level, most)
), edges AS (
  SELECT sent_key, level, most, toks, list_sort(list_distinct(list_concat([0, len(toks)],
    list_filter(coalesce(cuts[level], []), lambda k: k > 0 AND k < len(toks))))) AS e
  FROM once, levels WHERE len(toks) > 0
), pieces AS (
  SELECT sent_key, level, most, len(list_filter(toks[e[i] + 1 : e[i + 1]], lambda t: regexp_matches(t, '[\pL\pN]'))) AS words
  FROM edges, unnest(range(1, len(e))) AS r(i)
)
SELECT DISTINCT sent_key, level FROM pieces WHERE words > most
"""
}

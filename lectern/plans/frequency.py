"""Registered queries of the frequency operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.frequency import gloss_terms
from lectern.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gloss_terms(table(spark, sf_dir, "gloss")).where(F.col("mark").isNotNull()).select("lang", "term", "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gloss_terms(table(spark, sf_dir, "gloss")).select("lang", "term", "occurrences", "records", F.coalesce("mark", F.lit("")).alias("mark"))


QUERIES = {"p3_found": p3_found, "p3_terms": p3_terms}

_BASE = r"""
WITH once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gloss_id ORDER BY loaded_at DESC) AS rn FROM gloss) WHERE rn = 1
), raw AS (
  SELECT gloss_id, lang, unnest(map_values(forms)) AS t, 1 AS held FROM once
  UNION ALL SELECT gloss_id, lang, unnest(map_keys(words)), 1 FROM once
  UNION ALL SELECT gloss_id, lang, unnest(map_keys(freq)), 0 FROM once
), clean AS (
  SELECT gloss_id, lang, lower(regexp_replace(nfc_normalize(t), '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')) AS term, held
  FROM raw WHERE t IS NOT NULL
), counts AS (
  SELECT lang, term, count(*) AS occurrences, count(DISTINCT gloss_id) FILTER (WHERE held = 1) AS records FROM clean WHERE term <> '' GROUP BY lang, term
), totals AS (SELECT lang, count(DISTINCT gloss_id) AS total FROM gloss GROUP BY lang),
marked AS (
  SELECT c.*, CASE WHEN records <= 2 THEN 'rare' WHEN records > total * 0.25 THEN 'common' END AS mark
  FROM counts c JOIN totals t ON c.lang IS NOT DISTINCT FROM t.lang
)
"""
ORACLES = {
    "p3_found": _BASE + "SELECT lang, term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_terms": _BASE + "SELECT lang, term, occurrences, records, coalesce(mark, '') AS mark FROM marked",
}

"""What the registered queries share: a registry, the deduplicated base tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.frequency import latest_by
from lectern.sources.tables import table

#: White space of text splitting, for DuckDB patterns.
DUCK_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SENTS = """sents AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sent_key ORDER BY loaded_at DESC) AS rn FROM sentences) WHERE rn = 1)"""
GLOSSES = """glosses AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY gloss_id ORDER BY loaded_at DESC) AS rn FROM gloss) WHERE rn = 1)"""
#: Sections one gloss record each, surfaces and lemmas as stored.
FORMS = """forms AS (SELECT book_id, sec_idx, lang, unnest(map_entries(forms), recursive := true) FROM glosses)"""


def sentences(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each sentence once, in its latest delivery, with the columns asked for."""
    df = table(spark, sf_dir, "sentences")
    want = [*dict.fromkeys(["sent_key", *columns])]
    return latest_by(df.select(*dict.fromkeys([*want, "loaded_at"])), "sent_key", "loaded_at").select(*want)


def glosses(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = table(spark, sf_dir, "gloss")
    want = [*dict.fromkeys(["gloss_id", *columns])]
    return latest_by(df.select(*dict.fromkeys([*want, "loaded_at"])), "gloss_id", "loaded_at").select(*want)


class Registry:
    """Queries and their SQL, collected by a decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(fn):
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.oracles[fn.__name__] = sql
            return fn

        return register

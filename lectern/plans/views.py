"""Names for SQL: temporary views over a table folder and registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.match import score_udf
from lectern.functions.text import nfc
from lectern.operators import derive as D
from lectern.plans.common import glosses, sentences


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Views ``lx_sentences``, ``lx_chunks``, ``lx_tokens``, ``lx_forms``, ``lx_words``, ``lx_freq``; functions ``nfc`` and ``match_score``."""
    s = sentences(spark, sf_dir, "book_id", "sec_idx", "sent_idx", "id", "lang", "toks", "sp", "pos", "ents", "breaks", "cuts", "rungs", "orth")
    forms, words, freq = D.gloss_tables(glosses(spark, sf_dir, "book_id", "sec_idx", "forms", "words", "freq"))
    views = {"lx_sentences": s, "lx_chunks": D.chunks(s), "lx_tokens": D.tokens(s), "lx_forms": forms, "lx_words": words, "lx_freq": freq}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    spark.udf.register("nfc", nfc)
    spark.udf.register("match_score", score_udf)
    return list(views)


def chunks_at(spark: SparkSession, book_id: str, level: str) -> DataFrame:
    """The flat pieces of one book at one level, in order; the views must be registered."""
    return spark.table("lx_chunks").where((F.col("book_id") == book_id) & (F.col("level") == level)).orderBy("i")

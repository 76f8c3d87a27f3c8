"""Registered queries of operators that SQL cannot express; tested on recorded cases and properties."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from lectern.functions import symbols
from lectern.functions import text as T
from lectern.functions.match import PASS, score_udf
from lectern.operators import derive as D
from lectern.operators.segment.udf import segment, segment_flat
from lectern.operators.timing import run_ends
from lectern.plans.common import GLOSSES, Registry, glosses, sentences
from lectern.plans.text import cache
from lectern.session import spread
from lectern.sources.tables import table
from lectern.streaming.build import not_built, sessions
from lectern.streaming.speech import endpoints

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _segmented(spark, sf_dir):
    return segment(spread(sentences(spark, sf_dir, "toks", "sp", "pos", "lang")))


@R.add()
def c9_break_strengths(spark, sf_dir):
    return _segmented(spark, sf_dir).select("sent_key", F.explode("breaks").alias("b")).select("sent_key", "b.k", "b.s")


@R.add()
def c13_derive_levels(spark, sf_dir):
    return _segmented(spark, sf_dir).select("sent_key", F.explode("cuts").alias("level", "cuts"))


@R.add()
def c14_rungs(spark, sf_dir):
    return _segmented(spark, sf_dir).where("size(rungs) > 0").select("sent_key", "rungs")


@R.add()
def c26_flat_pieces(spark, sf_dir):
    """Cuts of the flat segmenter, level by level."""
    return segment_flat(spread(sentences(spark, sf_dir, "toks", "sp", "pos", "lang"))).select("sent_key", F.explode("cuts").alias("level", "cuts"))


def _attempts(spark, sf_dir):
    """Reference, attempt and discount of each sentence; the attempt leaves out every seventh token, in old spelling."""
    s = sentences(spark, sf_dir, "toks", "sp", "orth", "ents").where("size(toks) > 0").withColumn("r", D.display_runs(F.col("toks"), F.col("sp"), F.col("orth"), F.col("ents")))
    said = F.array_join(F.filter("toks", lambda t, i: i % 7 != 3), " ")
    return s.select("sent_key", F.array_join(F.transform("r", lambda x: x["modern"]), " ").alias("ref"), F.lower(said).alias("hyp"), F.transform("r", lambda x: x["ent"]).alias("discount"))


@R.add()
def q6_score(spark, sf_dir):
    got = spread(_attempts(spark, sf_dir)).select("sent_key", score_udf("ref", "hyp", "discount").alias("s"))
    return got.select("sent_key", "s.score", "s.matched", "s.total", (F.col("s.score") >= PASS).alias("passed"), "s.tokens")


@R.add()
def j12_best_alternative(spark, sf_dir):
    """The better of two transcripts of each sentence, the earlier of equals."""
    a = _attempts(spark, sf_dir)
    alternatives = a.select("sent_key", "ref", "discount", F.posexplode(F.array("hyp", F.array_join(F.reverse(F.split("hyp", " ")), " "))).alias("k", "said"))
    scored = alternatives.select("sent_key", "k", score_udf("ref", "said", "discount").alias("s"))
    return scored.groupBy("sent_key").agg(F.max_by(F.struct("k", "s.score"), F.struct("s.score", -F.col("k"))).alias("b")).select("sent_key", "b.k", F.round("b.score", 9).alias("score"))


@R.add()
def x2_run_ends(spark, sf_dir):
    """End times of the display runs, where every second function word was fused with the next word when spoken."""
    s = sentences(spark, sf_dir, "toks", "sp").where("size(toks) > 0").select("sent_key", F.rtrim(T.join_tokens(F.col("toks"), F.col("sp"))).alias("text"))

    @F.arrow_udf("array<double>")
    def ends(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            runs = t.split()
            words: list[str] = []
            fuse = False
            for r in (r for r in runs if any(c.isalnum() for c in r)):
                if fuse:
                    words[-1] += r
                else:
                    words.append(r)
                fuse = len(r) <= 3 and not fuse
            stops, at = [], 0.0
            for w in words:
                at += 0.08 * len(w)
                stops.append(at)
            out.append(run_ends(words, stops, runs, len))
        return pa.array(out, pa.list_(pa.float64()))

    return s.select("sent_key", ends("text").alias("ends"))


@F.arrow_udf(StructType([StructField("plain", StringType()), StructField("sane", BooleanType()), StructField("rejoined", StringType())]))
def _checked(e: pa.Array) -> pa.Array:
    got = [None if x is None else {"plain": symbols.without_gender(x), "sane": symbols.sane_run(x), "rejoined": symbols.rejoined(x)} for x in e.to_pylist()]
    return pa.array(got, pa.struct([("plain", pa.string()), ("sane", pa.bool_()), ("rejoined", pa.string())]))


@R.add()
def t18_symbols_sane(spark, sf_dir):
    e = cache(spark, sf_dir).select(F.col("v.e").alias("e")).where("e IS NOT NULL").distinct()
    return e.select("e", _checked("e").alias("c")).select("e", "c.plain", "c.sane", "c.rejoined")


@R.add()
def m1_endpoints(spark, sf_dir):
    """Speech and stop events of each user's event values taken as microphone frames of 40 ms."""
    e = table(spark, sf_dir, "events")
    frames = e.select(F.col("user_id").cast("string").alias("take"), (F.row_number().over(D.Window.partitionBy("user_id").orderBy("ts", "event_id")) * 40.0).alias("t"), (F.abs("value") / 100).alias("peak"))
    return endpoints(frames)


@R.add(f"WITH {GLOSSES} SELECT DISTINCT s.book_id, s.sec_idx FROM sections s WHERE NOT EXISTS (SELECT 1 FROM glosses g WHERE g.book_id = s.book_id AND g.sec_idx = s.sec_idx AND g.sec_idx % 2 = 0)")
def m6_incremental(spark, sf_dir):
    """Sections still to build where those with an even number have been built."""
    built = glosses(spark, sf_dir, "book_id", "sec_idx").where("sec_idx % 2 = 0")
    return not_built(table(spark, sf_dir, "sections").select("book_id", "sec_idx"), built, ["book_id", "sec_idx"])


@R.add("""WITH m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def ext_sessions(spark, sf_dir):
    """Extension: sessions of the event table on event time."""
    return sessions(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))

"""Structural repairs: sections from paragraphs, entity guards, dash roles, forced breaks, word-less units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

#: English entity labels that name something; other languages keep all labels.
NAME_LABELS = ["PERSON", "GPE", "LOC", "FAC", "NORP"]
# Marks that open what follows, as a pattern for the end of a piece.
OPENING = {"de": r"[\s„‚»(—–]+$", "en": r"[\s“‘(—–]+$"}


def sections(paragraphs: DataFrame, keys: list[str], order: str, p: str) -> DataFrame:
    """Paragraphs folded into titled sections: a title opens a section; a title without body is lost to the next one.

    Gives (keys, sec_idx, title, order, p) of the body paragraphs; text before any title has the title "".
    """
    w = Window.partitionBy(*keys).orderBy(order)
    marked = paragraphs.withColumn("is_title", T.looks_like_title(F.col(p)))
    grouped = marked.withColumn("g", F.sum(F.col("is_title").cast("int")).over(w)).withColumn("title", F.last(F.when(F.col("is_title"), F.col(p)), ignorenulls=True).over(w))
    body = grouped.where("NOT is_title")
    return body.withColumn("sec_idx", F.dense_rank().over(Window.partitionBy(*keys).orderBy("g")) - 1).select(*keys, "sec_idx", F.coalesce("title", F.lit("")).alias("title"), order, p)


def name_spans(ents: Column, pos: Column, lang: Column) -> Column:
    """Maximal runs of proper nouns inside each entity with a label that names."""
    kept = F.filter(ents, lambda e: (lang != "en") | e["label"].isin(NAME_LABELS))

    def runs(e: Column) -> Column:
        proper = lambda i: F.coalesce((i >= e["a"]) & (i < e["b"]) & (F.get(pos, i) == "PROPN"), F.lit(False))
        inside = F.when(e["b"] > e["a"], F.sequence(e["a"], e["b"] - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(inside, lambda i: proper(i) & ~proper(i - 1))
        ends = F.filter(inside, lambda i: proper(i) & ~proper(i + 1))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct(x["a"].alias("a"), (x["b"] + 1).alias("b"), e["label"].alias("label")))

    return F.flatten(F.transform(kept, runs))


def dash_roles(toks: Column) -> Column:
    """Position and role of each dash: they open and close in turn, so a last unpaired one opens."""
    spots = F.filter(F.transform(toks, lambda t, i: F.when(t.isin("—", "–"), i)), lambda i: i.isNotNull())
    return F.transform(spots, lambda k, j: F.struct(k.alias("k"), F.when(j % 2 == 0, "open").otherwise("close").alias("role")))


def forced_breaks(breaks: Column, starter: Column) -> Column:
    """Breaks with a strength-0 entry for every starter cut that is none of them, in order."""
    own = F.coalesce(breaks, F.array().cast("array<struct<k:int,s:int>>"))
    missing = F.array_except(F.coalesce(starter, F.array().cast("array<int>")), F.transform(own, lambda b: b["k"]))
    return F.array_sort(F.array_distinct(F.concat(own, F.transform(missing, lambda k: F.struct(k.alias("k"), F.lit(0).alias("s"))))))


def absorb_wordless(units: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Units without any letter or digit glued to the unit before, the first ones to the unit after.

    Gives (keys, order of the unit that stays, parts in order, shift): ``shift`` counts the prefix parts, by which
    positions inside move. Groups of nothing but word-less units vanish.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    worded = T.is_word(F.col(text))
    grouped = units.withColumn("w", worded).withColumn("g", F.greatest(F.sum(F.col("w").cast("int")).over(w), F.lit(1)))
    packed = grouped.groupBy(*keys, "g").agg(F.array_sort(F.collect_list(F.struct(order, text, "w"))).alias("l"))
    first = F.array_position(F.transform("l", lambda x: x["w"]), True)
    return packed.where(first > 0).select(*keys, F.get(F.transform("l", lambda x: x[order]), (first - 1).cast("int")).alias(order), F.transform("l", lambda x: x[text]).alias("parts"), (first - 1).cast("int").alias("shift"))


def shift_openers(pieces: DataFrame, keys: list[str], order: str, text: str, lang: str) -> DataFrame:
    """Trailing opening marks of a piece moved to the front of the next piece of the same group.

    Which marks open depends on the language column; others than German use the English ones.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    by_lang = lambda of: F.when(F.col(lang) == "de", of(OPENING["de"])).otherwise(of(OPENING["en"]))
    head = by_lang(lambda run: F.regexp_replace(text, run, ""))
    tail = F.trim(by_lang(lambda run: F.regexp_extract(text, f"({run})", 1)))
    movable = T.is_word(head) & (tail != "") & F.lead(F.lit(1)).over(w).isNotNull()
    marked = pieces.withColumn("__head", head).withColumn("__moved", F.when(movable, tail).otherwise(""))
    cut = F.when(F.col("__moved") != "", F.col("__head")).otherwise(F.col(text))
    return marked.withColumn("__front", F.coalesce(F.lag("__moved").over(w), F.lit(""))).withColumn(text, F.concat("__front", cut)).drop("__head", "__moved", "__front")

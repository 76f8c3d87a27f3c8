"""The reading-time layer: chunks, tokens with their glosses, display runs, study lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.ordinal import running_offset

LEVELS = ["advanced", "intermediate", "beginner", "starter"]
#: Words without content of their own.
FUNCTION_POS = ["DET", "PRON", "ADP", "CCONJ", "SCONJ", "CONJ", "PART", "AUX"]
CONTENT_POS = ["NOUN", "VERB", "ADJ", "ADV"]
STUDY_ZIPF = 3.5


def boundaries(cuts: Column, level: Column, toks: Column) -> Column:
    """0, the cut positions of a level inside the sentence, and the token count; a missing level means one piece."""
    n = F.size(toks)
    own = F.filter(F.coalesce(F.try_element_at(cuts, level), F.array().cast("array<int>")), lambda k: (k > 0) & (k < n))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), own, F.array(n))))


def at_levels(sents: DataFrame) -> DataFrame:
    """Sentences with tokens, once for each level, with the boundaries of its pieces."""
    some = sents.where("size(toks) > 0").withColumn("level", F.explode(F.array(*[F.lit(x) for x in LEVELS])))
    return some.withColumn("bounds", boundaries(F.col("cuts"), F.col("level"), F.col("toks")))


def chunks(sents: DataFrame) -> DataFrame:
    """Flat pieces of every level: ci in the sentence, i in the book, whether it continues its sentence, and its text."""
    levelled = at_levels(sents).withColumn("n_chunks", F.size("bounds") - 1)
    placed = running_offset(levelled, ["book_id", "level"], "sec_idx", ["sent_idx"], F.col("n_chunks").cast("long"), "sent_start")
    flat = placed.select(
        "book_id", "level", "sec_idx", "sent_idx", "sent_key", "toks", "sp", "n_chunks", "sent_start",
        (F.col("sent_start") + F.col("n_chunks") - 1).alias("sent_end"),
        F.posexplode(F.arrays_zip(F.slice("bounds", F.lit(1), F.col("n_chunks")).alias("a"), F.slice("bounds", F.lit(2), F.col("n_chunks")).alias("b"))).alias("ci", "x"),
    )
    return flat.select(
        "book_id", "level", "sec_idx", "sent_idx", "sent_key", "ci", "n_chunks", "sent_start", "sent_end",
        (F.col("sent_start") + F.col("ci")).alias("i"), F.col("x.a").alias("a"), F.col("x.b").alias("b"),
        (F.col("ci") < F.col("n_chunks") - 1).alias("cont"),
        T.slice_text(F.col("toks"), F.col("sp"), F.col("x.a"), F.col("x.b")).alias("t"),
    )


def in_entity(ents: Column, i: Column) -> Column:
    return F.coalesce(F.exists(ents, lambda e: (i >= e["a"]) & (i < e["b"])), F.lit(False))


def tokens(sents: DataFrame) -> DataFrame:
    """One row per token with its surface in modern spelling, lower case, and whether an entity covers it."""
    exploded = sents.select("sent_key", "book_id", "sec_idx", "sent_idx", "lang", "pos", "ents", "orth", F.posexplode("toks").alias("tok_idx", "tok"))
    return exploded.select(
        "sent_key", "book_id", "sec_idx", "sent_idx", "lang", "tok_idx", "tok",
        F.get("pos", F.col("tok_idx")).alias("pos"),
        in_entity(F.col("ents"), F.col("tok_idx")).alias("ent"),
        F.lower(F.coalesce(F.try_element_at("orth", F.col("tok_idx")), F.col("tok"))).alias("surface"),
    )


def gloss_tables(glosses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forms, words, freq) as relations keyed by section."""
    key = ["book_id", "sec_idx"]
    forms = glosses.select(*key, F.explode("forms").alias("surface", "lemma"))
    words = glosses.select(*key, F.explode("words").alias("lemma", "w")).select(*key, "lemma", "w.g_en", "w.g_de", "w.e")
    freq = glosses.select(*key, F.explode("freq").alias("lemma", "zipf"))
    return forms, words, freq


def looked_up(toks: DataFrame, glosses: DataFrame) -> DataFrame:
    """Tokens with lemma, entry and zipf. A surface no form leads to is tried as a lemma; missing parts stay null."""
    forms, words, freq = gloss_tables(glosses)
    by_form = toks.join(forms, ["book_id", "sec_idx", "surface"], "left").withColumn("lemma", F.coalesce("lemma", "surface"))
    return by_form.join(words.withColumn("listed", F.lit(True)), ["book_id", "sec_idx", "lemma"], "left").join(freq, ["book_id", "sec_idx", "lemma"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def overlay(base: dict[str, Column], over: dict[str, Column]) -> dict[str, Column]:
    """Field-wise merge: a present override wins even if empty."""
    return {name: F.when(over[name].isNotNull(), over[name]).otherwise(base[name]) for name in base}


def ordered_lemmas(rows: DataFrame, keys: list[str], lemma: str, order: list[str]) -> DataFrame:
    """Lemmas of each group in order of first occurrence."""
    first = rows.groupBy(*keys, lemma).agg(F.min(F.struct(*order)).alias("__first"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__first", lemma))).alias("__l")).select(*keys, F.transform("__l", lambda x: x[lemma]).alias("lemmas"))


def display_runs(toks: Column, sp: Column, orth: Column, ents: Column) -> Column:
    """Runs of tokens without a blank between them: stored text, modern text, and whether an entity is inside."""
    n = F.size(toks)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.substring(sp, i, F.lit(1)) == "1"))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n))
    modern = T.modern_tokens(toks, orth)

    def run(x: Column) -> Column:
        a, b = x["a"], x["b"]
        return F.struct(
            F.array_join(F.slice(toks, a + 1, b - a), "").alias("orig"),
            F.array_join(F.slice(modern, a + 1, b - a), "").alias("modern"),
            F.coalesce(F.exists(ents, lambda e: (e["a"] < b) & (e["b"] > a)), F.lit(False)).alias("ent"),
        )

    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), run)


def audio_slice(sp: Column, ends: Column, a: Column, b: Column) -> Column:
    """(t0, t1) of the tokens [a, b) from the end times of the display runs; null if they do not fit or are empty."""
    ones = lambda upto: F.length(F.regexp_replace(F.substring(sp, F.lit(1), upto), "[^1]", ""))
    runs = ones(F.length(sp) - 1) + 1
    t0 = F.coalesce(F.get(ends, ones(a) - 1), F.lit(0.0))
    t1 = F.get(ends, ones(b - 1))
    t0 = F.when(ones(a) > 0, t0).otherwise(F.lit(0.0))
    return F.when((runs == F.size(ends)) & (t1 > t0), F.struct(t0.alias("t0"), t1.alias("t1")))


def ladder(rungs: Column, cuts: Column, n: Column) -> Column:
    """Rungs from fine to coarse without the one that equals the level's own cuts, then the whole sentence."""
    own = F.coalesce(cuts, F.array().cast("array<int>"))
    fine = F.filter(F.reverse(F.coalesce(rungs, F.array().cast("array<array<int>>"))), lambda r: r != own)
    return F.concat(F.transform(fine, lambda r: F.concat(F.array(F.lit(0)), r, F.array(n))), F.array(F.array(F.lit(0), n)))


def neighbours(df: DataFrame, keys: list[str], order: str, column: str, offsets: list[int]) -> DataFrame:
    """Columns with the value some rows before or after, null at the edges."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{'m' if o < 0 else 'p'}{abs(o)}": F.lag(column, -o).over(w) for o in offsets})

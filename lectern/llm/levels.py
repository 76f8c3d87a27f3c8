"""Reading level of documents, sections and books.

A frequency-ranked vocabulary is built from the glosses and the corpus. For each unit the smallest part of it, counted
from its top, that covers a fixed share of the unit's words is found: the rank of its last word is the coverage rank.
Coverage rank and sentence length are set against limits calibrated in SQL.

Words are ranked by their zipf value in the glosses. A word that glosses list without a value is common. For a word
they do not list the corpus frequency decides, by the cut that best separates the listed rare and common words; it is
never common by its mere absence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.arrow import as_array, by_bytes, flat_strings, lists_from, map_distinct
from lectern.llm.mojibake import SUSPECT, repair, token_verdicts
from lectern.llm.repetition import RULES, THRESHOLD, Words, repeated_share
from lectern.operators.frequency import canonical_term, latest_by

#: Token share the vocabulary must cover. "About a fifth of the words" outside is read as 17 % and more: between 15
#: and 18 % lies the gap in the raters' documents.
COVER = 0.83
#: Zipf value under which a word is uncommon, and words per sentence from which sentences are long.
UNCOMMON = 3.5
LONG_SENTENCE = 18.0
#: Books are judged by their printed statistics.
BOOK_UNCOMMON_SHARE = 0.4
#: Least words of a document that gets a level.
MIN_WORDS = 40
#: Zipf values are ranked in steps of this width.
STEP = 0.05
STEPS = 200
#: The first step that is not uncommon.
COMMON = round(UNCOMMON / STEP)

_WORD_SPLIT = r"[^\pL\pM\-'’]+"
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_SENTENCE = re.compile(r"(?<=[.!?])[”“\"’»)*]*\s+(?=[\"“„‚‘»(]?[*]*[^\Wa-zäöüßéë_])")
_FINAL = re.compile(r"[.!?][”“\"’»)*]*$")
_MARK = re.compile(r"[.!?](?:[”“\"’»)*]|\s|$)")
_LETTERS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
#: Most words of a heading, a paragraph without final mark.
HEADING_WORDS = 6


def language(lang):
    """Two-letter code of the usual spellings of a language column."""
    code = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(code == "ge", "de").otherwise(code)


def sentence_shape(text: str, transcript: bool) -> tuple[int, int]:
    """(sentences, words) of a text; headings are left out. A text without final marks has one sentence a line."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = [line for line in text.split("\n") if line.strip()]
    if transcript or len(_MARK.findall(text)) * 8 < len(lines):
        counts = [len(_LETTERS.findall(line)) for line in lines]
    else:
        counts = []
        for paragraph in _PARAGRAPH.split(text):
            paragraph = " ".join(paragraph.replace("-\n", "").split())
            if not _FINAL.search(paragraph) and len(paragraph.split()) <= HEADING_WORDS:
                continue
            counts += [len(_LETTERS.findall(s)) for s in _SENTENCE.split(paragraph)]
    counts = [n for n in counts if n]
    return len(counts), sum(counts)


def batch_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of each text and the rows they came from; hyphens and apostrophes inside words stay."""
    joined = pc.replace_substring_regex(pc.fill_null(texts, ""), r"(\pL)-\r?\n", r"\1")
    lists = pc.split_pattern_regex(pc.utf8_lower(joined), _WORD_SPLIT)
    words, rows = flat_strings(lists)
    words = pc.utf8_trim(words, "-'’")
    full = pc.not_equal(pc.binary_length(words), 0)
    return words.filter(full), rows[full.to_numpy(zero_copy_only=False)] if len(words) else rows


@dataclass
class Vocabulary:
    """Ranked common words: for each word and language the zipf step, -1 where it is not common in the language."""

    langs: list[str]
    words: pa.Array
    steps: np.ndarray  # words x langs
    #: ranks[lang][step]: words of the language at this step or above, uncommon ones among them.
    ranks: np.ndarray | None = None

    def rows(self, distinct: pa.Array) -> np.ndarray:
        """Row of each distinct word, -1 for none."""
        if not len(self.words):
            return np.full(len(distinct), -1)
        return pc.fill_null(pc.index_in(distinct.cast(pa.string()), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def steps_of(self, words: pa.Array, owner: np.ndarray, n: int, default: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(zipf step of each word in its unit's language, language of each unit); the language with most common words wins."""
        coded = words.dictionary_encode()
        if not len(coded.dictionary) or not self.langs:
            return np.zeros(len(words), np.int64), np.full(n, -1)
        table = np.vstack([self.steps, np.full((1, len(self.langs)), -1, self.steps.dtype)])[self.rows(coded.dictionary)]
        steps = table[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        common = steps >= COMMON
        hits = np.stack([np.bincount(owner, weights=common[:, i], minlength=n) for i in range(len(self.langs))], axis=1)
        lang = hits.argmax(axis=1)
        return np.maximum(steps[np.arange(len(steps)), lang[owner]], default).astype(np.int64), lang


def _step(z):
    return F.least(F.lit(STEPS - 1), F.greatest(F.lit(0), F.floor(F.round(z / STEP, 6)))).cast("int")


def listed_words(gloss: DataFrame) -> DataFrame:
    """(lang, word, zipf) of the surfaces that glosses list; zipf is null for common words, which have no value.

    The value of a lemma is the median over the records; a surface written with several lemmas takes the least.
    """
    slim = latest_by(gloss.select("gloss_id", language(F.col("lang")).alias("lang"), "loaded_at", F.map_entries("forms").alias("f"), F.map_entries("freq").alias("q")), "gloss_id", "loaded_at")
    forms = slim.select("lang", F.explode("f").alias("x")).select("lang", F.col("x.key").alias("word"), F.col("x.value").alias("lemma")).distinct()
    freq = slim.select("lang", F.explode("q").alias("x")).groupBy("lang", F.col("x.key").alias("lemma")).agg(F.median("x.value").alias("zipf"))

    def clean(columns: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([map_distinct(as_array(batch.column(c)), canonical_term) if c in columns else batch.column(c) for c in batch.schema.names], batch.schema.names)

        return run

    forms = forms.mapInArrow(clean(["word", "lemma"]), "lang string, word string, lemma string").where("word IS NOT NULL").distinct()
    freq = freq.mapInArrow(clean(["lemma"]), "lang string, lemma string, zipf double").where("lemma IS NOT NULL").groupBy("lang", "lemma").agg(F.min("zipf").alias("zipf"))
    return forms.join(freq, ["lang", "lemma"], "left").groupBy("lang", "word").agg(F.min("zipf").alias("zipf"))


def _collected(rows: DataFrame, langs: list[str] | None = None) -> Vocabulary:
    """Vocabulary of (lang, word, step) rows, in the languages given, else in their own."""
    got = rows.toArrow()
    if langs is None:
        langs = sorted(x for x in pc.unique(got.column("lang")).to_pylist() if x)
    coded = as_array(got.column("word")).dictionary_encode()
    steps = np.full((len(coded.dictionary), len(langs)), -1, np.int16)
    for i, lang in enumerate(langs):
        mask = pc.fill_null(pc.equal(as_array(got.column("lang")), lang), False).to_numpy(zero_copy_only=False)
        steps[coded.indices.to_numpy(zero_copy_only=False)[mask], i] = as_array(got.column("step")).to_numpy(zero_copy_only=False)[mask]
    return Vocabulary(langs, coded.dictionary.cast(pa.string()), steps)


def _counter(common: Vocabulary):
    """Word counts of a batch by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            n = batch.num_rows
            if not n or not common.langs:
                continue
            words, owner = batch_words(as_array(batch.column("text")))
            if not len(words):
                continue
            _, lang = common.steps_of(words, owner, n)
            coded = words.dictionary_encode()
            size = len(coded.dictionary)
            keys, counts = np.unique(lang[owner] * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(common.langs).take(pa.array(keys // size)), coded.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.array(counts.astype(np.int64))],
                ["lang", "word", "n"],
            )

    return run


CUT_SQL = f"""
WITH totals AS (SELECT lang, CAST(sum(n) AS double) AS total FROM {{counts}} GROUP BY lang),
placed AS (
  SELECT floor(log10(n * 1e9 / total) / {STEP}) AS step, listed >= {COMMON} AS common
  FROM {{counts}} JOIN totals USING (lang) WHERE listed IS NOT NULL AND n IS NOT NULL
), steps AS (SELECT step, count_if(common) AS common, count_if(NOT common) AS rare FROM placed GROUP BY step),
summed AS (
  SELECT step, sum(common) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS common_below,
    sum(rare) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rare_above,
    sum(common) OVER () AS all_common, sum(rare) OVER () AS all_rare
  FROM steps
)
SELECT step FROM summed
ORDER BY coalesce(common_below, 0) / greatest(all_common, 1) + rare_above / greatest(all_rare, 1), step LIMIT 1
"""


def build_vocabulary(gloss: DataFrame, docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The common words of a corpus with the ranks of all, and (lang, word, step) of the uncommon ones, not yet computed.

    A few aggregating jobs run at once, over all records and documents. Every common word is sent to the tasks, of any
    number: those the glosses list, and of the unlisted ones at most 10 ** (9 - zipf of the cut) a language. Uncommon
    words, whose number grows with the corpus, are only ever joined; ``lang`` is their place in the vocabulary's languages.
    """
    spark = gloss.sparkSession
    common = F.lit(COMMON)
    # A listed word without a value is common; so is one with a value at the limit.
    listed = listed_words(gloss).select("lang", "word", F.when(F.col("zipf").isNull(), common).otherwise(_step(F.col("zipf"))).alias("listed")).where("lang IS NOT NULL").persist()
    joined = None
    try:
        known = listed.where(F.col("listed") >= common).withColumnRenamed("listed", "step")
        telling = _collected(known)  # languages are told by their common words
        counts = docs.select("text").mapInArrow(_counter(telling), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        joined = counts.join(listed, ["lang", "word"], "full").persist()
        joined.createOrReplaceTempView("lectern_word_counts")
        row = spark.sql(CUT_SQL.format(counts="lectern_word_counts")).first()
        cut = int(row[0]) if row else STEPS
        total = F.lit(1.0)
        for lang, n in joined.where("n IS NOT NULL").groupBy("lang").agg(F.sum("n")).collect():
            total = F.when(F.col("lang") == lang, F.lit(float(n))).otherwise(total)
        corpus = _step(F.log10(F.col("n") * 1e9 / total))
        is_common = (F.col("listed") >= common) | (F.col("listed").isNull() & (corpus >= cut))
        step = (
            F.when(F.col("n").isNull(), F.col("listed"))
            .when(F.coalesce(is_common, F.lit(False)), F.greatest(corpus, common))
            .otherwise(F.least(F.coalesce("listed", corpus), common - 1))
        )
        ranked = joined.select("lang", "word", step.alias("step"))
        shape = ranked.groupBy("lang", "step").count().collect()
        vocabulary = _collected(ranked.where(F.col("step") >= common), sorted({lang for lang, _, _ in shape if lang}))
    finally:
        for table in (joined, listed):
            if table is not None:
                table.unpersist()
    ranks = np.zeros((max(1, len(vocabulary.langs)), STEPS + 1), np.int64)  # without any listed word all ranks are 0
    for lang, at, n in shape:
        if lang in vocabulary.langs:
            ranks[vocabulary.langs.index(lang), at] += n
    vocabulary.ranks = np.cumsum(ranks[:, ::-1], axis=1)[:, ::-1]
    place = F.array_position(F.array(*[F.lit(x) for x in vocabulary.langs]).cast("array<string>"), F.col("lang")).cast("int") - 1
    return vocabulary, ranked.where(F.col("step") < common).select(place.alias("lang"), "word", "step").where("lang >= 0")


#: Words of a unit: a common one by its step, without the word, an uncommon one by the word, without its step.
ENTRIES = "array<struct<step: int, word: string, n: int>>"


def word_entries(words: pa.Array, owner: np.ndarray, steps: np.ndarray, n: int, listed: np.ndarray) -> pa.ListArray:
    """``ENTRIES`` of each unit; units that are not ``listed`` have uncommon words by their step as well."""
    by_word = (steps < COMMON) & listed[owner]
    coded = words.filter(pa.array(by_word)).dictionary_encode()
    width = STEPS + len(coded.dictionary)
    codes = steps.astype(np.int64)
    codes[by_word] = STEPS + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found, counts = np.unique(owner * width + codes, return_counts=True)
    codes = found % width
    named = codes >= STEPS
    entries = pa.StructArray.from_arrays(
        [
            pa.array(codes.astype(np.int32), mask=named),
            coded.dictionary.cast(pa.string()).take(pa.array(codes - STEPS, mask=~named)),
            pa.array(counts.astype(np.int32)),
        ],
        ["step", "word", "n"],
    )
    return lists_from(entries, found // width, n)


def _entry_steps(rows: DataFrame, spread_by: str, uncommon: DataFrame | None) -> DataFrame:
    """Rows with one entry each: its place ``at``, ``step`` and ``n``; a word that ``uncommon`` does not have is at step 0."""
    each = rows.select("*", F.posexplode("entries").alias("at", "x")).drop("entries")
    if uncommon is None:
        return each.select("*", F.coalesce("x.step", F.lit(0)).alias("step"), "x.n").drop("x")
    # Entries without a word match none; a key of their own, which no word is, spreads them over the tasks of the join.
    each = each.withColumn("word", F.coalesce("x.word", F.concat(F.lit(" "), spread_by)))
    found = each.join(uncommon.withColumnRenamed("step", "found"), ["lang", "word"], "left")
    return found.select("*", F.coalesce("x.step", "found", F.lit(0)).alias("step"), "x.n").drop("x", "word", "found")


def _rank(vocabulary: Vocabulary, step):
    """Rank of a step in the language ``lang``."""
    ranks = F.lit(None).cast("array<long>")
    for i in range(len(vocabulary.langs)):
        ranks = F.when(F.col("lang") == i, F.array(*[F.lit(int(r)) for r in vocabulary.ranks[i]])).otherwise(ranks)
    return F.get(ranks, step)


def coverage_steps(steps: np.ndarray, owner: np.ndarray, n: int, cover: float = COVER) -> np.ndarray:
    """Zipf step of the last word of the smallest vocabulary that covers the share, for each unit; -1 without words."""
    order = np.lexsort((-steps, owner))
    sizes = np.bincount(owner, minlength=n)
    starts = np.cumsum(sizes) - sizes
    at = starts + np.maximum(np.ceil(cover * sizes - 1e-9).astype(np.int64) - 1, 0)
    out = np.full(n, -1, np.int64)
    some = sizes > 0
    out[some] = steps[order][at[some]]
    return out


#: Texts that are no running prose: study sheets and review notes, told by their form.
_SHEET = r"(?m)^[^=\r\n]{1,80} = [^\r\n]+[\r\n]+[^=\r\n]{1,80} = "
_NOTE = r"(?m)^\*\*[0-9]+\. "


def document_measures(docs: DataFrame, vocabulary: Vocabulary, advanced_only: bool = False, entries: bool = False) -> DataFrame:
    """(doc_id, words, sentence_length, coverage_rank, limit_rank, repetitive) of prose and transcripts of enough words.

    ``limit_rank`` is the number of words of the text's language that are not uncommon. Garbled texts are measured as
    if restored. With ``advanced_only`` texts that cannot be advanced are left out early. Of a text that common words do
    not cover, the coverage rank is that of the last word; ``document_ranks`` gives its own from the further columns
    digest, lang and ``entries``.
    """
    limit = COMMON
    digest = [F.md5("text").alias("digest")] if entries else []
    prose = docs.select("doc_id", "text", "source", *digest).where(
        F.col("text").isNotNull()
        & ~F.coalesce(F.col("source"), F.lit("")).isin("study_sheet", "review_note")
        & ~F.col("text").rlike(_SHEET)
        & ~F.col("text").rlike(_NOTE)
    )
    suspect = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", SUSPECT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts = [repair(t)[0] if not t.isascii() and suspect.search(t) else t for t in as_array(batch.column("text")).to_pylist()]
            if not texts:
                continue
            words, owner = batch_words(pa.array(texts, pa.string()))
            steps, lang = vocabulary.steps_of(words, owner, len(texts))
            sizes = np.bincount(owner, minlength=len(texts))
            cover = coverage_steps(steps, owner, len(texts))
            keep = np.flatnonzero((sizes >= MIN_WORDS) & (cover < limit if advanced_only else True))
            transcript = as_array(batch.column("source")).to_pylist()
            shapes = [sentence_shape(texts[i], transcript[i] == "read_aloud") for i in keep]
            length = np.array([w / max(s, 1) for s, w in shapes])
            if advanced_only:
                keep, length = keep[length >= LONG_SENTENCE], length[length >= LONG_SENTENCE]
            if not len(keep):
                continue
            part = Words(pa.array([texts[i] for i in keep], pa.string()))
            alive = np.arange(len(keep))
            for rule in ("enough_words", "recurring_pairs"):
                alive = alive[RULES[rule](part, THRESHOLD)[alive]]
                part = part.keep(alive)
            repetitive = np.zeros(len(keep), bool)
            repetitive[alive] = repeated_share(part)[alive] >= THRESHOLD - 1e-9
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(keep)),
                "words": pa.array(sizes[keep].astype(np.int32)),
                "sentence_length": pa.array(length, pa.float64()),
                "coverage_rank": pa.array(vocabulary.ranks[lang[keep], cover[keep]]),
                "limit_rank": pa.array(vocabulary.ranks[lang[keep], limit]),
                "repetitive": pa.array(repetitive),
            }
            if entries:
                # Only the words that decide are told apart: none of a covered text, the uncommon ones of others.
                covered = cover >= limit
                known = np.where(covered[owner], cover[owner], np.where(steps >= limit, limit, 0))
                columns["digest"] = as_array(batch.column("digest")).take(pa.array(keep))
                columns["lang"] = pa.array(lang[keep].astype(np.int32))
                columns["entries"] = word_entries(words, owner, known, len(texts), ~covered).take(pa.array(keep))
            yield pa.RecordBatch.from_pydict(columns)

    measures = "doc_id long, words int, sentence_length double, coverage_rank long, limit_rank long, repetitive boolean"
    return prose.mapInArrow(run, f"{measures}, digest string, lang int, entries {ENTRIES}" if entries else measures)


def document_ranks(measures: DataFrame, vocabulary: Vocabulary, uncommon: DataFrame) -> DataFrame:
    """(doc_id, sentence_length, coverage_rank, limit_rank) of the documents measured, ranks taken among all words."""
    unit = ["doc_id", "digest", "lang", "words", "sentence_length", "limit_rank", "unranked"]
    each = _entry_steps(measures.withColumnRenamed("coverage_rank", "unranked").select(*unit, "entries"), "digest", uncommon)
    # Equal documents are summed as one unit and told apart by its words.
    by_step = each.groupBy(*unit, "step").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy(*unit)
    covered = by_step.select(*unit, "step", F.sum("n").over(inside.orderBy(F.desc("step"))).alias("covered"), (F.sum("n").over(inside) / F.col("words")).cast("int").alias("copies"))
    enough = F.col("covered") >= F.col("copies") * F.ceil(COVER * F.col("words") - 1e-9)
    found = covered.groupBy(*unit, "copies").agg(F.max(F.when(enough, F.col("step"))).alias("step"))
    once = found.select("doc_id", "sentence_length", F.coalesce(_rank(vocabulary, F.col("step")), "unranked").alias("coverage_rank"), "limit_rank", "copies")
    return once.select("*", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "col")


def section_measures(sentences: DataFrame, vocabulary: Vocabulary, uncommon: DataFrame | None = None) -> DataFrame:
    """(unit_key, words, sentence_length, coverage_rank, limit_rank) of each section, each sentence counted once.

    Without the ``uncommon`` words the coverage rank of a section that common words do not cover is that of the last word.
    """
    uncommon_joined = uncommon is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            flat, rows = flat_strings(batch.column("toks"))
            is_word = pc.fill_null(pc.match_substring_regex(flat, r"[\pL\pN]"), False)
            mask = is_word.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
            words, rows = flat.filter(is_word), rows[mask]
            odd = pc.match_substring_regex(words, SUSPECT)
            if pc.any(odd).as_py():
                words = token_verdicts(words)[0]
            words = pc.utf8_lower(pc.utf8_trim_whitespace(words))
            steps, lang = vocabulary.steps_of(words, rows, n)
            sizes = np.bincount(rows, minlength=n).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("sent_key", "book_id", "sec_idx", "loaded_at")], pa.array(lang.astype(np.int32)), pa.array(sizes), word_entries(words, rows, steps, n, listed=np.full(n, uncommon_joined))],
                ["sent_key", "book_id", "sec_idx", "loaded_at", "lang", "words", "entries"],
            )

    slim = sentences.where("sent_key IS NOT NULL AND book_id IS NOT NULL AND sec_idx IS NOT NULL").select("sent_key", "book_id", "sec_idx", "loaded_at", "toks")
    each = slim.mapInArrow(run, f"sent_key string, book_id string, sec_idx int, loaded_at timestamp, lang int, words int, entries {ENTRIES}")
    once = each.groupBy("sent_key").agg(F.max(F.struct("loaded_at", "book_id", "sec_idx", "lang", "words", "entries")).alias("s")).select("sent_key", "s.*").where("words > 0")
    # One row per section and step: a section of any size is combined before the shuffle.
    spark = sentences.sparkSession
    steps = _entry_steps(once, "sent_key", uncommon)
    # The first entry of a sentence stands for it.
    steps.select("book_id", "sec_idx", "lang", "words", F.struct("step", "n").alias("x"), F.when(F.col("at") == 0, F.col("step")).otherwise(-1).alias("first")).createOrReplaceTempView("lectern_section_words")
    shaped = spark.sql(f"""
        WITH parts AS (
          SELECT book_id, sec_idx, x.step AS step, sum(x.n) AS n, count_if(x.step = first) AS sentences,
            sum(IF(x.step = first, lang, 0)) AS lang_sum
          FROM lectern_section_words GROUP BY book_id, sec_idx, x.step
        ), summed AS (
          SELECT *, sum(n) OVER (PARTITION BY book_id, sec_idx ORDER BY step DESC) AS covered,
            sum(n) OVER (PARTITION BY book_id, sec_idx) AS words, sum(sentences) OVER (PARTITION BY book_id, sec_idx) AS all_sentences,
            sum(lang_sum) OVER (PARTITION BY book_id, sec_idx) AS all_lang
          FROM parts
        )
        SELECT concat(book_id, ':', sec_idx) AS unit_key, max(words) AS words, max(words) / max(all_sentences) AS sentence_length,
          max(step) FILTER (WHERE covered >= {COVER} * words - 1e-9) AS step, CAST(round(max(all_lang) / max(all_sentences)) AS int) AS lang
        FROM summed GROUP BY book_id, sec_idx
    """)
    return shaped.select("unit_key", F.col("words").cast("int").alias("words"), "sentence_length", _rank(vocabulary, F.col("step")).alias("coverage_rank"), _rank(vocabulary, F.lit(COMMON)).alias("limit_rank"))


LEVEL_SQL = f"""
SELECT unit, unit_key, CASE
  WHEN sentence_length >= {LONG_SENTENCE} AND coverage_rank > limit_rank THEN 'advanced'
  WHEN sentence_length >= {{beginner_length}} OR coverage_rank > limit_rank THEN 'intermediate'
  ELSE 'beginner' END AS level, sentence_length, coverage_rank
FROM {{measures}}
"""

#: Sentence length between beginner and intermediate units: halfway between the medians of the raters' units.
BEGINNER_SQL = """
SELECT avg(middle) FROM (
  SELECT lower(trim(r.level)) AS level, percentile_approx(m.sentence_length, 0.5, 1000) AS middle
  FROM {measures} m JOIN {ratings} r ON m.unit = r.unit AND m.unit_key = r.unit_key
  WHERE lower(trim(r.level)) IN ('beginner', 'intermediate') GROUP BY 1
) HAVING count(*) = 2
"""
#: ... and where no unit is rated.
BEGINNER_LENGTH = 10.0


def book_levels(books: DataFrame) -> DataFrame:
    """(unit_key, sentence_length, uncommon) of each book by its statistics; an average that is null or 0 is derived."""
    average = F.coalesce(F.when(F.col("stats.avg_sentence_len") > 0, F.col("stats.avg_sentence_len")), F.when(F.col("stats.sentences") > 0, F.bround(F.col("stats.words") / F.col("stats.sentences"), 1)))
    return books.select(F.col("book_id").alias("unit_key"), average.alias("sentence_length"), F.col("stats.vocab_below_zipf4").alias("uncommon")).where("sentence_length IS NOT NULL AND uncommon IS NOT NULL")


def advanced_units(docs: DataFrame, sentences: DataFrame, gloss: DataFrame, books: DataFrame) -> DataFrame:
    """(unit, unit_key) of every document, section and book at level advanced."""
    vocabulary, _ = build_vocabulary(gloss, docs)
    texts = document_measures(docs, vocabulary, advanced_only=True).where(~F.col("repetitive")).select(F.lit("document").alias("unit"), F.col("doc_id").cast("string").alias("unit_key"), "sentence_length", "coverage_rank", "limit_rank")
    sections = section_measures(sentences, vocabulary).select(F.lit("section").alias("unit"), "unit_key", "sentence_length", "coverage_rank", "limit_rank")
    texts.unionByName(sections).createOrReplaceTempView("lectern_measures")
    levels = docs.sparkSession.sql(LEVEL_SQL.format(measures="lectern_measures", beginner_length=BEGINNER_LENGTH)).where("level = 'advanced'").select("unit", "unit_key")
    printed = book_levels(books).where(f"sentence_length >= {LONG_SENTENCE} AND uncommon >= {BOOK_UNCOMMON_SHARE}")
    return levels.unionByName(printed.select(F.lit("book").alias("unit"), "unit_key").distinct())


def reading_levels(docs: DataFrame, sentences: DataFrame, gloss: DataFrame, books: DataFrame, ratings: DataFrame) -> DataFrame:
    """(unit, unit_key, level, sentence_length, coverage_rank) of every unit that can be judged.

    Study sheets, review notes, repetitive documents and texts under ``MIN_WORDS`` words have no level. Null texts,
    keys and token lists give no row. Books have no coverage rank.
    """
    spark: SparkSession = docs.sparkSession
    vocabulary, uncommon = build_vocabulary(gloss, docs)

    def measures(documents: DataFrame, sections: DataFrame) -> DataFrame:
        columns = ["unit_key", "sentence_length", "coverage_rank", "limit_rank"]
        documents = documents.withColumn("unit_key", F.col("doc_id").cast("string"))
        return documents.select(F.lit("document").alias("unit"), *columns).unionByName(sections.select(F.lit("section").alias("unit"), *columns))

    # The sentence lengths need no uncommon words.
    texts = document_measures(docs, vocabulary).where(~F.col("repetitive"))
    measures(texts, section_measures(sentences, vocabulary)).createOrReplaceTempView("lectern_measures")
    ratings.createOrReplaceTempView("lectern_ratings")
    row = spark.sql(BEGINNER_SQL.format(measures="lectern_measures", ratings="lectern_ratings")).first()
    limit = float(row[0]) if row and row[0] is not None else BEGINNER_LENGTH
    texts = document_measures(docs, vocabulary, entries=True).where(~F.col("repetitive"))
    measures(document_ranks(texts, vocabulary, uncommon), section_measures(sentences, vocabulary, uncommon)).createOrReplaceTempView("lectern_ranked_measures")
    units = spark.sql(LEVEL_SQL.format(measures="lectern_ranked_measures", beginner_length=limit))
    printed = book_levels(books).select(
        F.lit("book").alias("unit"),
        "unit_key",
        F.when((F.col("sentence_length") >= LONG_SENTENCE) & (F.col("uncommon") >= BOOK_UNCOMMON_SHARE), "advanced")
        .when((F.col("sentence_length") >= limit) | (F.col("uncommon") >= BOOK_UNCOMMON_SHARE), "intermediate")
        .otherwise("beginner")
        .alias("level"),
        "sentence_length",
        F.lit(None).cast("long").alias("coverage_rank"),
    )
    return units.unionByName(printed)

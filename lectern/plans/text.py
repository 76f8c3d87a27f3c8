"""Registered queries of text normalisation, projection and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans.common import DUCK_WS as W
from lectern.plans.common import SENTS, Registry, sentences
from lectern.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Texts with every branch the corpus lacks, as (doc_id, text); both engines get the same rows.
SAMPLES = [
    (-1, "*** START OF THE PROJECT GUTENBERG EBOOK A ***\nOne.\n\nTwo.\n*** END OF THE PROJECT GUTENBERG EBOOK A ***\ntail"),
    (-2, "head *** START OF THIS PROJECT GUTENBERG X ***\nOnly a start."),
    (-3, "Only an end.\n***END OF THE PROJECT GUTENBERG Y***"),
    (-4, "a--b c -- d e—f g –h\r\n[Illustration: x] _mark_ ~x= y·z  w"),
    (-5, "——— x---y"),
    (-6, "Chapter One\n\nThe Old House\n\nIt was dark.\n\nII.\n\nThe House of the Old Man in the Wood of Pines Far\n\nhe said"),
    (-7, ""),
]
_SAMPLE_SQL = ", ".join("({}, '{}')".format(i, t.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")) for i, t in SAMPLES)
DOCS = f"docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_SAMPLE_SQL}) AS v(doc_id, text))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(SAMPLES, "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra)


@R.add(rf"""WITH {DOCS}, a AS (SELECT doc_id, regexp_replace(text, '(?s)^.*?{T.MARKER.format('START')}', '') AS t FROM docs)
SELECT doc_id, md5(regexp_replace(t, '(?s){T.MARKER.format('END')}.*$', '')) AS body FROM a""")
def t1_strip_markers(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.strip_markers(F.col("text"))).alias("body"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n', chr(10), 'g'), '\[Illustration:?[^\]]*\]', ' ', 'g'), '[_~=]', '', 'g'), '·', ' ', 'g'), '  +', ' ', 'g'), '--', '—', 'g'), '(\S)([—–])', '\1 \2', 'g'), '(\S)([—–])', '\1 \2', 'g'), '([—–])(\S)', '\1 \2', 'g')"
_CLEAN = rf"regexp_replace({_CLEAN}, '([—–])(\S)', '\1 \2', 'g')".replace("\\S", W.replace("[", "[^", 1))


@R.add(f"WITH {DOCS}, c AS (SELECT doc_id, {_CLEAN.replace('{}', 'text')} AS t FROM docs) SELECT doc_id, length(t) AS n, md5(t) AS cleaned FROM c")
def t2_clean(spark, sf_dir):
    cleaned = T.clean(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.length(cleaned).cast("long").alias("n"), F.md5(cleaned).alias("cleaned"))


_PARAS = rf"paras AS (SELECT doc_id, para_idx, p FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{W}*\n'), lambda x: trim(regexp_replace(x, '{W}+', ' ', 'g'), ' ')), lambda x: x <> '') AS ps FROM docs), unnest(ps) WITH ORDINALITY AS u(p, para_idx))"


@R.add(f"WITH {DOCS}, {_PARAS} SELECT doc_id, para_idx - 1 AS para_idx, p FROM paras")
def t3_paragraphs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_idx", "p")).withColumn("para_idx", F.col("para_idx").cast("long"))


def _duck_title(p: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.TITLE_STOP)
    end = ", ".join("'" + w.replace("'", "''") + "'" for w in T.TITLE_END)
    content = rf"list_filter(string_split({p}, ' '), lambda w: regexp_matches(w, '\pL') AND lower(w) NOT IN ({stop}))"
    caps = rf"list_filter({content}, lambda w: regexp_matches(w, '^\p{{Lu}}'))"
    return rf"""(regexp_matches({p}, '(?i)^({T.HEADING_WORDS})\b') OR regexp_matches({p}, '^[IVXLC]+\.$') OR (
      len(string_split({p}, ' ')) <= 8 AND length({p}) <= 60 AND right({p}, 1) NOT IN ({end}) AND regexp_matches({p}, '^\p{{Lu}}') AND len({content}) > 0
      AND len({caps}) / greatest(len({content}), 1) >= CASE WHEN regexp_matches(({content})[-1], '^\p{{Lu}}') THEN 0.5 ELSE 0.7 END))"""


@R.add(f"WITH {DOCS}, {_PARAS} SELECT doc_id, para_idx - 1 AS para_idx, p FROM paras WHERE {_duck_title('p')}")
def t4_titles(spark, sf_dir):
    paras = docs(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_idx", "p"))
    return paras.where(T.looks_like_title(F.col("p"))).withColumn("para_idx", F.col("para_idx").cast("long"))


@R.add(rf"""WITH {DOCS}, a AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^Kapitel') THEN 'Kapitel' || regexp_replace(text, '(?s)\A(?:.*?\n)??Kapitel', '') ELSE text END AS t FROM docs)
SELECT doc_id, md5(CASE WHEN regexp_matches(t, '(?m)^Die ') THEN regexp_extract(t, '(?s)\A(.*?)(?:\A|\n)Die ', 1) || CASE WHEN starts_with(t, 'Die ') THEN '' ELSE chr(10) END ELSE t END) AS part FROM a""")
def t5_trim_regex(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.trim_regex(F.col("text"), "^Kapitel", "^Die ")).alias("part"))


@R.add(rf"WITH {SENTS} SELECT sent_key, len(list_filter(toks, lambda t: regexp_matches(t, '[\pL\pN]'))) AS words FROM sents WHERE toks IS NOT NULL")
def t6_is_word(spark, sf_dir):
    s = sentences(spark, sf_dir, "toks").where("toks IS NOT NULL")
    return s.select("sent_key", F.size(F.filter("toks", T.is_word)).cast("long").alias("words"))


def duck_norm(x: str) -> str:
    return rf"trim(regexp_replace(nfc_normalize({x}), '{W}+', ' ', 'g'), ' ')"


@R.add(f"WITH {DOCS} SELECT doc_id, md5({duck_norm('text')}) AS norm FROM docs")
def t7_norm_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.norm_text(F.col("text"))).alias("norm"))


@R.add(f"WITH {SENTS} SELECT lower(nfc_normalize(t)) AS surface, count(*) AS n FROM (SELECT unnest(toks) AS t FROM sents) GROUP BY 1")
def t8_nfc_lower(spark, sf_dir):
    # Counting the stored spellings first leaves few strings for the Python step.
    raw = sentences(spark, sf_dir, "toks").select(F.explode("toks").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return raw.select(T.nfc_lower(F.col("t")).alias("surface"), "n").groupBy("surface").agg(F.sum("n").alias("n"))


@R.add(f"WITH {DOCS} SELECT doc_id, substr(sha256({duck_norm('text')}), 1, 12) AS id FROM docs")
def t9_sentence_id(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.sentence_id(F.col("text")).alias("id"))


@R.add(f"WITH {DOCS} SELECT doc_id, 'sha256:' || substr(sha256(text), 1, 12) AS source_hash FROM docs")
def t10_source_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.source_hash(F.col("text")).alias("source_hash"))


def duck_join(toks: str, sp: str) -> str:
    return f"array_to_string(list_transform({toks}, lambda t, i: t || CASE WHEN substr({sp}, i, 1) = '1' THEN ' ' ELSE '' END), '')"


@R.add(f"WITH {SENTS} SELECT sent_key, {duck_join('toks', 'sp')} AS text FROM sents WHERE toks IS NOT NULL AND sp IS NOT NULL")
def t11_reconstruct(spark, sf_dir):
    s = sentences(spark, sf_dir, "toks", "sp").where("toks IS NOT NULL AND sp IS NOT NULL")
    return s.select("sent_key", T.join_tokens(F.col("toks"), F.col("sp")).alias("text"))


@R.add(f"WITH {SENTS} SELECT sent_key, rtrim({duck_join('toks[2:5]', 'substr(sp, 2, 4)')}, ' ') AS part, {duck_join('toks[2:5]', 'substr(sp, 2, 4)')} AS raw_part FROM sents WHERE len(toks) >= 5 AND sp IS NOT NULL")
def t12_slice_text(spark, sf_dir):
    s = sentences(spark, sf_dir, "toks", "sp").where("size(toks) >= 5 AND sp IS NOT NULL")
    part = [T.slice_text(F.col("toks"), F.col("sp"), F.lit(1), F.lit(5), raw) for raw in (False, True)]
    return s.select("sent_key", part[0].alias("part"), part[1].alias("raw_part"))


_WORDS = "list_filter(regexp_split_to_array(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^a-z0-9äöü]+'), lambda w: w <> '')"


@R.add(f"WITH {DOCS} SELECT doc_id, {_WORDS} AS words FROM docs WHERE text IS NOT NULL")
def t13_norm_words(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.norm_words(F.col("text")).alias("words"))


_NUM = "CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN CAST(CAST({0} AS UHUGEINT) AS VARCHAR) ELSE (MAP {{" + ", ".join(f"'{k}': '{v}'" for k, v in T.NUMBER_WORDS.items()) + "}})[{0}] END"


@R.add(f"WITH {DOCS}, w AS (SELECT unnest({_WORDS}) AS word FROM docs), n AS (SELECT word, {_NUM.format('word')} AS num FROM w) SELECT word, num, count(*) AS n FROM n WHERE num IS NOT NULL GROUP BY ALL")
def t14_num_canon(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(T.norm_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.withColumn("num", T.num_canon(F.col("word"))).where("num IS NOT NULL").select("word", "num", "n")


_ASCII = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_PAIRS = f"pairs AS (SELECT DISTINCT {_ASCII.format('key')} AS a, {_ASCII.format('value')} AS b FROM (SELECT unnest(map_entries(forms), recursive := true) FROM gloss WHERE forms IS NOT NULL) WHERE value IS NOT NULL)"


def _pairs(spark, sf_dir):
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    entries = table(spark, sf_dir, "gloss").select(F.explode("forms").alias("k", "v")).where("v IS NOT NULL")
    return entries.select(fold(F.col("k")).alias("a"), fold(F.col("v")).alias("b")).distinct()


@R.add(f"WITH {_PAIRS} SELECT a, b, levenshtein(a, b) AS distance FROM pairs")
def t15_levenshtein(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("distance", F.levenshtein("a", "b").cast("long"))


@R.add(f"""WITH {_PAIRS}, n AS (SELECT a, b, {_NUM.format('a')} AS x, {_NUM.format('b')} AS y FROM pairs)
SELECT a, b, CASE WHEN a = b THEN true WHEN x IS NOT NULL AND y IS NOT NULL THEN x = y ELSE levenshtein(a, b) <= CASE WHEN length(a) <= 5 THEN 1 ELSE 2 END END AS matches FROM n""")
def t16_word_match(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("matches", T.word_match(F.col("a"), F.col("b")))


_CACHE = "latest AS (SELECT k, arg_max(v, seq) AS v, arg_max(lang, seq) AS lang, max(seq) AS seq, split_part(k, '|', 2) AS lemma, split_part(k, '|', 1) AS prompt FROM experiment_alice GROUP BY k)"


def cache(spark, sf_dir):
    """Last answer of each key of the answer cache."""
    rows = table(spark, sf_dir, "experiment_alice").groupBy("k").agg(F.max_by(F.struct("v", "lang", "seq"), "seq").alias("m")).select("k", "m.*")
    return rows.withColumns({"lemma": F.split_part("k", F.lit("|"), F.lit(2)), "prompt": F.split_part("k", F.lit("|"), F.lit(1))})


@R.add(f"WITH {_CACHE} SELECT k, contains(lower(v.d), lower(lemma)) OR (length(lemma) > 6 AND contains(lower(v.d), left(lower(lemma), length(lemma) - 2))) AS leaks FROM latest WHERE v.d IS NOT NULL")
def t17_leaks_headword(spark, sf_dir):
    return cache(spark, sf_dir).where("v.d IS NOT NULL").select("k", T.leaks_headword(F.col("lemma"), F.col("v.d")).alias("leaks"))


@R.add(f"""WITH {_CACHE}, t AS (SELECT k, rtrim(trim(v.d), '.') AS d, lemma FROM latest WHERE v.d IS NOT NULL)
SELECT k, d, list_filter([CASE WHEN length(d) > 90 THEN 'long' END, CASE WHEN contains(d, chr(10)) THEN 'newline' END, CASE WHEN d = '' THEN 'empty' END,
  CASE WHEN contains(lower(d), lower(lemma)) OR (length(lemma) > 6 AND contains(lower(d), left(lower(lemma), length(lemma) - 2))) THEN 'leak' END], lambda x: x IS NOT NULL) AS notes FROM t""")
def t19_sanity(spark, sf_dir):
    d = F.col("d")
    rules = [(F.length(d) > 90, "long"), (F.contains(d, F.lit("\n")), "newline"), (d == "", "empty"), (T.leaks_headword(F.col("lemma"), d), "leak")]
    notes = F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))
    return cache(spark, sf_dir).where("v.d IS NOT NULL").select("k", F.rtrim(F.trim("v.d"), F.lit(".")).alias("d"), "lemma").select("k", "d", notes.alias("notes"))


_SURFACES = f"WITH {SENTS}, surf AS (SELECT DISTINCT lower(t) AS w FROM (SELECT unnest(toks) AS t FROM sents))"


def _surfaces(spark, sf_dir):
    return sentences(spark, sf_dir, "toks").select(F.explode("toks").alias("t")).select(F.lower("t").alias("w")).distinct()


@R.add(_SURFACES + r"""SELECT w, list_filter(list_filter([a, CASE WHEN b <> a THEN b END, CASE WHEN c <> a AND c <> b THEN c END, CASE WHEN d <> a AND d <> b AND d <> c THEN d END], lambda x: x IS NOT NULL), lambda x: x <> w) AS safe,
  list_filter([e, CASE WHEN f <> e THEN f END], lambda x: x IS NOT NULL AND x <> w) AS proposed
FROM (SELECT w, replace(w, 'th', 't') AS a, replace(w, 'ey', 'ei') AS b, replace(replace(w, 'th', 't'), 'ey', 'ei') AS c, replace(w, 'ß', 'ss') AS d, replace(w, 'ie', 'i') AS e,
  regexp_replace(regexp_replace(regexp_replace(w, 'aa', 'a', 'g'), 'ee', 'e', 'g'), 'oo', 'o', 'g') AS f FROM surf)""")
def t20_orth_variants(spark, sf_dir):
    return _surfaces(spark, sf_dir).select("w", T.orth_variants(F.col("w")).alias("safe"), T.orth_proposals(F.col("w")).alias("proposed"))


@R.add(rf"WITH {DOCS} SELECT doc_id, regexp_extract_all(text, '[\pL\pN_’''-]+|[^\pL\pN_\s]') AS toks FROM docs WHERE text IS NOT NULL")
def t21_lint_tokens(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.lint_tokens(F.col("text")).alias("toks"))


_MODERN = "list_transform(toks, lambda t, i: coalesce(orth[CAST(i - 1 AS INTEGER)], t))"


@R.add(f"WITH {SENTS}, m AS (SELECT sent_key, {_MODERN} AS toks, sp FROM sents WHERE orth IS NOT NULL AND toks IS NOT NULL AND sp IS NOT NULL) SELECT sent_key, trim({duck_join('toks', 'sp')}, ' ') AS text FROM m")
def t25_modern_text(spark, sf_dir):
    s = sentences(spark, sf_dir, "toks", "sp", "orth").where("orth IS NOT NULL AND toks IS NOT NULL AND sp IS NOT NULL")
    return s.select("sent_key", F.trim(T.join_tokens(T.modern_tokens(F.col("toks"), F.col("orth")), F.col("sp"))).alias("text"))


LENGTHS = ["Playback length: 0m:03.250s", "x Playback length: 1h:02m:03.456s", "Playback length: 59m:0.125s", "none", ""]


@R.add(r"""WITH v AS (SELECT text, regexp_extract(text, 'Playback length:\s*(?:(\d+)h)?:?(\d+)m:([\d.]+)s', ['h', 'm', 's']) AS x FROM (VALUES """ + ", ".join(f"('{t}')" for t in LENGTHS) + """) AS v(text))
SELECT text, CASE WHEN x.m <> '' THEN round_even(coalesce(TRY_CAST(nullif(x.h, '') AS DOUBLE), 0) * 3600 + TRY_CAST(x.m AS DOUBLE) * 60 + TRY_CAST(x.s AS DOUBLE), 2) END AS seconds FROM v""")
def t26_opus_duration(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in LENGTHS], "text string")
    return rows.select("text", T.opus_seconds(F.col("text")).alias("seconds"))


@R.add(rf"""WITH {SENTS} SELECT sent_key, len(list_filter(range(1, len(toks) + 1), lambda i: regexp_matches(toks[i], '[\pL\pN]')
  AND NOT (i > 2 AND coalesce(toks[i - 1] = '-', false) AND substr(sp, i - 2, 2) = '00'))) AS words FROM sents WHERE toks IS NOT NULL AND sp IS NOT NULL""")
def t27_word_count(spark, sf_dir):
    s = sentences(spark, sf_dir, "toks", "sp").where("toks IS NOT NULL AND sp IS NOT NULL")
    return s.select("sent_key", T.token_word_count(F.col("toks"), F.col("sp")).cast("long").alias("words"))


@R.add("SELECT book_id, source_hash, split_part(generator, '@', 1) AS tool, split_part(generator, '@', 2) AS revision, strftime(built_at, '%Y-%m-%d') AS run_date, 3 AS schema FROM books")
def t28_provenance(spark, sf_dir):
    b = table(spark, sf_dir, "books")
    part = lambda n: F.split_part("generator", F.lit("@"), F.lit(n))
    return b.select("book_id", "source_hash", part(1).alias("tool"), part(2).alias("revision"), F.date_format("built_at", "yyyy-MM-dd").alias("run_date"), F.lit(3).alias("schema"))


_LINES = rf"ls AS (SELECT doc_id, line_idx, {duck_norm('l')} AS l FROM docs, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(l, line_idx) WHERE {duck_norm('l')} <> '')"


@R.add(f"""WITH {DOCS}, {_LINES}, ids AS (SELECT doc_id, substr(sha256(l), 1, 12) AS id, line_idx FROM ls), o AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id, id ORDER BY line_idx) - 1 AS occ FROM ids)
SELECT doc_id, count(*) AS lines, count(DISTINCT id) AS ids, max(occ) AS max_occ FROM o GROUP BY doc_id""")
def q0_document_lines(spark, sf_dir):
    """Lines, distinct content ids and repeats of each document; occ runs from 0, so the most frequent id has max_occ + 1 lines."""
    ids = docs(spark, sf_dir).select("doc_id", F.explode(T.lines(F.col("text"))).alias("l")).select("doc_id", T.sentence_id(F.col("l")).alias("id"))
    per_id = ids.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("ids"), (F.max("n") - 1).alias("max_occ"))

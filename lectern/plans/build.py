"""Registered queries of structural repair, enrichment and timing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import derive as D
from lectern.operators import enrich as E
from lectern.operators import repair as P
from lectern.plans.common import GLOSSES, SENTS, Registry, glosses, sentences
from lectern.plans.derive import CHUNKS, LOOKUP, _chunks, _looked
from lectern.plans.quality import _AUDIO, _audio
from lectern.plans.text import _CACHE, _PARAS, DOCS, _duck_title, cache, docs, duck_join, duck_norm
from lectern.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add(f"""WITH {DOCS}, {_PARAS}, m AS (SELECT *, {_duck_title('p')} AS is_title FROM paras), g AS (SELECT *, sum(CASE WHEN is_title THEN 1 ELSE 0 END) OVER w AS g, last_value(CASE WHEN is_title THEN p END IGNORE NULLS) OVER w AS title FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx))
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS sec_idx, coalesce(title, '') AS title, para_idx - 1 AS para_idx, p FROM g WHERE NOT is_title""")
def c1_sections(spark, sf_dir):
    paras = docs(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_idx", "p"))
    return P.sections(paras, ["doc_id"], "para_idx", "p").select("doc_id", F.col("sec_idx").cast("long").alias("sec_idx"), "title", F.col("para_idx").cast("long").alias("para_idx"), "p")


@R.add(f"""WITH {SENTS}, t AS (SELECT sent_key, ei, e.label AS label, i, i - row_number() OVER (PARTITION BY sent_key, ei ORDER BY i) AS run FROM (SELECT sent_key, lang, pos, ei, ents[ei] AS e FROM sents, unnest(range(1, len(ents) + 1)) AS u(ei)), unnest(range(CAST(e.a AS BIGINT), CAST(e.b AS BIGINT))) AS v(i)
  WHERE pos[i + 1] = 'PROPN' AND (lang <> 'en' OR e.label IN ('PERSON', 'GPE', 'LOC', 'FAC', 'NORP')))
SELECT sent_key, min(i) AS a, max(i) + 1 AS b, label FROM t GROUP BY sent_key, ei, label, run""")
def c3_name_guard(spark, sf_dir):
    s = sentences(spark, sf_dir, "ents", "pos", "lang").where("ents IS NOT NULL AND pos IS NOT NULL")
    return s.select("sent_key", F.explode(P.name_spans(F.col("ents"), F.col("pos"), F.col("lang"))).alias("x")).select("sent_key", F.col("x.a").cast("long").alias("a"), F.col("x.b").cast("long").alias("b"), "x.label")


@R.add(f"""WITH {SENTS}, d AS (SELECT sent_key, i - 1 AS k, row_number() OVER (PARTITION BY sent_key ORDER BY i) AS rn FROM sents, unnest(range(1, len(toks) + 1)) AS u(i) WHERE toks[i] IN ('—', '–'))
SELECT sent_key, k, CASE WHEN rn % 2 = 1 THEN 'open' ELSE 'close' END AS role FROM d""")
def c6_dash_roles(spark, sf_dir):
    s = sentences(spark, sf_dir, "toks").select("sent_key", F.explode(P.dash_roles(F.col("toks"))).alias("x"))
    return s.select("sent_key", F.col("x.k").cast("long").alias("k"), "x.role")


@R.add(f"WITH {SENTS} SELECT sent_key, list_sort(list_distinct(list_concat(coalesce(breaks, []), list_transform(list_filter(coalesce(cuts['starter'], []), lambda k: NOT list_contains(list_transform(coalesce(breaks, []), lambda b: b.k), k)), lambda k: {{'k': k, 's': 0}})))) AS breaks FROM sents")
def c16_forced_breaks(spark, sf_dir):
    s = sentences(spark, sf_dir, "breaks", "cuts")
    return s.select("sent_key", P.forced_breaks(F.col("breaks"), F.try_element_at("cuts", F.lit("starter"))).alias("breaks"))


#: Units with word-less ones at every place, as (book, order, text).
UNITS = [("u1", 0, "“"), ("u1", 1, "—"), ("u1", 2, "One"), ("u1", 3, "”"), ("u1", 4, "two"), ("u1", 5, "…"), ("u1", 6, "!"), ("u2", 0, "—"), ("u3", 0, "a"), ("u3", 1, "b")]
_UNITS_SQL = "units AS (SELECT book_id, 0 AS sec_idx, sent_idx, t FROM (VALUES " + ", ".join(f"('{b}', {i}, '{t}')" for b, i, t in UNITS) + f") AS v(book_id, sent_idx, t) UNION ALL SELECT book_id, sec_idx, sent_idx, {duck_join('toks', 'sp')} FROM sents WHERE toks IS NOT NULL)"
_ABSORB = _UNITS_SQL + r""", g AS (SELECT *, regexp_matches(t, '[\pL\pN]') AS w, greatest(sum(CASE WHEN regexp_matches(t, '[\pL\pN]') THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, sec_idx ORDER BY sent_idx), 1) AS g FROM units),
absorbed AS (SELECT book_id, sec_idx, min(sent_idx) FILTER (WHERE w) AS sent_idx, list(t ORDER BY sent_idx) AS parts, count(*) FILTER (WHERE sent_idx < fw) AS shift FROM (SELECT *, min(CASE WHEN w THEN sent_idx END) OVER (PARTITION BY book_id, sec_idx, g) AS fw FROM g) WHERE fw IS NOT NULL GROUP BY book_id, sec_idx, g)"""


def _absorbed(spark, sf_dir):
    s = sentences(spark, sf_dir, "book_id", "sec_idx", "sent_idx", "toks", "sp").where("toks IS NOT NULL")
    units = s.select("book_id", "sec_idx", "sent_idx", T.join_tokens(F.col("toks"), F.col("sp")).alias("t"))
    extra = spark.createDataFrame(UNITS, "book_id string, sent_idx int, t string").select("book_id", F.lit(0).alias("sec_idx"), "sent_idx", "t")
    return P.absorb_wordless(units.unionByName(extra), ["book_id", "sec_idx"], "sent_idx", "t")


@R.add(f"WITH {SENTS}, {_ABSORB} SELECT book_id, sec_idx, sent_idx, parts, shift FROM absorbed")
def c17_absorb_wordless(spark, sf_dir):
    return _absorbed(spark, sf_dir).withColumn("shift", F.col("shift").cast("long"))


@R.add(f"WITH {SENTS}, {_ABSORB} SELECT book_id, sec_idx, sent_idx, array_to_string(parts[1 : shift + 1], '') || CASE WHEN len(parts) > shift + 1 THEN ' ' || array_to_string(parts[shift + 2 :], ' ') ELSE '' END AS t FROM absorbed")
def c30_absorb_text(spark, sf_dir):
    """The text form: a prefix joins directly, a closing mark after a blank."""
    n = F.col("shift") + 1
    tail = F.slice("parts", n + 1, F.greatest(F.size("parts") - n, F.lit(0)))
    text = F.concat(F.array_join(F.slice("parts", F.lit(1), n), ""), F.when(F.size("parts") > n, F.concat(F.lit(" "), F.array_join(tail, " "))).otherwise(""))
    return _absorbed(spark, sf_dir).select("book_id", "sec_idx", "sent_idx", text.alias("t"))


@R.add(f"WITH {SENTS} SELECT sent_key, substr(sha256({duck_norm(duck_join('toks', 'sp'))}), 1, 12) AS id, nullif(len(coalesce(ents, [])), 0) AS n_ents, nullif(len(coalesce(breaks, [])), 0) AS n_breaks, nullif(len(list_filter(coalesce(map_values(cuts), []), lambda c: len(c) > 0)), 0) AS n_levels, {duck_norm(duck_join('toks', 'sp'))} = {duck_join('toks', 'sp')} AS exact FROM sents WHERE toks IS NOT NULL")
def c18_finalize(spark, sf_dir):
    """Schema rows with the id computed anew, empty parts left out, and whether the text is its own normal form."""
    text = T.join_tokens(F.col("toks"), F.col("sp"))
    size = lambda c: F.nullif(F.greatest(F.size(c), F.lit(0)).cast("long"), F.lit(0))
    levels = F.filter(F.coalesce(F.map_values("cuts"), F.array().cast("array<array<int>>")), lambda c: F.size(c) > 0)
    s = sentences(spark, sf_dir, "toks", "sp", "ents", "breaks", "cuts").where("toks IS NOT NULL").withColumn("norm", T.norm_text(text))
    return s.select("sent_key", T.short_hash(F.col("norm")).alias("id"), size(F.col("ents")).alias("n_ents"), size(F.col("breaks")).alias("n_breaks"), size(levels).alias("n_levels"), (F.col("norm") == text).alias("exact"))


@R.add(rf"""WITH {CHUNKS}, c AS (SELECT c.*, CASE WHEN s.lang = 'de' THEN regexp_replace(t, '{P.OPENING["de"]}', '') ELSE regexp_replace(t, '{P.OPENING["en"]}', '') END AS head, CASE WHEN s.lang = 'de' THEN trim(regexp_extract(t, '({P.OPENING["de"]})', 1), ' ') ELSE trim(regexp_extract(t, '({P.OPENING["en"]})', 1), ' ') END AS tail FROM chunks c JOIN sents s ON c.sent_key = s.sent_key),
m AS (SELECT *, CASE WHEN regexp_matches(head, '[\pL\pN]') AND tail <> '' AND lead(1) OVER w IS NOT NULL THEN tail ELSE '' END AS moved FROM c WINDOW w AS (PARTITION BY book_id, level, sec_idx ORDER BY i))
SELECT book_id, level, i, coalesce(lag(moved) OVER (PARTITION BY book_id, level, sec_idx ORDER BY i), '') || CASE WHEN moved <> '' THEN head ELSE t END AS t FROM m""")
def c27_shift_openers(spark, sf_dir):
    lang = sentences(spark, sf_dir, "lang").select("sent_key", "lang")
    pieces = _chunks(spark, sf_dir).join(lang, "sent_key").select("book_id", "level", "sec_idx", "i", "t", "lang")
    return P.shift_openers(pieces, ["book_id", "level", "sec_idx"], "i", "t", "lang").select("book_id", "level", "i", "t")


@R.add(f"""WITH {LOOKUP}, curated AS (SELECT k AS lemma, min(e) AS symbol FROM (SELECT unnest(map_keys(words)) AS k, unnest(map_values(words)).e AS e FROM glosses) WHERE e IS NOT NULL AND e <> '' GROUP BY k)
SELECT sent_key, arg_min(coalesce(a.symbol, b.symbol), tok_idx) AS symbol FROM looked l LEFT JOIN curated a ON lower(l.lemma) = a.lemma LEFT JOIN curated b ON lower(l.tok) = b.lemma WHERE coalesce(a.symbol, b.symbol) IS NOT NULL GROUP BY sent_key""")
def c28_curated_symbol(spark, sf_dir):
    """First token whose lemma, else whose text, the curated map knows."""
    g = glosses(spark, sf_dir, "words").select(F.explode("words").alias("lemma", "w")).where("w.e IS NOT NULL AND w.e <> ''").groupBy("lemma").agg(F.min("w.e").alias("symbol"))
    rows = _looked(spark, sf_dir).select("sent_key", "tok_idx", F.lower("lemma").alias("x"), F.lower("tok").alias("y"))
    by_lemma = rows.join(g.select(F.col("lemma").alias("x"), F.col("symbol").alias("a")), "x", "left")
    both = by_lemma.join(g.select(F.col("lemma").alias("y"), F.col("symbol").alias("b")), "y", "left").withColumn("symbol", F.coalesce("a", "b")).where("symbol IS NOT NULL")
    return both.groupBy("sent_key").agg(F.min_by("symbol", "tok_idx").alias("symbol"))


@R.add(f"WITH {CHUNKS}, r AS (SELECT book_id, level, i, t, coalesce(sum(CASE WHEN cont THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, level, sec_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, sec_idx FROM chunks) SELECT book_id, level, min(i) AS sent_start, max(i) AS sent_end, string_agg(t, ' ' ORDER BY i) AS t FROM r GROUP BY book_id, level, sec_idx, run")
def c29_reassemble(spark, sf_dir):
    """Sentences from flat pieces alone: a run of continued pieces up to the first that is not."""
    w = Window.partitionBy("book_id", "level", "sec_idx").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    runs = _chunks(spark, sf_dir).withColumn("run", F.coalesce(F.sum(F.when(F.col("cont"), 0).otherwise(1)).over(w), F.lit(0)))
    packed = runs.groupBy("book_id", "level", "sec_idx", "run").agg(F.min("i").alias("sent_start"), F.max("i").alias("sent_end"), F.array_sort(F.collect_list(F.struct("i", "t"))).alias("l"))
    return packed.select("book_id", "level", "sent_start", "sent_end", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("t"))


@R.add(f"WITH {CHUNKS}, w AS (SELECT c.sent_key, c.level, string_agg(c.t, ' ' ORDER BY ci) AS pieces, count(*) AS n FROM chunks c GROUP BY ALL) SELECT w.sent_key, w.level, w.n, replace(w.pieces, ' ', '') = replace({duck_join('s.toks', 's.sp')}, ' ', '') AS exact FROM w JOIN sents s ON w.sent_key = s.sent_key")
def c31_spans_to_text(spark, sf_dir):
    """Pieces of each sentence and whether they give back its text."""
    s = D.at_levels(sentences(spark, sf_dir, "toks", "sp", "cuts"))
    n = F.size("bounds") - 1
    pieces = F.transform(F.sequence(F.lit(1), n), lambda i: T.slice_text(F.col("toks"), F.col("sp"), F.get("bounds", i - 1), F.get("bounds", i)))
    bare = lambda c: F.regexp_replace(c, " ", "")
    return s.select("sent_key", "level", n.cast("long").alias("n"), (bare(F.array_join(pieces, " ")) == bare(T.join_tokens(F.col("toks"), F.col("sp")))).alias("exact"))


_PROMPT = "unified_gen_v1"
_ITEMS = GLOSSES + f", items AS (SELECT DISTINCT unnest(map_keys(words)) AS item FROM glosses), have AS (SELECT lemma AS item, v.d AS v FROM latest WHERE prompt = '{_PROMPT}')"


def _items(spark, sf_dir):
    return glosses(spark, sf_dir, "words").select(F.explode(F.map_keys("words")).alias("item"))


def _answers(spark, sf_dir):
    return cache(spark, sf_dir).where(F.col("prompt") == _PROMPT).select(F.col("lemma").alias("item"), F.col("v.d").alias("v"))


@R.add(f"WITH {_CACHE}, {_ITEMS} SELECT i.item, CASE WHEN h.item IS NOT NULL THEN h.v ELSE '{_PROMPT}:' || i.item END AS v, CASE WHEN h.item IS NOT NULL THEN 'cache' ELSE 'asked' END AS source FROM items i LEFT JOIN have h ON i.item = h.item")
def e1_run_stage(spark, sf_dir):
    return E.run_stage(_items(spark, sf_dir), _PROMPT, _answers(spark, sf_dir))


_GEN = _ITEMS + f", gen AS (SELECT i.item, CASE WHEN h.item IS NOT NULL THEN h.v ELSE '{_PROMPT}:' || i.item END AS v FROM items i LEFT JOIN have h ON i.item = h.item)"


@R.add(f"""WITH {_CACHE}, {_GEN} SELECT item, v, CASE WHEN NOT coalesce(length(v) <= 90 AND NOT contains(lower(v), lower(item)), false) THEN 'insane' WHEN substr(sha256(item), 1, 1) < 'c' THEN 'kept' ELSE 'rejected' END AS verdict FROM gen""")
def e2_generate_and_grade(spark, sf_dir):
    """Answers checked, then graded; the stand-in grader accepts three quarters of the items by hash."""
    generated = E.run_stage(_items(spark, sf_dir), _PROMPT, _answers(spark, sf_dir)).select("item", "v")
    sane = (F.length("v") <= 90) & ~F.contains(F.lower("v"), F.lower("item"))
    return E.two_stage(generated, sane, F.substring(F.sha2("item", 256), 1, 1) < "c")


_CONTENT = ", ".join(f"'{p}'" for p in D.CONTENT_POS)


@R.add(f"WITH {LOOKUP} SELECT book_id, lemma, arg_min(sent_key, (sec_idx, sent_idx, tok_idx)) AS sent_key, arg_min(pos, (sec_idx, sent_idx, tok_idx)) AS pos FROM looked WHERE NOT ent AND pos IN ({_CONTENT}) GROUP BY ALL")
def e3_candidates(spark, sf_dir):
    at = F.struct("sec_idx", "sent_idx", "tok_idx")
    rows = _looked(spark, sf_dir).where(~F.col("ent") & F.col("pos").isin(D.CONTENT_POS))
    return rows.groupBy("book_id", "lemma").agg(F.min_by("sent_key", at).alias("sent_key"), F.min_by("pos", at).alias("pos"))


_FUNC = ", ".join(f"'{p}'" for p in [*D.FUNCTION_POS, "PUNCT", "PROPN"])


@R.add(f"WITH {LOOKUP}, {_CACHE} SELECT DISTINCT book_id, lemma FROM looked WHERE NOT ent AND NOT listed AND pos IS NOT NULL AND pos NOT IN ({_FUNC}) AND zipf IS NULL AND lemma NOT IN (SELECT lemma FROM latest)")
def e4_common_lemmas(spark, sf_dir):
    rows = _looked(spark, sf_dir).where(~F.col("ent") & ~F.col("listed") & F.col("pos").isNotNull() & ~F.col("pos").isin([*D.FUNCTION_POS, "PUNCT", "PROPN"]) & F.col("zipf").isNull())
    return rows.select("book_id", "lemma").distinct().join(cache(spark, sf_dir).select("lemma").distinct(), "lemma", "left_anti").select("book_id", "lemma")


_FILL = LOOKUP + """, fill AS (SELECT lang, lemma, arg_min(sent_key, (book_id, sec_idx, sent_idx, tok_idx)) AS sent_key, list_sort(list_distinct(list(surface))) AS surfaces FROM looked WHERE listed AND NOT ent AND coalesce(g_en, '') = '' GROUP BY ALL)"""


@R.add(f"WITH {_FILL} SELECT lang, lemma, sent_key, surfaces, 'fill:' || lemma AS g_en, CASE WHEN lang = 'de' THEN 'füll:' || lemma END AS g_de FROM fill")
def e5_fill_misses(spark, sf_dir):
    """Entries without a definition, with surfaces and first sentence, filled by the stand-in client."""
    return _filled(spark, sf_dir)


def _filled(spark, sf_dir):
    rows = _looked(spark, sf_dir).where("listed AND NOT ent AND coalesce(g_en, '') = ''")
    grouped = rows.groupBy("lang", "lemma").agg(F.min_by("sent_key", F.struct("book_id", "sec_idx", "sent_idx", "tok_idx")).alias("sent_key"), F.sort_array(F.collect_set("surface")).alias("surfaces"))
    return grouped.select("lang", "lemma", "sent_key", "surfaces", F.concat(F.lit("fill:"), "lemma").alias("g_en"), F.when(F.col("lang") == "de", F.concat(F.lit("füll:"), "lemma")).alias("g_de"))


_DEFS = GLOSSES + ", defs AS (SELECT lang, k AS lemma, min(w.g_de) AS g_de FROM (SELECT lang, unnest(map_keys(words)) AS k, unnest(map_values(words)) AS w FROM glosses) WHERE lang = 'de' AND w.g_de IS NOT NULL AND w.g_de <> '' GROUP BY ALL)"


@R.add(f"WITH {_DEFS} SELECT lemma, g_de, length(g_de) <= 100 AND NOT contains(g_de, chr(10)) AND NOT (contains(lower(g_de), lower(lemma)) OR (length(lemma) > 6 AND contains(lower(g_de), left(lower(lemma), length(lemma) - 2)))) AS sane FROM defs")
def e6_german_definitions(spark, sf_dir):
    rows = glosses(spark, sf_dir, "lang", "words").where("lang = 'de'").select(F.explode("words").alias("lemma", "w")).where("w.g_de IS NOT NULL AND w.g_de <> ''").groupBy("lemma").agg(F.min("w.g_de").alias("g_de"))
    return rows.select("lemma", "g_de", ((F.length("g_de") <= 100) & ~F.contains("g_de", F.lit("\n")) & ~T.leaks_headword(F.col("lemma"), F.col("g_de"))).alias("sane"))


@R.add(f"WITH {LOOKUP}, {_CACHE}, pool AS (SELECT lang, lemma, count(*) AS n FROM looked WHERE NOT ent AND regexp_matches(lemma, '^[a-zäöüß]{{2,}}$') AND pos IN ({_CONTENT}) GROUP BY ALL) SELECT lang, lemma, n, 'general:' || lemma AS v FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, lemma) AS rn FROM pool) WHERE rn <= 300 AND lemma NOT IN (SELECT lemma FROM latest)")
def e7_general_pool(spark, sf_dir):
    """The 300 most frequent content lemmas of each language that lack an answer, answered by the stand-in client."""
    rows = _looked(spark, sf_dir).where(~F.col("ent") & F.col("lemma").rlike("^[a-zäöüß]{2,}$") & F.col("pos").isin(D.CONTENT_POS)).groupBy("lang", "lemma").agg(F.count(F.lit(1)).alias("n"))
    top = rows.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "lemma"))).where("rn <= 300")
    return top.join(cache(spark, sf_dir).select("lemma").distinct(), "lemma", "left_anti").select("lang", "lemma", "n", F.concat(F.lit("general:"), "lemma").alias("v"))


@R.add(f"WITH {_FILL}, entries AS (SELECT gloss_id, lang, k AS lemma, w.g_en AS g_en FROM (SELECT gloss_id, lang, unnest(map_keys(words)) AS k, unnest(map_values(words)) AS w FROM glosses)) SELECT e.gloss_id, e.lemma, coalesce(nullif(e.g_en, ''), CASE WHEN f.lemma IS NOT NULL THEN 'fill:' || f.lemma END) AS g_en FROM entries e LEFT JOIN fill f ON e.lang = f.lang AND e.lemma = f.lemma")
def e8_fill_bake(spark, sf_dir):
    entries = glosses(spark, sf_dir, "lang", "words").select("gloss_id", "lang", F.explode("words").alias("lemma", "w"))
    fill = _filled(spark, sf_dir).select("lang", "lemma", F.col("g_en").alias("filled"))
    return entries.join(fill, ["lang", "lemma"], "left").select("gloss_id", "lemma", F.coalesce(F.nullif("w.g_en", F.lit("")), "filled").alias("g_en"))


@R.add(f"WITH {GLOSSES}, {_CACHE}, entries AS (SELECT gloss_id, k AS lemma, w.g_de AS g_de FROM (SELECT gloss_id, unnest(map_keys(words)) AS k, unnest(map_values(words)) AS w FROM glosses)) SELECT e.gloss_id, e.lemma, CASE WHEN c.v.d IS NOT NULL AND c.v.d <> '' THEN c.v.d ELSE e.g_de END AS g_de FROM entries e LEFT JOIN latest c ON c.lemma = e.lemma AND c.prompt = '{_PROMPT}' AND c.lang = 'de'")
def e9_definition_bake(spark, sf_dir):
    """Definitions from the answer cache written into existing entries only; empty answers change nothing."""
    entries = glosses(spark, sf_dir, "words").select("gloss_id", F.explode("words").alias("lemma", "w"))
    new = cache(spark, sf_dir).where((F.col("prompt") == _PROMPT) & (F.col("lang") == "de")).select("lemma", F.col("v.d").alias("d"))
    return entries.join(new, "lemma", "left").select("gloss_id", "lemma", F.when(F.col("d").isNotNull() & (F.col("d") != ""), F.col("d")).otherwise(F.col("w.g_de")).alias("g_de"))


@R.add(f"WITH {LOOKUP}, {_CACHE}, r AS (SELECT lemma, min(zipf) AS zipf, min(g_en) AS g_en FROM looked WHERE listed GROUP BY lemma) SELECT r.lemma, r.zipf, r.g_en, c.v.d AS answer, c.v.e AS symbol FROM r LEFT JOIN latest c ON c.lemma = r.lemma AND c.prompt = '{_PROMPT}' WHERE r.zipf <= 0.3 OR substr(sha256(r.lemma), 1, 1) = '0'")
def e10_review(spark, sf_dir):
    """Stored and answered definitions side by side, for the rarest lemmas and a hash sample."""
    rows = _looked(spark, sf_dir).where("listed").groupBy("lemma").agg(F.min("zipf").alias("zipf"), F.min("g_en").alias("g_en"))
    picked = rows.where((F.col("zipf") <= 0.3) | (F.substring(F.sha2("lemma", 256), 1, 1) == "0"))
    answers = cache(spark, sf_dir).where(F.col("prompt") == _PROMPT).select("lemma", F.col("v.d").alias("answer"), F.col("v.e").alias("symbol"))
    return picked.join(answers, "lemma", "left").select("lemma", "zipf", "g_en", "answer", "symbol")


@R.add(f"WITH {_CACHE}, {_GEN}, p AS (SELECT item, v, row_number() OVER (PARTITION BY substr(item, 1, 1) ORDER BY item) - 1 AS rn FROM gen) SELECT item, v AS a, 'b:' || item AS b, coalesce(length(v), 0) > length('b:' || item) AS prefers_b FROM p WHERE rn % 8 = 0")
def e11_experiment(spark, sf_dir):
    """Two generators over a stride sample, with a grader that prefers the shorter answer."""
    generated = E.run_stage(_items(spark, sf_dir), _PROMPT, _answers(spark, sf_dir))
    w = Window.partitionBy(F.substring("item", 1, 1)).orderBy("item")
    picked = generated.withColumn("rn", F.row_number().over(w) - 1).where("rn % 8 = 0")
    b = F.concat(F.lit("b:"), "item")
    return picked.select("item", F.col("v").alias("a"), b.alias("b"), (F.coalesce(F.length("v"), F.lit(0)) > F.length(b)).alias("prefers_b"))


_STREAM = f"""{SENTS}, ph AS (SELECT sent_key, ord, ch, 0 AS chunk_no, 100 + 10 * (ord % 7) AS num_samples FROM (SELECT sent_key, string_split(rtrim({duck_join('toks', 'sp')}, ' '), '') AS cs FROM sents WHERE toks IS NOT NULL), unnest(cs) WITH ORDINALITY AS u(ch, ord)),
c AS (SELECT *, sum(num_samples) OVER (PARTITION BY sent_key ORDER BY ord) AS cum, ch = ' ' AS mark, coalesce(lag(ch) OVER (PARTITION BY sent_key ORDER BY ord), ' ') = ' ' AND ch <> ' ' AS opens FROM ph),
w AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY sent_key ORDER BY ord) - 1 AS word FROM c)"""


@R.add(f"WITH {_STREAM} SELECT sent_key, word, string_agg(ch, '' ORDER BY ord) AS phonemes, max(cum) / 22050 AS end FROM w WHERE NOT mark GROUP BY sent_key, word")
def x3_word_ends(spark, sf_dir):
    """Word ends of a phoneme stream; each character of a sentence stands for a phoneme."""
    s = sentences(spark, sf_dir, "toks", "sp").where("toks IS NOT NULL").select("sent_key", F.posexplode(F.split(F.rtrim(T.join_tokens(F.col("toks"), F.col("sp"))), "")).alias("p", "phoneme")).where("phoneme <> ''")
    stream = s.select("sent_key", F.lit(0).alias("chunk_no"), (F.col("p") + 1).alias("ord"), "phoneme", (100 + 10 * ((F.col("p") + 1) % 7)).alias("num_samples"))
    return E.word_ends(stream, ["sent_key"], 22050)


@R.add(f"WITH {_AUDIO}, old AS (SELECT id, max(chars) / 14.0 AS dur FROM a WHERE substr(id, 1, 1) < '8' GROUP BY id UNION ALL SELECT 'gone' || id, 1.0 FROM a WHERE substr(id, 1, 1) = '0' GROUP BY id), new AS (SELECT id, max(chars) / 13.0 AS dur FROM a WHERE substr(id, 1, 1) >= '4' GROUP BY id) SELECT b.book_id, b.id, coalesce(o.dur, n.dur) AS dur FROM (SELECT DISTINCT book_id, id FROM a) b LEFT JOIN old o ON b.id = o.id LEFT JOIN new n ON b.id = n.id WHERE coalesce(o.dur, n.dur) IS NOT NULL")
def x4_durations(spark, sf_dir):
    """Durations kept from before, refilled from a new run, and restricted to the sentences of the book."""
    a = _audio(spark, sf_dir)
    per_id = a.groupBy("id").agg(F.max("chars").alias("chars"))
    first = F.substring("id", 1, 1)
    old = per_id.where(first < "8").select("id", (F.col("chars") / 14.0).alias("old")).unionByName(per_id.where(first == "0").select(F.concat(F.lit("gone"), "id").alias("id"), F.lit(1.0).alias("old")))
    new = per_id.where(first >= "4").select("id", (F.col("chars") / 13.0).alias("new"))
    return a.select("book_id", "id").distinct().join(old, "id", "left").join(new, "id", "left").select("book_id", "id", F.coalesce("old", "new").alias("dur")).where("dur IS NOT NULL")


@R.add("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM events), n AS (SELECT user_id, count(*) AS n, min(i) FILTER (WHERE abs(value) > 20) AS first, max(i) FILTER (WHERE abs(value) > 20) AS last FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN first IS NULL THEN 0 ELSE greatest(first - 2, 0) END AS a, CASE WHEN first IS NULL THEN n ELSE least(last + 1 + 4, n) END AS b FROM n""")
def m4_silence_trim(spark, sf_dir):
    """First and last loud sample with padding on both sides; all quiet means untouched. Event values stand for samples."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(w).cast("long") - 1)
    loud = F.abs("value") > 20
    n = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(loud, F.col("i"))).alias("first"), F.max(F.when(loud, F.col("i"))).alias("last"))
    return n.select("user_id", F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.greatest(F.col("first") - 2, F.lit(0))).alias("a"), F.when(F.col("first").isNull(), F.col("n")).otherwise(F.least(F.col("last") + 5, F.col("n"))).alias("b"))


@R.add(rf"""WITH {SENTS} SELECT sent_key, len(list_filter(range(1, len(toks) + 1), lambda i: regexp_matches(toks[i], '[\pL\pN]') AND NOT (i > 2 AND coalesce(toks[i - 1] = '-', false) AND substr(sp, i - 2, 2) = '00'))) AS wc_tok,
  len(list_filter(regexp_split_to_array({duck_join('toks', 'sp')}, '\s+'), lambda w: w <> '')) AS wc_split, len(list_filter(regexp_split_to_array({duck_join('toks', 'sp')}, '\s+'), lambda w: regexp_matches(w, '[\pL\pN]'))) AS wc_alnum,
  len(list_filter(toks, lambda t: regexp_matches(t, '[\pL\pN]'))) AS wc_tokalnum, length(regexp_replace(substr(sp, 1, length(sp) - 1), '[^1]', '', 'g')) + 1 AS wc_runs FROM sents WHERE len(toks) > 0""")
def n1_word_counts(spark, sf_dir):
    """The five ways to count words of a sentence, side by side."""
    text = T.join_tokens(F.col("toks"), F.col("sp"))
    pieces = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    counts = {
        "wc_tok": T.token_word_count(F.col("toks"), F.col("sp")),
        "wc_split": F.size(pieces),
        "wc_alnum": F.size(F.filter(pieces, T.is_word)),
        "wc_tokalnum": F.size(F.filter("toks", T.is_word)),
        "wc_runs": F.length(F.regexp_replace(F.substring("sp", F.lit(1), F.length("sp") - 1), "[^1]", "")) + 1,
    }
    s = sentences(spark, sf_dir, "toks", "sp").where("size(toks) > 0")
    return s.select("sent_key", *[c.cast("long").alias(name) for name, c in counts.items()])


@R.add(f"""WITH {SENTS}, b AS (SELECT sent_key, cuts, unnest(breaks).k AS k, unnest(breaks).s AS s FROM sents) SELECT sent_key, k, s, CASE WHEN list_contains(cuts['advanced'], k) THEN 'advanced' WHEN list_contains(cuts['intermediate'], k) THEN 'intermediate'
  WHEN list_contains(cuts['beginner'], k) THEN 'beginner' WHEN list_contains(cuts['starter'], k) THEN 'starter' END AS level, CASE WHEN s = 0 THEN 'forced' WHEN s >= 85 THEN 'clause' WHEN s >= 60 THEN 'phrase' WHEN s >= 30 THEN 'edge' ELSE 'tight' END AS kind FROM b""")
def d1_explain_chunks(spark, sf_dir):
    """Each possible break with its strength, the kind of seam, and the coarsest level that cuts there."""
    s = sentences(spark, sf_dir, "breaks", "cuts").select("sent_key", "cuts", F.explode("breaks").alias("b")).select("sent_key", "cuts", "b.k", "b.s")
    level = F.lit(None).cast("string")
    for x in reversed(D.LEVELS):
        level = F.when(F.array_contains(F.try_element_at("cuts", F.lit(x)), F.col("k")), x).otherwise(level)
    kind = F.when(F.col("s") == 0, "forced").when(F.col("s") >= 85, "clause").when(F.col("s") >= 60, "phrase").when(F.col("s") >= 30, "edge").otherwise("tight")
    return s.select("sent_key", "k", "s", level.alias("level"), kind.alias("kind"))

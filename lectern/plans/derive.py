"""Registered queries of the reading-time layer, its joins, windows and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import derive as D
from lectern.operators.ordinal import occurrence
from lectern.plans.common import GLOSSES, SENTS, Registry, glosses, sentences
from lectern.plans.text import _CACHE, cache, duck_join
from lectern.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

BASE = ["book_id", "sec_idx", "sent_idx", "id", "lang", "toks", "sp", "pos", "ents", "cuts", "rungs", "orth"]
LEVELS_SQL = "levels AS (SELECT * FROM (VALUES ('advanced'), ('intermediate'), ('beginner'), ('starter')) AS l(level))"
AT = SENTS + ", " + LEVELS_SQL + """, at_levels AS (SELECT *, list_sort(list_distinct(list_concat([0, len(toks)], list_filter(coalesce(cuts[level], []), lambda k: k > 0 AND k < len(toks))))) AS bounds
  FROM sents, levels WHERE len(toks) > 0)"""
CHUNKS = AT + f""", placed AS (SELECT *, len(bounds) - 1 AS n_chunks, coalesce(sum(len(bounds) - 1) OVER (PARTITION BY book_id, level ORDER BY sec_idx, sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_start FROM at_levels),
chunks AS (SELECT book_id, level, sec_idx, sent_idx, sent_key, ci - 1 AS ci, n_chunks, sent_start, sent_start + n_chunks - 1 AS sent_end, sent_start + ci - 1 AS i, bounds[ci] AS a, bounds[ci + 1] AS b, ci < n_chunks AS cont,
  rtrim({duck_join('toks[bounds[ci] + 1 : bounds[ci + 1]]', 'substr(sp, bounds[ci] + 1, bounds[ci + 1] - bounds[ci])')}, ' ') AS t FROM placed, unnest(range(1, len(bounds))) AS u(ci))"""
TOKENS = SENTS + """, toks AS (SELECT sent_key, book_id, sec_idx, sent_idx, lang, i - 1 AS tok_idx, toks[i] AS tok, pos[i] AS pos,
  len(list_filter(coalesce(ents, []), lambda e: i - 1 >= e.a AND i - 1 < e.b)) > 0 AS ent, lower(coalesce(orth[CAST(i - 1 AS INTEGER)], toks[i])) AS surface FROM sents, unnest(range(1, len(toks) + 1)) AS u(i))"""
LOOKUP = TOKENS + ", " + GLOSSES + """, forms AS (SELECT book_id, sec_idx, unnest(map_keys(forms)) AS surface, unnest(map_values(forms)) AS lemma FROM glosses),
words AS (SELECT book_id, sec_idx, k AS lemma, w.g_en, w.g_de, w.e FROM (SELECT book_id, sec_idx, unnest(map_keys(words)) AS k, unnest(map_values(words)) AS w FROM glosses)),
freq AS (SELECT book_id, sec_idx, unnest(map_keys(freq)) AS lemma, unnest(map_values(freq)) AS zipf FROM glosses),
looked AS (SELECT t.*, coalesce(f.lemma, t.surface) AS lemma, w.g_en, w.g_de, w.e, q.zipf, w.lemma IS NOT NULL AS listed FROM toks t
  LEFT JOIN forms f ON t.book_id = f.book_id AND t.sec_idx = f.sec_idx AND t.surface = f.surface
  LEFT JOIN words w ON t.book_id = w.book_id AND t.sec_idx = w.sec_idx AND coalesce(f.lemma, t.surface) = w.lemma
  LEFT JOIN freq q ON t.book_id = q.book_id AND t.sec_idx = q.sec_idx AND coalesce(f.lemma, t.surface) = q.lemma)"""


def _sents(spark, sf_dir):
    return sentences(spark, sf_dir, *BASE)


def _chunks(spark, sf_dir):
    return D.chunks(sentences(spark, sf_dir, "book_id", "sec_idx", "sent_idx", "toks", "sp", "cuts"))


def _tokens(spark, sf_dir):
    return D.tokens(sentences(spark, sf_dir, "book_id", "sec_idx", "sent_idx", "lang", "toks", "pos", "ents", "orth"))


def _looked(spark, sf_dir):
    return D.looked_up(_tokens(spark, sf_dir), glosses(spark, sf_dir, "book_id", "sec_idx", "forms", "words", "freq"))


@R.add(f"WITH {AT} SELECT sent_key, level, bounds FROM at_levels")
def q1_boundaries(spark, sf_dir):
    return D.at_levels(sentences(spark, sf_dir, "toks", "cuts")).select("sent_key", "level", "bounds")


@R.add(f"WITH {CHUNKS} SELECT book_id, level, sec_idx, sent_idx, ci, i, a, b, cont, t FROM chunks")
def q2_flatten(spark, sf_dir):
    return _chunks(spark, sf_dir).select("book_id", "level", "sec_idx", "sent_idx", F.col("ci").cast("long").alias("ci"), "i", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "cont", "t")


@R.add(f"WITH {CHUNKS} SELECT DISTINCT sent_key, level, sent_start, sent_end FROM chunks")
def w8_flat_index(spark, sf_dir):
    return _chunks(spark, sf_dir).where("ci = 0").select("sent_key", "level", "sent_start", "sent_end")


@R.add(f"""WITH {SENTS}, {LEVELS_SQL} SELECT sent_key, level, list_concat(list_transform(list_filter(list_reverse(rungs), lambda r: r <> coalesce(cuts[level], [])), lambda r: list_concat([0], r, [len(toks)])), [[0, len(toks)]]) AS ladder
FROM sents, levels WHERE rungs IS NOT NULL AND toks IS NOT NULL""")
def q3_ladder_ranges(spark, sf_dir):
    s = sentences(spark, sf_dir, "toks", "cuts", "rungs").where("rungs IS NOT NULL AND toks IS NOT NULL").withColumn("level", F.explode(F.array(*[F.lit(x) for x in D.LEVELS])))
    return s.select("sent_key", "level", D.ladder(F.col("rungs"), F.try_element_at("cuts", "level"), F.size("toks")).cast("array<array<long>>").alias("ladder"))


@R.add(f"WITH {LOOKUP} SELECT sent_key, tok_idx, lemma, g_en, g_de, e, zipf FROM looked WHERE listed")
def j1_gloss_lookup(spark, sf_dir):
    return _looked(spark, sf_dir).where("listed").select("sent_key", F.col("tok_idx").cast("long").alias("tok_idx"), "lemma", "g_en", "g_de", "e", "zipf")


@R.add(f"""WITH {LOOKUP}, {_CACHE}, shown AS (SELECT sent_key, tok_idx, l.lemma, CASE WHEN c.v.d IS NOT NULL THEN c.v.d ELSE l.g_en END AS g_en, CASE WHEN c.v.e IS NOT NULL THEN c.v.e ELSE l.e END AS e
  FROM looked l LEFT JOIN latest c ON l.lemma = c.lemma AND c.prompt = 'unified_gen_v1' WHERE NOT l.ent AND (l.listed OR c.k IS NOT NULL))
SELECT * FROM shown""")
def j2_override_overlay(spark, sf_dir):
    over = cache(spark, sf_dir).where("prompt = 'unified_gen_v1'").select("lemma", F.col("v.d").alias("__d"), F.col("v.e").alias("__e"), F.lit(True).alias("__o"))
    joined = _looked(spark, sf_dir).where("NOT ent").join(over, "lemma", "left").where("listed OR __o")
    merged = D.overlay({"g_en": F.col("g_en"), "e": F.col("e")}, {"g_en": F.col("__d"), "e": F.col("__e")})
    return joined.withColumns(merged).select("sent_key", F.col("tok_idx").cast("long").alias("tok_idx"), "lemma", "g_en", "e")


@R.add(f"WITH {TOKENS} SELECT sent_key, tok_idx, surface FROM toks WHERE NOT ent AND regexp_matches(tok, '[\\pL\\pN]')")
def j3_entity_anti(spark, sf_dir):
    return _tokens(spark, sf_dir).where(~F.col("ent") & T.is_word(F.col("tok"))).select("sent_key", F.col("tok_idx").cast("long").alias("tok_idx"), "surface")


_DICT = GLOSSES + """, dict AS (SELECT lang, lower(k) AS key, k AS head, gloss_id AS ord, w.g_en AS gloss, CASE WHEN starts_with(w.g_en, 'to ') THEN 'VERB' ELSE 'NOUN' END AS tag
  FROM (SELECT lang, gloss_id, unnest(map_keys(words)) AS k, unnest(map_values(words)) AS w FROM glosses) WHERE w.g_en IS NOT NULL AND w.g_en <> '')"""


def _dictionary(spark, sf_dir):
    rows = glosses(spark, sf_dir, "lang", "words").select("lang", F.col("gloss_id").alias("ord"), F.explode("words").alias("head", "w")).where("w.g_en IS NOT NULL AND w.g_en <> ''")
    return rows.select("lang", F.lower("head").alias("key"), "head", "ord", F.col("w.g_en").alias("gloss"), F.when(F.startswith("w.g_en", F.lit("to ")), "VERB").otherwise("NOUN").alias("tag"))


@R.add(f"""WITH {TOKENS}, {_DICT}, wanted AS (SELECT DISTINCT lang, surface, tok AS head, pos FROM toks WHERE pos IN ('NOUN', 'VERB'))
SELECT lang, surface, head, pos, gloss FROM (SELECT w.*, d.gloss, row_number() OVER (PARTITION BY w.lang, w.surface, w.head, w.pos ORDER BY CASE WHEN d.tag = w.pos THEN 0 ELSE 1 END, CASE WHEN d.head = w.head THEN 0 ELSE 1 END, d.ord, d.head) AS rn
FROM wanted w JOIN dict d ON w.lang = d.lang AND w.surface = d.key) WHERE rn = 1""")
def j4_homographs(spark, sf_dir):
    wanted = _tokens(spark, sf_dir).where(F.col("pos").isin("NOUN", "VERB")).select("lang", "surface", F.col("tok").alias("want"), "pos").distinct()
    d = _dictionary(spark, sf_dir).withColumnRenamed("key", "surface")
    # Best entry of a key as an aggregate: combined before the shuffle, however often a head is listed.
    rank = F.struct(F.when(F.col("tag") == F.col("pos"), 0).otherwise(1), F.when(F.col("head") == F.col("want"), 0).otherwise(1), "ord", "head")
    best = wanted.join(d, ["lang", "surface"]).groupBy("lang", "surface", "want", "pos").agg(F.min_by("gloss", rank).alias("gloss"))
    return best.select("lang", "surface", F.col("want").alias("head"), "pos", "gloss")


@R.add(f"""WITH {TOKENS}, {_DICT}, keys AS (SELECT DISTINCT lower(key) AS key FROM (SELECT unnest(map_values(forms)) AS key FROM glosses WHERE lang = 'de') WHERE key IS NOT NULL), old AS (SELECT DISTINCT lower(tok) AS w FROM toks WHERE lang = 'de' AND lower(tok) NOT IN (SELECT key FROM keys)),
v AS (SELECT w, unnest([replace(w, 'th', 't'), replace(w, 'ey', 'ei'), replace(replace(w, 'th', 't'), 'ey', 'ei'), replace(w, 'ß', 'ss')]) AS variant, unnest([0, 1, 2, 3]) AS ord FROM old)
SELECT w, arg_min(variant, ord) AS modern FROM v JOIN keys ON variant = key WHERE variant <> w GROUP BY w""")
def j5_archaic(spark, sf_dir):
    keys = glosses(spark, sf_dir, "lang", "forms").where("lang = 'de'").select(F.explode("forms").alias("s", "key")).where("key IS NOT NULL").select(F.lower("key").alias("key")).distinct()
    old = _tokens(spark, sf_dir).where("lang = 'de'").select(F.lower("tok").alias("w")).distinct().join(keys, F.col("w") == F.col("key"), "left_anti")
    v = old.select("w", F.posexplode(T.orth_variants(F.col("w"))).alias("ord", "variant"))
    return v.join(keys, F.col("variant") == F.col("key"), "left_semi").groupBy("w").agg(F.min_by("variant", "ord").alias("modern"))


@R.add(f"""WITH {_CACHE}, {GLOSSES}, listed AS (SELECT k AS lemma, gloss_id, w.e AS e FROM (SELECT gloss_id, unnest(map_keys(words)) AS k, unnest(map_values(words)) AS w FROM glosses)),
general AS (SELECT lemma, arg_min(e, gloss_id) AS e FROM listed WHERE e IS NOT NULL AND e <> '' GROUP BY lemma), reviewed AS (SELECT lemma, v.e AS e FROM latest WHERE prompt = 'unified_gen_v1')
SELECT l.lemma, coalesce(nullif(r.e, ''), nullif(g.e, '')) AS e FROM (SELECT DISTINCT lemma FROM listed) l LEFT JOIN reviewed r ON l.lemma = r.lemma LEFT JOIN general g ON l.lemma = g.lemma""")
def j6_emoji_precedence(spark, sf_dir):
    listed = glosses(spark, sf_dir, "words").select("gloss_id", F.explode("words").alias("lemma", "w"))
    general = listed.where("w.e IS NOT NULL AND w.e <> ''").groupBy("lemma").agg(F.min_by("w.e", "gloss_id").alias("general"))
    reviewed = cache(spark, sf_dir).where("prompt = 'unified_gen_v1'").select("lemma", F.col("v.e").alias("reviewed"))
    layers = [F.nullif(F.col(c), F.lit("")) for c in ("reviewed", "general")]
    return listed.select("lemma").distinct().join(reviewed, "lemma", "left").join(general, "lemma", "left").select("lemma", F.coalesce(*layers).alias("e"))


_KEYWORDS = """kw AS (SELECT DISTINCT v.e AS e, w AS word FROM (SELECT v, unnest(string_split(lower(v.d), ' ')) AS w FROM latest WHERE v.e IS NOT NULL AND v.e <> '' AND v.d IS NOT NULL)
  WHERE length(w) >= 3 AND w NOT IN ('the', 'and', 'for', 'near', 'who'))"""


@R.add(f"WITH {_CACHE}, {_KEYWORDS}, capped AS (SELECT word FROM kw GROUP BY word HAVING count(*) <= 8) SELECT word, list_sort(list(e)) AS symbols FROM kw WHERE word IN (SELECT word FROM capped) GROUP BY word")
def a16_keyword_fanout(spark, sf_dir):
    return _keywords(spark, sf_dir).groupBy("word").agg(F.sort_array(F.collect_set("e")).alias("symbols")).where("size(symbols) <= 8")


def _keywords(spark, sf_dir):
    words = cache(spark, sf_dir).where("v.e IS NOT NULL AND v.e <> '' AND v.d IS NOT NULL").select(F.col("v.e").alias("e"), F.explode(F.split(F.lower("v.d"), " ")).alias("word"))
    return words.where((F.length("word") >= 3) & ~F.col("word").isin("the", "and", "for", "near", "who")).distinct()


@R.add(f"""WITH {_CACHE}, {_KEYWORDS}, {GLOSSES}, lw AS (SELECT DISTINCT k AS lemma, unnest(string_split(lower(w.g_en), ' ')) AS word FROM (SELECT unnest(map_keys(words)) AS k, unnest(map_values(words)) AS w FROM glosses) WHERE w.g_en IS NOT NULL)
SELECT lemma, min(e) AS e, count(DISTINCT e) AS n FROM lw JOIN kw USING (word) WHERE word IN (SELECT word FROM kw GROUP BY word HAVING count(*) <= 8) GROUP BY lemma""")
def j7_keyword_match(spark, sf_dir):
    kw = _keywords(spark, sf_dir)
    capped = kw.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n <= 8").select("word")
    lw = glosses(spark, sf_dir, "words").select(F.explode("words").alias("lemma", "w")).where("w.g_en IS NOT NULL").select("lemma", F.explode(F.split(F.lower("w.g_en"), " ")).alias("word")).distinct()
    return lw.join(kw.join(capped, "word", "left_semi"), "word").groupBy("lemma").agg(F.min("e").alias("e"), F.count_distinct("e").alias("n"))


@R.add(f"WITH {GLOSSES}, {_CACHE} SELECT DISTINCT lang, lemma FROM (SELECT lang, unnest(map_keys(words)) AS lemma FROM glosses) g WHERE NOT EXISTS (SELECT 1 FROM latest c WHERE c.lemma = g.lemma)")
def j8_incremental_anti(spark, sf_dir):
    wanted = glosses(spark, sf_dir, "lang", "words").select("lang", F.explode(F.map_keys("words")).alias("lemma")).distinct()
    return wanted.join(cache(spark, sf_dir).select("lemma").distinct(), "lemma", "left_anti").select("lang", "lemma")


@R.add(f"""WITH {GLOSSES}, w AS (SELECT gloss_id, unnest(map_keys(words)) AS lemma FROM glosses), q AS (SELECT gloss_id, unnest(map_keys(freq)) AS lemma FROM glosses), f AS (SELECT DISTINCT gloss_id, unnest(map_values(forms)) AS lemma FROM glosses)
SELECT 'no_freq' AS rule, gloss_id, lemma FROM w WHERE (gloss_id, lemma) NOT IN (SELECT gloss_id, lemma FROM q) UNION ALL SELECT 'no_word', gloss_id, lemma FROM q WHERE (gloss_id, lemma) NOT IN (SELECT gloss_id, lemma FROM w)
UNION ALL SELECT 'no_form', gloss_id, lemma FROM w WHERE (gloss_id, lemma) NOT IN (SELECT gloss_id, lemma FROM f WHERE lemma IS NOT NULL)""")
def j9_foreign_keys(spark, sf_dir):
    g = glosses(spark, sf_dir, "forms", "words", "freq")
    none = F.array().cast("array<string>")
    w, q, f = (F.coalesce(x, none) for x in (F.map_keys("words"), F.map_keys("freq"), F.map_values("forms")))
    # Both sides live in one record, so the anti joins are set differences without a shuffle.
    rules = {"no_freq": F.array_except(w, q), "no_word": F.array_except(q, w), "no_form": F.array_except(w, f)}
    return g.select("gloss_id", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("l")) for k, v in rules.items()])).alias("x")).select("x.rule", "gloss_id", F.explode("x.l").alias("lemma"))


@R.add(f"""WITH {SENTS}, full_text AS (SELECT sent_key, book_id, sec_idx, sent_idx, length({duck_join('toks', 'sp')}) AS n FROM sents WHERE toks IS NOT NULL),
starts AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY book_id, sec_idx ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM full_text),
marks AS (SELECT book_id, sec_idx, unnest(range(0, CAST(sum(n) AS BIGINT), 500)) AS pos FROM full_text GROUP BY book_id, sec_idx)
SELECT m.book_id, m.sec_idx, m.pos, arg_max(s.sent_key, (s.start, s.sent_idx)) AS sent_key FROM marks m JOIN starts s ON m.book_id = s.book_id AND m.sec_idx = s.sec_idx AND s.start <= m.pos AND s.n > 0 GROUP BY ALL""")
def j10_positional_alignment(spark, sf_dir):
    """As-of: every 500th character of a section and the sentence it lies in. Each sentence emits the marks it covers."""
    n = F.length(T.join_tokens(F.col("toks"), F.col("sp"))).cast("long")
    w = Window.partitionBy("book_id", "sec_idx").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    s = sentences(spark, sf_dir, "book_id", "sec_idx", "sent_idx", "toks", "sp").where("toks IS NOT NULL").withColumn("n", n).withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))
    first = F.ceil(F.col("start") / 500)
    last = F.ceil((F.col("start") + F.col("n")) / 500) - 1
    return s.where(last >= first).select("book_id", "sec_idx", F.explode(F.sequence(first, last)).alias("m"), "sent_key").select("book_id", "sec_idx", (F.col("m") * 500).alias("pos"), "sent_key")


@R.add(f"""WITH {CHUNKS}, want AS (SELECT sent_key, level, 2 AS ci FROM chunks WHERE ci = 0 UNION ALL SELECT sent_key || 'x', level, 0 FROM chunks WHERE ci = 0 AND sent_idx = 0)
SELECT w.sent_key, w.level, coalesce(c.sent_start + least(w.ci, c.n_chunks - 1), -1) AS i FROM want w LEFT JOIN (SELECT * FROM chunks WHERE ci = 0) c ON w.sent_key = c.sent_key AND w.level = c.level""")
def j11_seek(spark, sf_dir):
    """Saved positions (sentence, piece 2) and positions of sentences that are gone."""
    c = _chunks(spark, sf_dir).where("ci = 0").select("sent_key", "level", "sent_idx", "sent_start", "n_chunks")
    want = c.select("sent_key", "level", F.lit(2).alias("ci")).unionByName(c.where("sent_idx = 0").select(F.concat("sent_key", F.lit("x")).alias("sent_key"), "level", F.lit(0).alias("ci")))
    at = F.coalesce(F.col("sent_start") + F.least(F.col("ci"), F.col("n_chunks") - 1), F.lit(-1))
    return want.join(c.select("sent_key", "level", "sent_start", "n_chunks"), ["sent_key", "level"], "left").select("sent_key", "level", at.alias("i"))


@R.add(f"WITH {SENTS} SELECT sent_key, row_number() OVER (PARTITION BY book_id, id ORDER BY sec_idx, sent_idx) - 1 AS occ FROM sents WHERE id IS NOT NULL")
def w1_occurrence(spark, sf_dir):
    s = sentences(spark, sf_dir, "book_id", "sec_idx", "sent_idx", "id").where("id IS NOT NULL")
    return occurrence(s, ["book_id", "id"], "sec_idx", ["sent_idx"]).select("sent_key", "occ")


@R.add(f"WITH {LOOKUP}, t AS (SELECT book_id, lemma, min((sec_idx, sent_idx)) AS f FROM looked WHERE listed AND NOT ent GROUP BY ALL) SELECT t.book_id, t.lemma, s.sent_key, left({duck_join('s.toks', 's.sp')}, 240) AS text FROM t JOIN sents s ON s.book_id = t.book_id AND (s.sec_idx, s.sent_idx) = t.f")
def w2_first_sentence(spark, sf_dir):
    first = _looked(spark, sf_dir).where("listed AND NOT ent").groupBy("book_id", "lemma").agg(F.min_by("sent_key", F.struct("sec_idx", "sent_idx")).alias("sent_key"))
    s = sentences(spark, sf_dir, "toks", "sp").select("sent_key", F.substring(T.join_tokens(F.col("toks"), F.col("sp")), 1, 240).alias("text"))
    return first.join(s, "sent_key").select("book_id", "lemma", "sent_key", "text")


_STUDY = "study AS (SELECT * FROM looked WHERE listed AND NOT ent AND zipf < 3.5)"


@R.add(f"WITH {LOOKUP}, {_STUDY}, f AS (SELECT sent_key, lemma, min(tok_idx) AS i FROM study GROUP BY ALL) SELECT sent_key, list(lemma ORDER BY i) AS lemmas FROM f GROUP BY sent_key")
def w3_study_by_sentence(spark, sf_dir):
    return D.ordered_lemmas(_looked(spark, sf_dir).where(f"listed AND NOT ent AND zipf < {D.STUDY_ZIPF}"), ["sent_key"], "lemma", ["tok_idx"])


@R.add(f"WITH {LOOKUP}, {_STUDY}, f AS (SELECT book_id, sec_idx, lemma, min((sent_idx, tok_idx)) AS i FROM study GROUP BY ALL) SELECT book_id, sec_idx, list(lemma ORDER BY i) AS lemmas FROM f GROUP BY ALL")
def w4_study_by_section(spark, sf_dir):
    return D.ordered_lemmas(_looked(spark, sf_dir).where(f"listed AND NOT ent AND zipf < {D.STUDY_ZIPF}"), ["book_id", "sec_idx"], "lemma", ["sent_idx", "tok_idx"])


@R.add(f"WITH {LOOKUP}, {_STUDY} SELECT book_id, lemma, CASE arg_min(pos, (sec_idx, sent_idx, tok_idx)) WHEN 'NOUN' THEN 'n' WHEN 'PROPN' THEN 'n' WHEN 'VERB' THEN 'v' WHEN 'AUX' THEN 'v' WHEN 'ADJ' THEN 'adj' WHEN 'ADV' THEN 'adv' END AS sense FROM study WHERE pos IS NOT NULL GROUP BY ALL")
def w5_entry_sense(spark, sf_dir):
    senses = F.create_map(*[F.lit(x) for kv in {"NOUN": "n", "PROPN": "n", "VERB": "v", "AUX": "v", "ADJ": "adj", "ADV": "adv"}.items() for x in kv])
    first = _looked(spark, sf_dir).where(f"listed AND NOT ent AND zipf < {D.STUDY_ZIPF} AND pos IS NOT NULL").groupBy("book_id", "lemma").agg(F.min_by("pos", F.struct("sec_idx", "sent_idx", "tok_idx")).alias("pos"))
    return first.select("book_id", "lemma", F.try_element_at(senses, "pos").alias("sense"))


_FUNC = ", ".join(f"'{p}'" for p in D.FUNCTION_POS)


@R.add(f"WITH {LOOKUP} SELECT book_id, lemma, arg_min(pos, (sec_idx, sent_idx, tok_idx)) AS pos, arg_min(sent_key, (sec_idx, sent_idx, tok_idx)) AS sent_key FROM looked WHERE NOT listed AND NOT ent AND pos IS NOT NULL AND pos NOT IN ({_FUNC}, 'PUNCT') GROUP BY ALL")
def w6_common_channel(spark, sf_dir):
    rows = _looked(spark, sf_dir).where(~F.col("listed") & ~F.col("ent") & F.col("pos").isNotNull() & ~F.col("pos").isin([*D.FUNCTION_POS, "PUNCT"]))
    at = F.struct("sec_idx", "sent_idx", "tok_idx")
    return rows.groupBy("book_id", "lemma").agg(F.min_by("pos", at).alias("pos"), F.min_by("sent_key", at).alias("sent_key"))


@R.add(f"WITH {LOOKUP} SELECT book_id, surface, arg_min(lemma, (sec_idx, sent_idx, tok_idx)) AS lemma FROM looked WHERE NOT ent GROUP BY ALL")
def w7_first_wins(spark, sf_dir):
    return _looked(spark, sf_dir).where("NOT ent").groupBy("book_id", "surface").agg(F.min_by("lemma", F.struct("sec_idx", "sent_idx", "tok_idx")).alias("lemma"))


_CHUNK_WORDS = CHUNKS + r", sized AS (SELECT *, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: regexp_matches(w, '[\pL\pN]'))) AS wc FROM chunks)"


def _sized(spark, sf_dir):
    return _chunks(spark, sf_dir).withColumn("wc", F.size(F.filter(F.split("t", r"\s+"), T.is_word)).cast("long"))


@R.add(f"WITH {_CHUNK_WORDS} SELECT level, avg(abs(wc - prev)) AS fluctuation FROM (SELECT *, lag(wc) OVER (PARTITION BY sent_key, level ORDER BY ci) AS prev FROM sized) WHERE prev IS NOT NULL GROUP BY level")
def w9_fluctuation(spark, sf_dir):
    w = Window.partitionBy("sent_key", "level").orderBy("ci")
    return _sized(spark, sf_dir).withColumn("prev", F.lag("wc").over(w)).where("prev IS NOT NULL").groupBy("level").agg(F.avg(F.abs(F.col("wc") - F.col("prev"))).alias("fluctuation"))


@R.add(f"WITH {CHUNKS} SELECT book_id, level, i, t, lag(t) OVER w AS prev, lead(t) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY book_id, sec_idx, level ORDER BY i)")
def w10_context(spark, sf_dir):
    c = D.neighbours(_chunks(spark, sf_dir), ["book_id", "sec_idx", "level"], "i", "t", [-1, 1])
    return c.select("book_id", "level", "i", "t", F.col("m1").alias("prev"), F.col("p1").alias("next"))


_RUNS = SENTS + """, rt AS (SELECT sent_key, i, toks[i] AS tok, coalesce(orth[CAST(i - 1 AS INTEGER)], toks[i]) AS modern, len(list_filter(coalesce(ents, []), lambda e: i - 1 >= e.a AND i - 1 < e.b)) > 0 AS ent,
  length(regexp_replace(substr(sp, 1, i - 1), '[^1]', '', 'g')) AS run FROM sents, unnest(range(1, len(toks) + 1)) AS u(i)),
runs AS (SELECT sent_key, run, string_agg(tok, '' ORDER BY i) AS orig, string_agg(modern, '' ORDER BY i) AS modern, bool_or(ent) AS ent FROM rt GROUP BY ALL)"""


def _runs(spark, sf_dir):
    s = sentences(spark, sf_dir, "toks", "sp", "orth", "ents").where("size(toks) > 0")
    return s.select("sent_key", F.posexplode(D.display_runs(F.col("toks"), F.col("sp"), F.col("orth"), F.col("ents"))).alias("run", "r")).select("sent_key", F.col("run").cast("long").alias("run"), "r.orig", "r.modern", "r.ent")


@R.add(f"WITH {_RUNS} SELECT sent_key, run, orig, modern, ent FROM runs")
def w11_display_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@R.add(f"WITH {_RUNS} SELECT sent_key, string_agg(modern, ' ' ORDER BY run) AS ref, list(ent ORDER BY run) AS discount FROM runs GROUP BY sent_key")
def q7_check_reference(spark, sf_dir):
    s = sentences(spark, sf_dir, "toks", "sp", "orth", "ents").where("size(toks) > 0")
    runs = s.select("sent_key", D.display_runs(F.col("toks"), F.col("sp"), F.col("orth"), F.col("ents")).alias("r"))
    return runs.select("sent_key", F.array_join(F.transform("r", lambda x: x["modern"]), " ").alias("ref"), F.transform("r", lambda x: x["ent"]).alias("discount"))


@R.add(f"""WITH {SENTS}, e AS (SELECT sent_key, sp, len(toks) AS n, list_transform(range(1, length(regexp_replace(substr(sp, 1, length(sp) - 1), '[^1]', '', 'g')) + 2), lambda x: x * 0.25) AS ends FROM sents WHERE len(toks) >= 6),
x AS (SELECT sent_key, CASE WHEN length(regexp_replace(substr(sp, 1, 2), '[^1]', '', 'g')) > 0 THEN ends[length(regexp_replace(substr(sp, 1, 2), '[^1]', '', 'g'))] ELSE 0 END AS t0, ends[length(regexp_replace(substr(sp, 1, 5), '[^1]', '', 'g')) + 1] AS t1 FROM e)
SELECT sent_key, CASE WHEN t1 > t0 THEN CAST(t0 AS DOUBLE) END AS t0, CASE WHEN t1 > t0 THEN CAST(t1 AS DOUBLE) END AS t1 FROM x""")
def w12_audio_slice(spark, sf_dir):
    """Times of the tokens 2 to 6 where each display run takes a quarter of a second."""
    ones = F.length(F.regexp_replace(F.substring("sp", F.lit(1), F.length("sp") - 1), "[^1]", ""))
    s = sentences(spark, sf_dir, "toks", "sp").where("size(toks) >= 6").withColumn("ends", F.transform(F.sequence(F.lit(1), ones + 1), lambda x: x * 0.25))
    cut = D.audio_slice(F.col("sp"), F.col("ends").cast("array<double>"), F.lit(2), F.lit(6))
    return s.select("sent_key", cut.alias("x")).select("sent_key", "x.t0", "x.t1")


@R.add(f"WITH {CHUNKS}, s AS (SELECT DISTINCT book_id, level, sec_idx, sent_idx, sent_key FROM chunks) SELECT sent_key, level, list_filter([lead(sent_key, 1) OVER w, lead(sent_key, 2) OVER w, lead(sent_key, 3) OVER w], lambda x: x IS NOT NULL) AS next FROM s WINDOW w AS (PARTITION BY book_id, sec_idx, level ORDER BY sent_idx)")
def w13_prefetch(spark, sf_dir):
    s = _chunks(spark, sf_dir).where("ci = 0").select("book_id", "level", "sec_idx", "sent_idx", "sent_key")
    ahead = D.neighbours(s, ["book_id", "sec_idx", "level"], "sent_idx", "sent_key", [1, 2, 3])
    return ahead.select("sent_key", "level", F.array_compact(F.array("p1", "p2", "p3")).alias("next"))


_CHUNK_TOKENS = LOOKUP + ", " + LEVELS_SQL + """, ct AS (SELECT l.*, v.level, len(list_filter(coalesce(s.cuts[v.level], []), lambda k: k > 0 AND k < len(s.toks) AND k <= l.tok_idx)) AS raw_ci, len(list_distinct(list_filter(coalesce(s.cuts[v.level], []), lambda k: k > 0 AND k < len(s.toks) AND k <= l.tok_idx))) AS ci
  FROM looked l JOIN sents s ON l.sent_key = s.sent_key, levels v)"""


def _chunk_tokens(spark, sf_dir):
    """Looked-up tokens once for each level, with the piece they lie in."""
    cuts = sentences(spark, sf_dir, "cuts", "toks").select("sent_key", "cuts", F.size("toks").alias("n"))
    levelled = _looked(spark, sf_dir).join(cuts, "sent_key").withColumn("level", F.explode(F.array(*[F.lit(x) for x in D.LEVELS])))
    own = F.coalesce(F.try_element_at("cuts", "level"), F.array().cast("array<int>"))
    return levelled.withColumn("ci", F.size(F.array_distinct(F.filter(own, lambda k: (k > 0) & (k < F.col("n")) & (k <= F.col("tok_idx"))))).cast("long"))


@R.add(f"WITH {_CHUNK_TOKENS} SELECT sent_key, level, ci, arg_min(e, (coalesce(zipf, 0), tok_idx)) AS e FROM ct WHERE listed AND NOT ent AND e IS NOT NULL AND e <> '' GROUP BY ALL")
def k1_chunk_emoji(spark, sf_dir):
    rows = _chunk_tokens(spark, sf_dir).where("listed AND NOT ent AND e IS NOT NULL AND e <> ''")
    return rows.groupBy("sent_key", "level", "ci").agg(F.min_by("e", F.struct(F.coalesce("zipf", F.lit(0.0)), "tok_idx")).alias("e"))


_COMMON = "common AS (SELECT lemma, arg_min(v.e, seq) AS e FROM latest WHERE v.e IS NOT NULL AND v.e <> '' GROUP BY lemma)"


@R.add(f"""WITH {_CHUNK_TOKENS}, {_CACHE}, {_COMMON}, k1 AS (SELECT sent_key, level, ci FROM ct WHERE listed AND NOT ent AND e IS NOT NULL AND e <> '' GROUP BY ALL)
SELECT ct.sent_key, ct.level, ct.ci, arg_min(c.e, ct.tok_idx) AS e FROM ct JOIN common c ON ct.lemma = c.lemma WHERE NOT ct.listed AND NOT ct.ent AND NOT EXISTS (SELECT 1 FROM k1 WHERE k1.sent_key = ct.sent_key AND k1.level = ct.level AND k1.ci = ct.ci) GROUP BY ALL""")
def k2_chunk_emoji_fallback(spark, sf_dir):
    common = cache(spark, sf_dir).where("v.e IS NOT NULL AND v.e <> ''").groupBy("lemma").agg(F.min_by("v.e", "seq").alias("common"))
    rows = _chunk_tokens(spark, sf_dir).where("NOT ent").join(common, "lemma", "left")
    rare = F.max(F.col("listed") & F.col("e").isNotNull() & (F.col("e") != ""))
    first = F.min(F.when(~F.col("listed") & F.col("common").isNotNull(), F.struct("tok_idx", "common")))
    grouped = rows.groupBy("sent_key", "level", "ci").agg(rare.alias("rare"), first.alias("f"))
    return grouped.where("NOT rare AND f IS NOT NULL").select("sent_key", "level", "ci", F.col("f.common").alias("e"))


@R.add(f"""WITH {_CHUNK_TOKENS}, c AS (SELECT sent_key, level, ci, lemma, min(e) AS e, min(coalesce(zipf, 0)) AS z, min(tok_idx) AS i FROM ct WHERE listed AND NOT ent AND e IS NOT NULL AND e <> '' GROUP BY ALL),
n AS (SELECT sent_key, level, ci, least(3, CAST(ceil(count(*) / 5) AS INTEGER)) AS most FROM ct WHERE regexp_matches(tok, '[\\pL\\pN]') GROUP BY ALL),
r AS (SELECT c.*, row_number() OVER (PARTITION BY sent_key, level, ci ORDER BY z, i) AS rn FROM c)
SELECT sent_key, level, ci, list(e ORDER BY i) AS symbols FROM r JOIN n USING (sent_key, level, ci) WHERE rn <= most GROUP BY ALL""")
def k3_multi_emoji(spark, sf_dir):
    rows = _chunk_tokens(spark, sf_dir)
    most = rows.where(T.is_word(F.col("tok"))).groupBy("sent_key", "level", "ci").agg(F.least(F.lit(3), F.ceil(F.count(F.lit(1)) / 5)).cast("int").alias("most"))
    each = rows.where("listed AND NOT ent AND e IS NOT NULL AND e <> ''").groupBy("sent_key", "level", "ci", "lemma").agg(F.min("e").alias("e"), F.min(F.coalesce("zipf", F.lit(0.0))).alias("z"), F.min("tok_idx").alias("i"))
    best = each.groupBy("sent_key", "level", "ci").agg(F.array_sort(F.collect_list(F.struct("z", "i", "e"))).alias("l")).join(most, ["sent_key", "level", "ci"])
    kept = F.array_sort(F.transform(F.slice("l", F.lit(1), F.col("most")), lambda x: F.struct(x["i"], x["e"])))
    return best.select("sent_key", "level", "ci", F.transform(kept, lambda x: x["e"]).alias("symbols"))


@R.add(f"""WITH {_CACHE}, c AS (SELECT lemma, v.e AS e, min(seq) AS s FROM latest WHERE v.e IS NOT NULL AND v.e <> '' GROUP BY ALL)
SELECT lemma, e, rn FROM (SELECT lemma, e, row_number() OVER (PARTITION BY lemma ORDER BY s) AS rn FROM c) WHERE rn <= 3""")
def k4_emoji_candidates(spark, sf_dir):
    c = cache(spark, sf_dir).where("v.e IS NOT NULL AND v.e <> ''").groupBy("lemma", F.col("v.e").alias("e")).agg(F.min("seq").alias("s"))
    w = Window.partitionBy("lemma").orderBy("s")
    return c.withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 3").select("lemma", "e", "rn")


@R.add(f"WITH {SENTS}, s AS (SELECT sent_key, row_number() OVER (PARTITION BY book_id ORDER BY sec_idx, sent_idx) - 1 AS ord FROM sents) SELECT sent_key, ord FROM s WHERE ord < 20")
def k5_first_sentences(spark, sf_dir):
    """The first 20 sentences of each book in reading order: a cap by ordinal, not a bare limit."""
    s = sentences(spark, sf_dir, "book_id", "sec_idx", "sent_idx").withColumn("k", F.lit(0))
    return occurrence(s, ["book_id"], "sec_idx", ["sent_idx"], "ord").where("ord < 20").select("sent_key", "ord")


_RARITY = GLOSSES + ", q AS (SELECT lang, k AS lemma, min(z) AS zipf FROM (SELECT lang, unnest(map_keys(freq)) AS k, unnest(map_values(freq)) AS z FROM glosses) WHERE z IS NOT NULL GROUP BY ALL)"


def _rarity(spark, sf_dir):
    return glosses(spark, sf_dir, "lang", "freq").select("lang", F.explode("freq").alias("lemma", "zipf")).where("zipf IS NOT NULL").groupBy("lang", "lemma").agg(F.min("zipf").alias("zipf"))


@R.add(f"WITH {_RARITY} SELECT lang, lemma, zipf FROM (SELECT *, row_number() OVER (PARTITION BY lang, substr(lemma, 1, 1) ORDER BY zipf, lemma) - 1 AS rn FROM q) WHERE rn % 10 = 0 OR zipf >= 3.3")
def k6_stride_sample(spark, sf_dir):
    """Every tenth lemma by rarity within its initial, and forced keeps."""
    w = Window.partitionBy("lang", F.substring("lemma", 1, 1)).orderBy("zipf", "lemma")
    return _rarity(spark, sf_dir).withColumn("rn", F.row_number().over(w) - 1).where("rn % 10 = 0 OR zipf >= 3.3").select("lang", "lemma", "zipf")


@R.add(f"WITH {_RARITY} SELECT lang, lemma FROM q WHERE zipf <= 0.2 OR substr(sha256(lemma), 1, 2) < '20'")
def k7_hash_sample(spark, sf_dir):
    """A repeatable sample by hash in place of a seeded generator, with the rarest lemmas always kept."""
    return _rarity(spark, sf_dir).where((F.col("zipf") <= 0.2) | (F.substring(F.sha2("lemma", 256), 1, 2) < "20")).select("lang", "lemma")


@R.add(f"""WITH {TOKENS}, {_CACHE}, c AS (SELECT lang, surface, count(*) AS n FROM toks WHERE regexp_matches(surface, '^[a-zäöüß]{{2,}}$') AND NOT ent GROUP BY ALL)
SELECT lang, surface, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, surface) AS rn FROM c) WHERE rn <= 500 AND surface NOT IN (SELECT lemma FROM latest)""")
def k8_lemma_pool(spark, sf_dir):
    """The 500 most frequent plain words of each language that have no answer yet."""
    counts = _tokens(spark, sf_dir).where("NOT ent AND surface RLIKE '^[a-zäöüß]{2,}$'").groupBy("lang", "surface").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "surface")
    top = counts.withColumn("rn", F.row_number().over(w)).where("rn <= 500")
    return top.join(cache(spark, sf_dir).select(F.col("lemma").alias("surface")).distinct(), "surface", "left_anti").select("lang", "surface", "n")


@R.add("SELECT lang, book_id, title FROM books ORDER BY lang, book_id")
def k9_library_order(spark, sf_dir):
    return table(spark, sf_dir, "books").select("lang", "book_id", "title").orderBy("lang", "book_id")


@R.add(f"""WITH {LOOKUP} SELECT sent_key, tok_idx, list_filter([CASE WHEN pos IN ('VERB', 'AUX') THEN 'verb' END, CASE WHEN ent THEN 'ent' END, CASE WHEN listed AND NOT ent AND zipf < 3.5 THEN 'study' END], lambda x: x IS NOT NULL) AS classes FROM looked""")
def q8_token_spans(spark, sf_dir):
    classes = F.array_compact(F.array(F.when(F.col("pos").isin("VERB", "AUX"), "verb"), F.when(F.col("ent"), "ent"), F.when(F.col("listed") & ~F.col("ent") & (F.col("zipf") < D.STUDY_ZIPF), "study")))
    return _looked(spark, sf_dir).select("sent_key", F.col("tok_idx").cast("long").alias("tok_idx"), classes.alias("classes"))


@R.add(f"WITH {SENTS}, n AS (SELECT book_id, sec_idx, count(*) AS found FROM sents GROUP BY ALL) SELECT s.book_id, s.sec_idx, coalesce(nullif(trim(s.title), ''), '') AS title, s.n_sent, coalesce(n.found, 0) AS found FROM sections s LEFT JOIN n ON s.book_id = n.book_id AND s.sec_idx = n.sec_idx")
def q9_contents(spark, sf_dir):
    n = sentences(spark, sf_dir, "book_id", "sec_idx").groupBy("book_id", "sec_idx").agg(F.count(F.lit(1)).alias("found"))
    s = table(spark, sf_dir, "sections").join(n, ["book_id", "sec_idx"], "left")
    return s.select("book_id", "sec_idx", F.coalesce(F.trim("title"), F.lit("")).alias("title"), "n_sent", F.coalesce("found", F.lit(0)).alias("found"))


@R.add(f"WITH {LOOKUP}, {_STUDY} SELECT sent_key, lemma, min(tok_idx) AS tok_idx, min(coalesce(nullif(g_de, ''), g_en)) AS entry FROM study GROUP BY ALL")
def q10_study_sheet(spark, sf_dir):
    rows = _looked(spark, sf_dir).where(f"listed AND NOT ent AND zipf < {D.STUDY_ZIPF}")
    return rows.groupBy("sent_key", "lemma").agg(F.min("tok_idx").cast("long").alias("tok_idx"), F.min(F.coalesce(F.nullif("g_de", F.lit("")), "g_en")).alias("entry"))


@R.add(f"""WITH {CHUNKS}, n AS (SELECT book_id, level, max(i) + 1 AS total FROM chunks GROUP BY ALL), one AS (SELECT sent_key, level, sent_start FROM chunks WHERE ci = 0)
SELECT a.book_id, a.sent_key, a.i AS i, coalesce(o.sent_start, CAST(round(a.i / n.total * m.total) AS BIGINT)) AS other FROM chunks a LEFT JOIN one o ON a.sent_key = o.sent_key AND o.level = 'beginner' JOIN n ON n.book_id = a.book_id AND n.level = 'starter' JOIN n m ON m.book_id = a.book_id AND m.level = 'beginner'
WHERE a.level = 'starter'""")
def q11_level_switch(spark, sf_dir):
    """Where a reader at each starter piece lands at beginner: the same sentence, else the same fraction of the book."""
    c = _chunks(spark, sf_dir)
    one = c.where("ci = 0 AND level = 'beginner'").select("sent_key", F.col("sent_start").alias("target"))
    n = c.groupBy("book_id").pivot("level", ["starter", "beginner"]).agg((F.max("i") + 1).alias("n"))
    rows = c.where("level = 'starter'").join(one, "sent_key", "left").join(n, "book_id")
    return rows.select("book_id", "sent_key", "i", F.coalesce("target", F.round(F.col("i") / F.col("starter") * F.col("beginner")).cast("long")).alias("other"))


@R.add(f"""WITH {CHUNKS}, last AS (SELECT c.sent_key, c.level, c.n_chunks, s.rungs, s.cuts, len(s.toks) AS n FROM chunks c JOIN sents s ON c.sent_key = s.sent_key WHERE NOT c.cont AND c.n_chunks > 1)
SELECT sent_key, level, unnest(steps) AS range, generate_subscripts(steps, 1) - 1 AS step FROM (SELECT sent_key, level, list_concat(list_transform(list_filter(list_reverse(coalesce(rungs, [])), lambda r: r <> coalesce(cuts[level], [])), lambda r: list_concat([0], r, [n])), [[0, n]]) AS steps FROM last)""")
def q12_virtual_steps(spark, sf_dir):
    s = D.at_levels(sentences(spark, sf_dir, "toks", "cuts", "rungs")).where("size(bounds) > 2")
    steps = D.ladder(F.col("rungs"), F.try_element_at("cuts", "level"), F.size("toks"))
    return s.select("sent_key", "level", F.posexplode(steps).alias("step", "range")).select("sent_key", "level", F.col("range").cast("array<long>").alias("range"), F.col("step").cast("long").alias("step"))


@R.add(f"WITH {CHUNKS}, f AS (SELECT book_id, min(sec_idx) AS sec_idx FROM chunks GROUP BY book_id), s AS (SELECT c.*, row_number() OVER (PARTITION BY c.book_id, level ORDER BY i) - 1 AS k FROM chunks c JOIN f ON c.book_id = f.book_id AND c.sec_idx = f.sec_idx) SELECT book_id, level, k, t FROM s WHERE k BETWEEN 5 AND 9")
def q13_chunk_window(spark, sf_dir):
    """Pieces 5 to 9 of the first section of each book."""
    c = _chunks(spark, sf_dir)
    first = c.groupBy("book_id").agg(F.min("sec_idx").alias("sec_idx"))
    w = Window.partitionBy("book_id", "level").orderBy("i")
    return c.join(first, ["book_id", "sec_idx"]).withColumn("k", F.row_number().over(w).cast("long") - 1).where("k BETWEEN 5 AND 9").select("book_id", "level", "k", "t")


@R.add(f"WITH {CHUNKS} SELECT book_id, level, sec_idx, min(i) AS i FROM chunks GROUP BY ALL")
def q14_jump_to_section(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("book_id", "level", "sec_idx").agg(F.min("i").alias("i"))


@R.add(f"""WITH {CHUNKS}, n AS (SELECT book_id, level, max(i) + 1 AS n FROM chunks GROUP BY ALL) SELECT c.book_id, c.level, c.i, coalesce(lag(t, 2) OVER w, '') AS m2, coalesce(lag(t, 1) OVER w, '') AS m1, coalesce(lead(t, 1) OVER w, '') AS p1, coalesce(lead(t, 2) OVER w, '') AS p2,
100.0 * (c.i + 1) / n.n AS progress FROM chunks c JOIN n ON c.book_id = n.book_id AND c.level = n.level WINDOW w AS (PARTITION BY c.book_id, c.level, c.sec_idx ORDER BY c.i)""")
def q15_context_window(spark, sf_dir):
    """Two pieces before and after within the section, and how far into the book a piece lies."""
    c = _chunks(spark, sf_dir)
    n = c.groupBy("book_id", "level").agg((F.max("i") + 1).alias("n"))
    near = D.neighbours(c, ["book_id", "level", "sec_idx"], "i", "t", [-2, -1, 1, 2]).join(n, ["book_id", "level"])
    return near.select("book_id", "level", "i", *[F.coalesce(x, F.lit("")).alias(x) for x in ("m2", "m1", "p1", "p2")], (F.lit(100.0) * (F.col("i") + 1) / F.col("n")).alias("progress"))

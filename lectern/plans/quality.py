"""Registered queries of statistics, validation, linting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import lint
from lectern.functions import text as T
from lectern.operators import derive as D
from lectern.operators import quality as Q
from lectern.plans.common import GLOSSES, SENTS, Registry, glosses, sentences
from lectern.plans.derive import _CHUNK_TOKENS, _CHUNK_WORDS, AT, CHUNKS, LOOKUP, _chunk_tokens, _chunks, _looked, _sized
from lectern.plans.text import _CACHE, cache, duck_join, duck_norm
from lectern.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

# Least, wanted and most words of a piece at each level.
PRESETS = [("starter", 2, 2, 3), ("beginner", 2, 3, 5), ("intermediate", 2, 5, 8), ("advanced", 3, 8, 12)]
PRESETS_SQL = "presets AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, {c}, {d})" for a, b, c, d in PRESETS) + ") AS p(level, min, target, max))"


def presets(spark):
    return spark.createDataFrame(PRESETS, "level string, min int, target int, max int")


_WORDS = r"len(list_filter({}, lambda t: regexp_matches(t, '[\pL\pN]')))"


@R.add(f"WITH {AT} SELECT book_id, count(*) FILTER (WHERE level = 'starter') AS sentences, sum({_WORDS.format('toks')}) FILTER (WHERE level = 'starter') AS words, " + ", ".join(f"sum(len(bounds) - 1) FILTER (WHERE level = '{x}') AS {x}" for x in D.LEVELS) + f", round_even(sum({_WORDS.format('toks')}) FILTER (WHERE level = 'starter') / count(*) FILTER (WHERE level = 'starter'), 1) AS average FROM at_levels GROUP BY book_id")
def a1_book_stats(spark, sf_dir):
    s = sentences(spark, sf_dir, "book_id", "toks", "cuts").where("size(toks) > 0")
    words = F.size(F.filter("toks", T.is_word)).cast("long")
    pieces = {x: F.sum(F.size(D.boundaries(F.col("cuts"), F.lit(x), F.col("toks"))) - 1).alias(x) for x in D.LEVELS}
    return s.groupBy("book_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(words).alias("words"), *pieces.values(), F.bround(F.sum(words) / F.count(F.lit(1)), 1).alias("average"))


@R.add(f"WITH {LOOKUP}, w AS (SELECT book_id, lemma, min(zipf) AS z FROM looked WHERE NOT ent AND regexp_matches(tok, '[\\pL\\pN]') GROUP BY ALL) SELECT book_id, count(*) AS lemmas, round_even(count(*) FILTER (WHERE z < 4.0) / count(*), 3) AS vocab_below_zipf4 FROM w GROUP BY book_id")
def a2_vocabulary_share(spark, sf_dir):
    each = _looked(spark, sf_dir).where(~F.col("ent") & T.is_word(F.col("tok"))).groupBy("book_id", "lemma").agg(F.min("zipf").alias("z"))
    return each.groupBy("book_id").agg(F.count(F.lit(1)).alias("lemmas"), F.bround(F.count_if(F.col("z") < 4.0) / F.count(F.lit(1)), 3).alias("vocab_below_zipf4"))


@R.add("SELECT book_id, CASE WHEN s >= 4.5 THEN 'advanced' WHEN s >= 3 THEN 'intermediate' WHEN s IS NOT NULL THEN 'beginner' END AS label FROM (SELECT book_id, stats.avg_sentence_len / 8 + stats.vocab_below_zipf4 / 0.15 AS s FROM books)")
def a3_difficulty(spark, sf_dir):
    return table(spark, sf_dir, "books").select("book_id", Q.difficulty_label(F.col("stats.avg_sentence_len"), F.col("stats.vocab_below_zipf4")).alias("label"))


@R.add(f"WITH {_CHUNK_WORDS}, {PRESETS_SQL} SELECT level, len(string_split(t, ' ')) AS words, count(*) AS n, count(*) FILTER (WHERE len(string_split(t, ' ')) > max) AS over FROM sized JOIN presets USING (level) WHERE t <> '' GROUP BY ALL")
def a4_length_histogram(spark, sf_dir):
    c = _chunks(spark, sf_dir).where("t <> ''").withColumn("words", F.size(F.split("t", " ")).cast("long")).join(F.broadcast(presets(spark)), "level")
    return c.groupBy("level", "words").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("words") > F.col("max")).alias("over"))


@R.add(f"WITH {CHUNKS}, c AS (SELECT c.level, {_WORDS.format('s.toks[c.a + 1 : c.b]')} AS w FROM chunks c JOIN sents s ON c.sent_key = s.sent_key) SELECT level, avg(w) AS mean, stddev_pop(w) / avg(w) AS cv, max(w) AS longest FROM c GROUP BY level")
def a5_level_lengths(spark, sf_dir):
    s = D.at_levels(sentences(spark, sf_dir, "toks", "cuts"))
    n = F.size("bounds") - 1
    w = s.select("level", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.size(F.filter(F.slice("toks", F.get("bounds", i - 1) + 1, F.get("bounds", i) - F.get("bounds", i - 1)), T.is_word)))).alias("w"))
    return w.groupBy("level").agg(F.avg("w").alias("mean"), (F.stddev_pop("w") / F.avg("w")).alias("cv"), F.max("w").cast("long").alias("longest"))


@R.add(f"WITH {_CHUNK_WORDS}, {PRESETS_SQL} SELECT level, count(*) AS n, avg(wc) AS mean, stddev_pop(wc) AS stdev, stddev_pop(wc) / avg(wc) AS cv, avg(CASE WHEN wc < min THEN 1.0 ELSE 0.0 END) AS under, avg(CASE WHEN wc > max THEN 1.0 ELSE 0.0 END) AS over, max(wc) AS longest FROM sized JOIN presets USING (level) GROUP BY level")
def a6_piece_stats(spark, sf_dir):
    return Q.piece_statistics(_sized(spark, sf_dir), presets(spark))


_NEST = " + ".join(f"len(list_filter(list_distinct(coalesce(cuts['{c}'], [])), lambda k: NOT list_contains(coalesce(cuts['{f}'], []), k)))" for c, f in zip(D.LEVELS, D.LEVELS[1:]))


@R.add(f"WITH {SENTS} SELECT book_id, sum({_NEST}) AS violations FROM sents WHERE cuts IS NOT NULL GROUP BY book_id")
def a7_nesting_violations(spark, sf_dir):
    s = sentences(spark, sf_dir, "book_id", "cuts").where("cuts IS NOT NULL")
    return s.groupBy("book_id").agg(F.sum(Q.nesting_violations(F.col("cuts"))).alias("violations"))


@R.add(f"WITH {_CHUNK_WORDS}, l AS (SELECT sent_key FROM sents WHERE {_WORDS.format('toks')} >= 25), w AS (SELECT level, sent_key, max(wc) AS worst FROM sized WHERE level IN ('intermediate', 'advanced') AND sent_key IN (SELECT sent_key FROM l) GROUP BY ALL) SELECT level, count(*) AS n, avg(worst) AS mean, max(worst) AS worst FROM w GROUP BY level")
def a8_long_sentences(spark, sf_dir):
    long = sentences(spark, sf_dir, "toks").where(F.size(F.filter("toks", T.is_word)) >= 25).select("sent_key")
    worst = _sized(spark, sf_dir).where("level IN ('intermediate', 'advanced')").join(long, "sent_key", "left_semi").groupBy("level", "sent_key").agg(F.max("wc").alias("worst"))
    return worst.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("worst").alias("mean"), F.max("worst").alias("worst"))


@R.add(f"WITH {SENTS} SELECT len(rungs) AS depth, count(*) AS n, count(*) FILTER (WHERE len(list_filter(range(1, len(rungs)), lambda i: len(list_filter(rungs[i], lambda k: NOT list_contains(rungs[i + 1], k))) > 0)) > 0) AS not_nested, count(*) FILTER (WHERE len(list_distinct(rungs)) < len(rungs)) AS repeated FROM sents WHERE rungs IS NOT NULL GROUP BY 1")
def a9_rung_ladders(spark, sf_dir):
    chain = F.exists(F.sequence(F.lit(1), F.greatest(F.size("rungs") - 1, F.lit(1))), lambda i: (i < F.size("rungs")) & (F.size(F.array_except(F.get("rungs", i - 1), F.coalesce(F.get("rungs", i), F.array().cast("array<int>")))) > 0))
    s = sentences(spark, sf_dir, "rungs").where("rungs IS NOT NULL")
    return s.groupBy(F.size("rungs").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.count_if(chain).alias("not_nested"), F.count_if(F.size(F.array_distinct("rungs")) < F.size("rungs")).alias("repeated"))


_MISSES = LOOKUP + ", misses AS (SELECT lemma, list_sort(list_distinct(list(surface))) AS surfaces FROM looked WHERE zipf < 3.5 AND coalesce(g_en, '') = '' AND NOT ent GROUP BY lemma)"


def _misses(spark, sf_dir):
    rows = _looked(spark, sf_dir).where("zipf < 3.5 AND coalesce(g_en, '') = '' AND NOT ent")
    return rows.groupBy("lemma").agg(F.sort_array(F.collect_set("surface")).alias("surfaces"))


@R.add(f"WITH {_MISSES} SELECT lemma, surfaces FROM misses")
def a10_misses(spark, sf_dir):
    return _misses(spark, sf_dir)


@R.add(f"WITH {_MISSES} SELECT lemma || chr(9) || array_to_string(surfaces, ', ') AS line FROM misses")
def s9_misses_tsv(spark, sf_dir):
    return _misses(spark, sf_dir).select(F.concat_ws("\t", "lemma", F.array_join("surfaces", ", ")).alias("line"))


@R.add(f"WITH {_MISSES}, t AS (SELECT lemma || chr(9) || array_to_string(surfaces, ', ') AS line FROM misses) SELECT split_part(line, chr(9), 1) AS lemma, unnest(string_split(split_part(line, chr(9), 2), ', ')) AS surface FROM t")
def s19_read_misses(spark, sf_dir):
    parts = s9_misses_tsv(spark, sf_dir).select(F.split("line", "\t").alias("p"))
    return parts.select(F.get("p", F.lit(0)).alias("lemma"), F.explode(F.split(F.get("p", F.lit(1)), ", ")).alias("surface"))


_TOK = r"regexp_extract_all({}, '[\pL\pN_’''-]+|[^\pL\pN_\s]')"


def _in(word: str, *names: str) -> str:
    lists = [", ".join("'" + w + "'" for w in sorted({w for n in names for w in L[n].split()})) for L in (lint.DE, lint.EN)]
    return f"(CASE WHEN lang = 'de' THEN {word} IN ({lists[0]}) ELSE {word} IN ({lists[1]}) END)"


_LINT = CHUNKS + f""", n AS (SELECT c.*, s.lang, lead(t) OVER (PARTITION BY c.book_id, c.sec_idx, level ORDER BY i) AS nxt FROM chunks c JOIN sents s ON c.sent_key = s.sent_key),
tk AS (SELECT *, {_TOK.format('t')} AS tk, list_filter({_TOK.format("coalesce(nxt, '')")}, lambda w: regexp_matches(w, '^[\\pL\\pN_’''-]+$')) AS nw FROM n),
p AS (SELECT *, coalesce(tk[-1], '') AS last, lower(coalesce(tk[-1], '')) AS low, CASE WHEN len(tk) > 1 THEN tk[-2] ELSE '' END AS before, coalesce(nw[1], '') AS first, list_filter(tk, lambda w: regexp_matches(w, '^[\\pL\\pN_’''-]+$')) AS words FROM tk),
linted AS (SELECT book_id, level, i, lang, regexp_matches(t, '\\S[—–]\\S') AS glued_dash, {_in('low', 'art')} AND regexp_matches(first, '^\\p{{Ll}}') AS end_art, {_in('low', 'sub')} AS end_sub,
  last = ',' AND {_in('before', 'conj')} AS conj_comma, ({_in('low', 'prep_strict')} AND NOT {_in('low', 'sub')}) OR (NOT ({_in('low', 'prep_strict')} AND NOT {_in('low', 'sub')}) AND {_in('low', 'prep_ambig')} AND {_in('lower(first)', 'art')}) AS end_prep,
  len(words) = 1 AND {_in("lower(coalesce(words[1], ''))", *lint.DE)} AS lone_func FROM p)"""


def _linted(spark, sf_dir):
    lang = sentences(spark, sf_dir, "lang").select("sent_key", "lang")
    c = D.neighbours(_chunks(spark, sf_dir), ["book_id", "sec_idx", "level"], "i", "t", [1]).join(lang, "sent_key")
    return c.withColumns(lint.violations(F.col("t"), F.col("p1"), F.col("lang")))


def _rule_query(number: int, rule: str):
    def query(spark, sf_dir):
        return _linted(spark, sf_dir).where(rule).select("book_id", "level", "i", "t")

    query.__name__ = f"l{number}_{rule}"
    R.add(_LINT.replace("linted AS (SELECT book_id, level, i, lang,", "linted AS (SELECT book_id, level, i, t,").join(["WITH ", f" SELECT book_id, level, i, t FROM linted WHERE {rule}"]))(query)


for _n, _rule in enumerate(lint.RULES, 1):
    _rule_query(_n, _rule)


@R.add(f"WITH {_LINT} SELECT level, book_id, count(*) AS n, " + ", ".join(f"count_if({r}) AS {r}" for r in lint.RULES) + " FROM linted GROUP BY ROLLUP (level, book_id) HAVING level IS NOT NULL")
def a11_lint_counts(spark, sf_dir):
    counts = [F.count_if(r).alias(r) for r in lint.RULES]
    return _linted(spark, sf_dir).rollup("level", "book_id").agg(F.count(F.lit(1)).alias("n"), *counts).where("level IS NOT NULL")


_AUDIO = f"{SENTS}, a AS (SELECT book_id, sec_idx, id, max(length(rtrim({duck_join('toks', 'sp')}, ' '))) AS chars FROM sents WHERE toks IS NOT NULL GROUP BY ALL)"


def _audio(spark, sf_dir):
    s = sentences(spark, sf_dir, "book_id", "sec_idx", "id", "toks", "sp").where("toks IS NOT NULL")
    return s.groupBy("book_id", "sec_idx", "id").agg(F.max(F.length(F.rtrim(T.join_tokens(F.col("toks"), F.col("sp"))))).cast("long").alias("chars"))


@R.add(f"WITH {_AUDIO}, done AS (SELECT DISTINCT id, chars / 14 AS dur FROM a WHERE substr(id, 1, 1) < '8') SELECT book_id, count(*) AS total, count(d.id) AS covered, count(*) = count(d.id) AS complete, round(coalesce(sum(d.dur), 0), 1) AS seconds FROM (SELECT DISTINCT book_id, id FROM a) x LEFT JOIN (SELECT id, max(dur) AS dur FROM done GROUP BY id) d ON x.id = d.id GROUP BY book_id")
def a12_audio_coverage(spark, sf_dir):
    """Sentences with audio per book, where those whose id is in the first half of the id space have been recorded."""
    a = _audio(spark, sf_dir)
    done = a.where(F.substring("id", 1, 1) < "8").groupBy("id").agg(F.max(F.col("chars") / 14).alias("dur")).withColumn("has", F.lit(1))
    rows = a.select("book_id", "id").distinct().join(done, "id", "left")
    return rows.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"), F.count("has").alias("covered"), (F.count(F.lit(1)) == F.count("has")).alias("complete"), F.round(F.coalesce(F.sum("dur"), F.lit(0.0)), 1).alias("seconds"))


@R.add(f"WITH {_AUDIO} SELECT book_id, sec_idx, count(*) AS ids, sum(chars) / 14 / 60 AS minutes, count(*) FILTER (WHERE substr(id, 1, 1) >= '8') AS new FROM a GROUP BY ALL")
def a13_audio_estimate(spark, sf_dir):
    return _audio(spark, sf_dir).groupBy("book_id", "sec_idx").agg(F.count(F.lit(1)).alias("ids"), (F.sum("chars") / 14 / 60).alias("minutes"), F.count_if(F.substring("id", 1, 1) >= "8").alias("new"))


@R.add(f"WITH {LOOKUP} SELECT book_id, count(*) AS words, count(*) FILTER (WHERE f) AS hits, count(*) FILTER (WHERE f) / count(*) >= 0.9 AS passes FROM (SELECT l.book_id, fo.surface IS NOT NULL AS f FROM looked l LEFT JOIN forms fo ON l.book_id = fo.book_id AND l.sec_idx = fo.sec_idx AND l.surface = fo.surface WHERE NOT l.ent AND regexp_matches(l.tok, '[\\pL\\pN]')) GROUP BY book_id")
def a14_lemma_coverage(spark, sf_dir):
    forms = glosses(spark, sf_dir, "book_id", "sec_idx", "forms").select("book_id", "sec_idx", F.explode(F.map_keys("forms")).alias("surface"), F.lit(1).alias("hit"))
    s = sentences(spark, sf_dir, "book_id", "sec_idx", "sent_idx", "lang", "toks", "pos", "ents", "orth")
    rows = D.tokens(s).where(~F.col("ent") & T.is_word(F.col("tok"))).join(forms, ["book_id", "sec_idx", "surface"], "left")
    return rows.groupBy("book_id").agg(F.count(F.lit(1)).alias("words"), F.count("hit").alias("hits"), (F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("passes"))


@R.add(f"WITH {_CHUNK_TOKENS}, c AS (SELECT sent_key, level, ci, max(CASE WHEN listed AND NOT ent AND e IS NOT NULL AND e <> '' THEN 1 ELSE 0 END) AS has FROM ct GROUP BY ALL) SELECT level, count(*) AS n, avg(has) AS share FROM c GROUP BY level")
def a15_emoji_coverage(spark, sf_dir):
    has = F.max(F.when(F.col("listed") & ~F.col("ent") & F.col("e").isNotNull() & (F.col("e") != ""), 1).otherwise(0))
    return _chunk_tokens(spark, sf_dir).groupBy("sent_key", "level", "ci").agg(has.alias("has")).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("has").alias("share"))


@R.add(f"WITH {CHUNKS}, n AS (SELECT book_id, level, max(i) + 1 AS n FROM chunks GROUP BY ALL) SELECT c.sent_key, c.level, CAST(round(100 * (c.sent_start + 1) / n.n) AS BIGINT) AS percent FROM chunks c JOIN n ON c.book_id = n.book_id AND c.level = n.level WHERE c.ci = 0")
def a17_library_percent(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    n = c.groupBy("book_id", "level").agg((F.max("i") + 1).alias("n"))
    return c.where("ci = 0").join(n, ["book_id", "level"]).select("sent_key", "level", F.round(100 * (F.col("sent_start") + 1) / F.col("n")).cast("long").alias("percent"))


@R.add(f"WITH {SENTS} SELECT id, count(DISTINCT {duck_norm(duck_join('toks', 'sp'))}) AS texts FROM sents WHERE toks IS NOT NULL GROUP BY id HAVING count(DISTINCT {duck_norm(duck_join('toks', 'sp'))}) > 1")
def a18_id_collisions(spark, sf_dir):
    s = sentences(spark, sf_dir, "id", "toks", "sp").where("toks IS NOT NULL").select("id", T.join_tokens(F.col("toks"), F.col("sp")).alias("t")).distinct()
    return s.select("id", T.norm_text(F.col("t")).alias("t")).groupBy("id").agg(F.count_distinct("t").alias("texts")).where("texts > 1")


@R.add(f"WITH {SENTS} SELECT sent_key FROM sents WHERE toks IS NOT NULL AND id <> substr(sha256({duck_norm(duck_join('toks', 'sp'))}), 1, 12)")
def v1_reconstruction(spark, sf_dir):
    s = sentences(spark, sf_dir, "id", "toks", "sp").where("toks IS NOT NULL")
    return s.where(T.sentence_id(T.join_tokens(F.col("toks"), F.col("sp"))) != F.col("id")).select("sent_key")


_V = {
    "v6_sp_length": "length(sp) <> len(toks)",
    "v6_pos_length": "pos IS NOT NULL AND len(pos) <> len(toks)",
    "v6_breaks_order": "bp <> list_sort(list_distinct(bp))",
    "v6_breaks_range": "len(list_filter(bp, lambda k: k <= 0 OR k >= len(toks))) > 0",
    "v6_ents_range": "len(list_filter(coalesce(ents, []), lambda e: e.a < 0 OR e.a >= e.b OR e.b > len(toks))) > 0",
    "v2_nesting": f"{_NEST} > 0",
    "v2_rungs": "len(list_filter(coalesce(rungs, []), lambda r: len(list_filter(r, lambda k: NOT list_contains(coalesce(cuts['advanced'], []), k))) > 0)) > 0",
    "v2_chain": "len(list_filter(range(1, len(coalesce(rungs, []))), lambda i: len(list_filter(rungs[i], lambda k: NOT list_contains(rungs[i + 1], k))) > 0)) > 0",
    "v3_cuts": " OR ".join(f"len(list_filter(coalesce(cuts['{x}'], []), lambda k: NOT list_contains(bp, k))) > 0" for x in D.LEVELS),
    "v3_rungs": "len(list_filter(coalesce(rungs, []), lambda r: len(list_filter(r, lambda k: NOT list_contains(bp, k))) > 0)) > 0",
}
_VBASE = f"WITH {SENTS}, s AS (SELECT *, list_transform(coalesce(breaks, []), lambda b: b.k) AS bp FROM sents WHERE len(toks) > 0)"


def _rules(spark, sf_dir, prefix):
    s = sentences(spark, sf_dir, "toks", "sp", "pos", "ents", "breaks", "cuts", "rungs").where("size(toks) > 0")
    return Q.violated(s, {k: v for k, v in Q.sentence_rules().items() if k.startswith(prefix)}, "sent_key")


@R.add(_VBASE + " " + " UNION ALL ".join(f"SELECT '{k}' AS rule, sent_key FROM s WHERE {v}" for k, v in _V.items() if k.startswith("v2")))
def v2_nesting(spark, sf_dir):
    return _rules(spark, sf_dir, "v2")


@R.add(_VBASE + " " + " UNION ALL ".join(f"SELECT '{k}' AS rule, sent_key FROM s WHERE {v}" for k, v in _V.items() if k.startswith("v3")))
def v3_legal_cuts(spark, sf_dir):
    return _rules(spark, sf_dir, "v3")


@R.add(f"WITH {SENTS} SELECT 'twice' AS rule, book_id, id, count(*) AS n FROM sents GROUP BY book_id, sec_idx, id, coalesce(occ, 0) HAVING count(*) > 1")
def v4_identity(spark, sf_dir):
    s = sentences(spark, sf_dir, "book_id", "sec_idx", "id", "occ")
    return s.groupBy("book_id", "sec_idx", "id", F.coalesce("occ", F.lit(0)).alias("occ")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("twice").alias("rule"), "book_id", "id", "n")


@R.add(f"WITH {AT} SELECT DISTINCT 'v5_wordless' AS rule, sent_key FROM at_levels WHERE len(list_filter(range(1, len(bounds)), lambda i: {_WORDS.format('toks[bounds[i] + 1 : bounds[i + 1]]')} = 0)) > 0")
def v5_wordless(spark, sf_dir):
    return _rules(spark, sf_dir, "v5")


@R.add(_VBASE + " " + " UNION ALL ".join(f"SELECT '{k}' AS rule, sent_key FROM s WHERE {v}" for k, v in _V.items() if k.startswith("v6")))
def v6_structure(spark, sf_dir):
    return _rules(spark, sf_dir, "v6")


@R.add(f"""WITH {GLOSSES}, {SENTS}, n AS (SELECT book_id, sec_idx, count(*) AS found FROM sents GROUP BY ALL)
SELECT 'no_gloss' AS rule, s.book_id, s.sec_idx FROM sections s WHERE NOT EXISTS (SELECT 1 FROM glosses g WHERE g.book_id = s.book_id AND g.sec_idx = s.sec_idx)
UNION ALL SELECT 'no_section', g.book_id, g.sec_idx FROM glosses g WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE g.book_id = s.book_id AND g.sec_idx = s.sec_idx)
UNION ALL SELECT 'count', s.book_id, s.sec_idx FROM sections s LEFT JOIN n ON n.book_id = s.book_id AND n.sec_idx = s.sec_idx WHERE s.n_sent <> coalesce(n.found, 0)""")
def v8_gloss_keys(spark, sf_dir):
    key = ["book_id", "sec_idx"]
    g = glosses(spark, sf_dir, *key).select(*key)
    s = table(spark, sf_dir, "sections").select(*key, "n_sent")
    n = sentences(spark, sf_dir, *key).groupBy(*key).agg(F.count(F.lit(1)).alias("found"))
    named = lambda rule, df: df.select(F.lit(rule).alias("rule"), *key)
    counts = s.join(n, key, "left").where(F.col("n_sent") != F.coalesce("found", F.lit(0)))
    return named("no_gloss", s.join(g, key, "left_anti")).unionByName(named("no_section", g.join(s, key, "left_anti"))).unionByName(named("count", counts))


@R.add(f"""WITH {GLOSSES}, {_CACHE}, c AS (SELECT lemma, v.e AS e FROM latest), w AS (SELECT DISTINCT unnest(map_keys(words)) AS lemma FROM glosses), f AS (SELECT DISTINCT unnest(map_values(forms)) AS lemma FROM glosses)
SELECT 'in_words' AS rule, lemma FROM c WHERE lemma IN (SELECT lemma FROM w) UNION ALL SELECT 'empty', lemma FROM c WHERE coalesce(e, '') = '' UNION ALL SELECT 'unreachable', lemma FROM c WHERE lemma NOT IN (SELECT lemma FROM f WHERE lemma IS NOT NULL)""")
def v9_common_channel(spark, sf_dir):
    g = glosses(spark, sf_dir, "words", "forms")
    c = cache(spark, sf_dir).select("lemma", F.col("v.e").alias("e"))
    w = g.select(F.explode(F.map_keys("words")).alias("lemma")).distinct()
    f = g.select(F.explode(F.map_values("forms")).alias("lemma")).distinct()
    parts = {"in_words": c.join(w, "lemma", "left_semi"), "empty": c.where("coalesce(e, '') = ''"), "unreachable": c.join(f, "lemma", "left_anti")}
    out = [df.select(F.lit(rule).alias("rule"), "lemma") for rule, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@R.add(f"WITH {SENTS} SELECT sent_key, {' AND '.join(f'len(list_filter(coalesce(cuts[{chr(39)}{c}{chr(39)}], []), lambda k: NOT list_contains(coalesce(cuts[{chr(39)}{f}{chr(39)}], []), k))) = 0' for c, f in zip(D.LEVELS, D.LEVELS[1:]))} AS nested FROM sents WHERE cuts IS NOT NULL")
def u1_subset(spark, sf_dir):
    s = sentences(spark, sf_dir, "cuts").where("cuts IS NOT NULL")
    return s.select("sent_key", (Q.nesting_violations(F.col("cuts")) == 0).alias("nested"))


@R.add("SELECT lemma, arg_max(e, seq) AS e FROM (SELECT split_part(k, '|', 2) AS lemma, v.e AS e, seq FROM experiment_alice WHERE v.e IS NOT NULL AND v.e <> '') GROUP BY lemma")
def u3_merge_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "experiment_alice").where("v.e IS NOT NULL AND v.e <> ''").select(F.split_part("k", F.lit("|"), F.lit(2)).alias("lemma"), F.col("v.e").alias("e"), "seq")
    return rows.groupBy("lemma").agg(F.max_by("e", "seq").alias("e"))


@R.add(f"WITH {GLOSSES} SELECT unnest(map_keys(words)) AS lemma FROM glosses UNION SELECT split_part(k, '|', 2) FROM experiment_alice")
def u4_covered(spark, sf_dir):
    a = glosses(spark, sf_dir, "words").select(F.explode(F.map_keys("words")).alias("lemma"))
    return a.union(table(spark, sf_dir, "experiment_alice").select(F.split_part("k", F.lit("|"), F.lit(2)).alias("lemma"))).distinct()


_STARS = "stars AS (SELECT c.*, sent_key || '#' || ci AS key FROM chunks c WHERE substr(sha256(sent_key || '#' || ci), 1, 1) = '0')"


@R.add(f"WITH {CHUNKS}, {_STARS} SELECT book_id, level, i, t FROM stars")
def u5_starred_deck(spark, sf_dir):
    """Starred pieces of all levels as one deck, ordered by level and place; a hash stands in for the reader's stars."""
    stars = _chunks(spark, sf_dir).where(F.substring(F.sha2(F.concat_ws("#", "sent_key", "ci"), 256), 1, 1) == "0")
    return stars.orderBy("book_id", "level", "i").select("book_id", "level", "i", "t")


@R.add("SELECT split_part(k, '|', 1) AS prompt, count(*) AS answers, count(DISTINCT k) AS keys, max(seq) AS last FROM experiment_alice GROUP BY 1")
def u6_cache_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "experiment_alice").groupBy(F.split_part("k", F.lit("|"), F.lit(1)).alias("prompt"), "k").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))
    return rows.groupBy("prompt").agg(F.sum("n").alias("answers"), F.count(F.lit(1)).alias("keys"), F.max("last").alias("last"))


@R.add(f"WITH {_CACHE} SELECT k, v.d AS d, v.e AS e, seq FROM latest")
def s6_cache_latest(spark, sf_dir):
    return cache(spark, sf_dir).select("k", F.col("v.d").alias("d"), F.col("v.e").alias("e"), "seq")


@R.add("""WITH upd AS (SELECT book_id, lang, title || ' (rev)' AS title FROM books WHERE difficulty IS NULL UNION ALL SELECT 'new_' || book_id, lang, title FROM books WHERE lang = 'en')
SELECT * FROM (SELECT book_id, lang, title FROM books b WHERE NOT EXISTS (SELECT 1 FROM upd u WHERE u.book_id = b.book_id) UNION ALL SELECT * FROM upd) ORDER BY lang, book_id""")
def s7_upsert_index(spark, sf_dir):
    books = table(spark, sf_dir, "books").select("book_id", "lang", "title", "difficulty")
    new = books.where("difficulty IS NULL").select("book_id", "lang", F.concat("title", F.lit(" (rev)")).alias("title"))
    new = new.unionByName(books.where("lang = 'en'").select(F.concat(F.lit("new_"), "book_id").alias("book_id"), "lang", "title"))
    return upsert(books.drop("difficulty"), new, "book_id").orderBy("lang", "book_id")


def upsert(old, new, key):
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


@R.add(f"WITH {_CACHE} SELECT k, 'no definition' AS reason FROM latest WHERE v.d IS NULL UNION ALL SELECT k, 'no symbol' FROM latest WHERE v.d IS NOT NULL AND coalesce(v.e, '') = ''")
def s11_rejects(spark, sf_dir):
    reason = F.when(F.col("v.d").isNull(), "no definition").when(F.coalesce("v.e", F.lit("")) == "", "no symbol")
    return cache(spark, sf_dir).select("k", reason.alias("reason")).where("reason IS NOT NULL")


_STORE = "store AS (SELECT user_id, event_type AS pref, arg_max(value, (ts, event_id)) AS value, count(*) AS writes FROM events GROUP BY ALL)"


@R.add(f"WITH {_STORE} SELECT user_id, count(*) AS keys, count(*) FILTER (WHERE starts_with(pref, 'p')) AS p_keys, max(value) FILTER (WHERE pref = 'view') AS last_view, sum(writes) AS writes FROM store GROUP BY user_id")
def s18_reader_state(spark, sf_dir):
    """Reader state as upserts by (user, key): last value, keys by prefix; the events stand in for store writes."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("pref")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count(F.lit(1)).alias("writes"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.startswith("pref", F.lit("p"))).alias("p_keys"), F.max(F.when(F.col("pref") == "view", F.col("value"))).alias("last_view"), F.sum("writes").alias("writes"))

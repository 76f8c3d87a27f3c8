"""Invariants as relations of violations, and corpus statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.derive import LEVELS


def own_cuts(cuts: Column, level: str) -> Column:
    return F.coalesce(F.try_element_at(cuts, F.lit(level)), F.array().cast("array<int>"))


def _outside(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b))


def sentence_rules() -> dict[str, Column]:
    """Name and condition of each violation inside one sentence; null fields count as empty."""
    none = F.array().cast("array<int>")
    toks, sp, n = F.col("toks"), F.col("sp"), F.size("toks")
    positions = F.coalesce(F.transform("breaks", lambda b: b["k"]), none)
    rungs = F.coalesce(F.col("rungs"), F.array().cast("array<array<int>>"))
    cuts = {x: own_cuts(F.col("cuts"), x) for x in LEVELS}
    pairs = list(zip(LEVELS, LEVELS[1:]))
    chain = F.exists(F.sequence(F.lit(1), F.greatest(F.size(rungs) - 1, F.lit(0))), lambda i: (i < F.size(rungs)) & (F.size(F.array_except(F.get(rungs, i - 1), F.coalesce(F.get(rungs, i), none))) > 0))

    def wordless(own: Column) -> Column:
        bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.filter(own, lambda k: (k > 0) & (k < n)), F.array(n))))
        return F.exists(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: ~F.exists(F.slice(toks, F.get(bounds, i - 1) + 1, F.get(bounds, i) - F.get(bounds, i - 1)), T.is_word))

    return {
        "v6_sp_length": F.length(sp) != n,
        "v6_pos_length": F.col("pos").isNotNull() & (F.size("pos") != n),
        "v6_breaks_order": positions != F.array_sort(F.array_distinct(positions)),
        "v6_breaks_range": F.exists(positions, lambda k: (k <= 0) | (k >= n)),
        "v6_ents_range": F.coalesce(F.exists("ents", lambda e: (e["a"] < 0) | (e["a"] >= e["b"]) | (e["b"] > n)), F.lit(False)),
        "v2_nesting": reduce(lambda a, b: a | b, [_outside(cuts[c], cuts[f]) > 0 for c, f in pairs]),
        "v2_rungs": F.exists(rungs, lambda r: F.size(F.array_except(r, cuts["advanced"])) > 0),
        "v2_chain": chain,
        "v3_cuts": reduce(lambda a, b: a | b, [_outside(cuts[x], positions) > 0 for x in LEVELS]),
        "v3_rungs": F.exists(rungs, lambda r: F.size(F.array_except(r, positions)) > 0),
        "v5_wordless": reduce(lambda a, b: a | b, [wordless(cuts[x]) for x in LEVELS]),
    }


def violated(df: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """(rule, keys) of each violated rule, from one pass over the rows."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.select(*keys, F.explode(hits).alias("rule")).select("rule", *keys)


def nesting_violations(cuts: Column) -> Column:
    """Coarse cuts missing from the next finer level, over the three neighbouring pairs."""
    return sum((_outside(own_cuts(cuts, c), own_cuts(cuts, f)) for c, f in zip(LEVELS, LEVELS[1:])), F.lit(0))


def piece_statistics(pieces: DataFrame, limits: DataFrame) -> DataFrame:
    """Per level: pieces, mean, deviation and its ratio, shares under and over the limits, longest. Needs level and wc."""
    wc = F.col("wc")
    return (
        pieces.join(F.broadcast(limits), "level")  # one row a level
        .groupBy("level")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(wc).alias("mean"),
            F.stddev_pop(wc).alias("stdev"),
            (F.stddev_pop(wc) / F.avg(wc)).alias("cv"),
            F.avg(F.when(wc < F.col("min"), 1.0).otherwise(0.0)).alias("under"),
            F.avg(F.when(wc > F.col("max"), 1.0).otherwise(0.0)).alias("over"),
            F.max(wc).alias("longest"),
        )
    )


def difficulty_label(average: Column, uncommon: Column) -> Column:
    score = average / 8 + uncommon / 0.15
    return F.when(score >= 4.5, "advanced").when(score >= 3, "intermediate").when(score.isNotNull(), "beginner")

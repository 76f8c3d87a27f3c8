"""Parse-free predicates on pieces of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import lint_tokens

# The closed word classes of the lint rules.
DE = {
    "art": "der die das den dem des ein eine einen einem einer eines",
    "sub": "dass daß weil wenn obwohl während bevor nachdem indem als ob falls sodass",
    "conj": "und oder sondern",
    "prep_strict": "durch für gegen ohne zwischen bei seit trotz während wegen",
    "prep_ambig": "an auf aus in mit nach um unter über von vor zu zur zum vom beim im am ins ans hinter neben",
    "pron": "er sie es ich du wir ihr man sich mich dich uns euch",
}
EN = {
    "art": "the a an",
    "sub": "that because although while if when since unless whether",
    "conj": "and or but nor",
    "prep_strict": "of from into onto during towards toward between against without within upon",
    "prep_ambig": "in on at by with to over under through about off out up down",
    "pron": "he she it i you we they him her them his its their",
}
RULES = ["glued_dash", "end_art", "end_sub", "conj_comma", "end_prep", "lone_func"]


def violations(t: Column, following: Column, lang: Column) -> dict[str, Column]:
    """Each rule for a piece, the next piece of its section and the language; others than German use the English lists."""

    def member(word: Column, *names: str) -> Column:
        lists = [sorted({w for n in names for w in L[n].split()}) for L in (DE, EN)]
        return F.when(lang == "de", word.isin(lists[0])).otherwise(word.isin(lists[1]))

    toks = lint_tokens(t)
    none = F.lit("")
    last = F.coalesce(F.get(toks, F.size(toks) - 1), none)
    before = F.coalesce(F.get(toks, F.size(toks) - 2), none)
    low = F.lower(last)
    words = F.filter(toks, lambda w: w.rlike(r"^[\p{L}\p{N}_’'-]+$"))
    first = F.coalesce(F.get(F.filter(lint_tokens(F.coalesce(following, none)), lambda w: w.rlike(r"^[\p{L}\p{N}_’'-]+$")), F.lit(0)), none)
    strict = member(low, "prep_strict") & ~member(low, "sub")
    return {
        "glued_dash": t.rlike(r"\S[—–]\S"),
        "end_art": member(low, "art") & first.rlike(r"^\p{Ll}"),
        "end_sub": member(low, "sub"),
        "conj_comma": (last == ",") & member(before, "conj"),
        "end_prep": strict | (~strict & member(low, "prep_ambig") & member(F.lower(first), "art")),
        "lone_func": (F.size(words) == 1) & member(F.lower(F.coalesce(F.get(words, F.lit(0)), none)), *DE),
    }

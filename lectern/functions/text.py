"""Text expressions: normalising, cleaning, titles, ids, words. All are JVM expressions but for NFC, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode text splitting knows it.
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"

#: Its complement.
NOT_WS = WS.replace("[", "[^", 1)
# Fixed value: the marker lines around a book's body.
MARKER = r"\*\*\* ?{} OF (?:THE|THIS) PROJECT GUTENBERG[^\n]*?\*\*\*"
# What makes a heading, small words that need no capital, and marks a title does not end in.
HEADING_WORDS = "chapter|kapitel|book|buch"
TITLE_STOP = (
    "der die das und oder von vom dem den des im in an auf zu zur zum mit bei um für aus nach vor über unter un syner einem einer ein eine "
    "the and of in a an or to at on for"
).split()
TITLE_END = list(".!?…,;:”’\"'«»‹›")
# Spelled numbers of the scorer.
NUMBER_WORDS = {
    "null": 0, "eins": 1, "ein": 1, "eine": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "fuenf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "elf": 11, "zwölf": 12, "zwoelf": 12,
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
}


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """NFC form; null stays null."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, outer white space away."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def norm_text(text: Column) -> Column:
    return collapse(nfc(text))


def nfc_lower(text: Column) -> Column:
    return F.lower(nfc(text))


def is_word(text: Column) -> Column:
    """Whether any letter or digit occurs."""
    return text.rlike(r"[\p{L}\p{N}]")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def sentence_id(text: Column) -> Column:
    """Content address: first 12 hex digits of the hash of the normalised text."""
    return short_hash(norm_text(text))


def source_hash(raw: Column) -> Column:
    return F.concat(F.lit("sha256:"), short_hash(raw))


def strip_markers(text: Column) -> Column:
    """The part between a START and an END marker line, each of them optional."""
    head = F.regexp_replace(text, "(?s)^.*?" + MARKER.format("START"), "")
    return F.regexp_replace(head, "(?s)" + MARKER.format("END") + ".*$", "")


def clean(text: Column) -> Column:
    """Line ends, illustration notes, markup characters, blanks, then dashes set off by blanks; the order matters."""
    steps = [
        (r"\r\n", "\n"),
        (r"\[Illustration:?[^\]]*\]", " "),
        (r"[_~=]", ""),
        (r"·", " "),
        (r"  +", " "),
        (r"--", "—"),
        (rf"(?<={NOT_WS})([—–])", " $1"),
        (rf"([—–])(?={NOT_WS})", "$1 "),
    ]
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs, white space collapsed, empty ones dropped."""
    parts = F.split(text, rf"\n{WS}*\n")
    return F.filter(F.transform(parts, collapse), lambda p: p != "")


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n"), collapse), lambda p: p != "")


def looks_like_title(p: Column) -> Column:
    """Heading keyword, bare roman numeral, or a short capitalised phrase without final punctuation."""
    words = F.split(p, " ")
    content = F.filter(words, lambda w: w.rlike(r"\p{L}") & ~F.lower(w).isin(TITLE_STOP))
    capital = F.filter(content, lambda w: w.rlike(r"^\p{Lu}"))
    share = F.size(capital) / F.greatest(F.size(content), F.lit(1))
    last = F.get(content, F.size(content) - 1).rlike(r"^\p{Lu}")
    phrase = (
        (F.size(words) <= 8)
        & (F.length(p) <= 60)
        & ~F.substring(p, -1, 1).isin(TITLE_END)
        & p.rlike(r"^\p{Lu}")
        & (F.size(content) > 0)
        & (share >= F.when(last, 0.5).otherwise(0.7))
    )
    return F.coalesce(p.rlike(rf"(?i)^({HEADING_WORDS})\b") | p.rlike(r"^[IVXLC]+\.$") | phrase, F.lit(False))


def trim_regex(text: Column, skip_until: str | None, stop_at: str | None) -> Column:
    """From the first match of one line pattern up to the first match of another; a pattern without match does nothing."""
    if skip_until:
        at = F.regexp_instr(text, F.lit(f"(?m){skip_until}"))
        text = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)
    if stop_at:
        at = F.regexp_instr(text, F.lit(f"(?m){stop_at}"))
        text = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    return text


def norm_word(word: Column) -> Column:
    """One word as the scorer sees it: NFC, lower case, ß as ss, only a-z, digits and umlauts kept."""
    return F.regexp_replace(F.regexp_replace(nfc_lower(word), "ß", "ss"), "[^a-z0-9äöü]", "")


def norm_words(text: Column) -> Column:
    """Words of what was said: as ``norm_word``, but other characters part words."""
    folded = F.regexp_replace(nfc_lower(text), "ß", "ss")
    return F.filter(F.split(folded, "[^a-z0-9äöü]+"), lambda w: w != "")


def num_canon(word: Column) -> Column:
    """Digits and spelled numbers as a plain integer string, else null."""
    spelled = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in (kv[0], str(kv[1]))])
    return F.when(word.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.regexp_replace(word, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(F.element_at(spelled, word))


def word_match(ref: Column, hyp: Column) -> Column:
    """Equal; else both numbers and the same number; else at most one edit in short words, two in long ones."""
    a, b = num_canon(ref), num_canon(hyp)
    near = F.levenshtein(ref, hyp) <= F.when(F.length(ref) <= 5, 1).otherwise(2)
    return F.when(ref == hyp, True).when(a.isNotNull() & b.isNotNull(), a == b).otherwise(near)


def leaks_headword(lemma: Column, definition: Column) -> Column:
    """Whether a definition holds its own headword, or for long words the headword less two letters."""
    low, text = F.lower(lemma), F.lower(definition)
    stem = F.substring(low, F.lit(1), F.length(low) - 2)
    return F.contains(text, low) | ((F.length(low) > 6) & F.contains(text, stem))


def orth_variants(word: Column) -> Column:
    """Modern spellings of an archaic word, most certain first, without the word itself."""
    th, ey = F.regexp_replace(word, "th", "t"), F.regexp_replace(word, "ey", "ei")
    both = F.regexp_replace(th, "ey", "ei")
    return F.array_remove(F.array_distinct(F.array(th, ey, both, F.regexp_replace(word, "ß", "ss"))), word)


def orth_proposals(word: Column) -> Column:
    """Spellings that are only reported, never applied."""
    return F.array_remove(F.array_distinct(F.array(F.regexp_replace(word, "ie", "i"), F.regexp_replace(word, r"([aeo])\1", "$1"))), word)


def lint_tokens(text: Column) -> Column:
    """Words, to which apostrophes and hyphens belong, and single marks."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_’'-]+|[^\p{L}\p{N}_\s])"), F.lit(1))


def split_words(text: Column) -> Column:
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def join_tokens(toks: Column, sp: Column) -> Column:
    """Text of tokens, a blank after each whose bit is 1."""
    return F.array_join(F.transform(toks, lambda t, i: F.concat(t, F.when(F.substring(sp, i + 1, F.lit(1)) == "1", " ").otherwise(""))), "")


def slice_text(toks: Column, sp: Column, a: Column, b: Column, raw: bool = False) -> Column:
    """Text of the token interval [a, b), its right end trimmed unless raw."""
    part = join_tokens(F.slice(toks, a + 1, b - a), F.substring(sp, a + 1, b - a))
    return part if raw else F.rtrim(part)


def modern_tokens(toks: Column, orth: Column) -> Column:
    """Tokens with the modern form where one is stored for the position."""
    return F.transform(toks, lambda t, i: F.coalesce(F.try_element_at(orth, i), t))


def opus_seconds(text: Column) -> Column:
    """Seconds of a reported playback length such as 1h:02m:03.4s; null if there is none."""
    pattern = r"Playback length:\s*(?:(\d+)h)?:?(\d+)m:([\d.]+)s"
    part = lambda n: F.coalesce(F.nullif(F.regexp_extract(text, pattern, n), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(text.rlike(pattern), F.bround(part(1) * 3600 + part(2) * 60 + part(3), 2))


def token_word_count(toks: Column, sp: Column) -> Column:
    """Tokens that are words; the parts of a glued hyphen compound count once."""
    glued = F.transform(
        toks,
        lambda t, i: is_word(t) & ~((i >= 2) & F.coalesce(F.get(toks, i - 1) == "-", F.lit(False)) & (F.substring(sp, i - 1, F.lit(2)) == "00")),
    )
    return F.size(F.filter(glued, lambda x: x))

"""One consistent spelling for text that looks the same: compatibility forms, invisible characters, look-alike letters.

The rules are DuckDB SQL that runs inside Arrow partitions, over the distinct strings of each batch only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow import as_array, flat_strings, lists_from
from lectern.llm.mojibake import SUSPECT, token_verdicts

# Letters of other scripts that look like Latin ones.
CYRILLIC_FROM = "АВЕЅІЈКМНОРСТУХԌԚԜавеѕіјкморстухѵһԁԛԝ"
CYRILLIC_TO = "ABESIJKMHOPCTYXGQWaBesijkmopcTyxvhdqw"
GREEK_FROM = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺανοιρκυχϲϳ"
GREEK_TO = "ABEZHIKMNOPTYXCMavoipkuxcj"
# Symbols that begin a joined sequence (people, flags, and the few animals and signs that do).
JOINERS = "👦👧👨👩👴👵👶👮👯👰👱👲👳👷👸💁💂💆💇🙂🙅🙆🙇🙋🙍🙎🚣🚴🚵🚶🛀🛌🤦🤵🤷🤸🤹🤼🤽🤾🥷🦸🦹🧍🧎🧏🧑🧒🧓🧔🧕🧖🧗🧘🧙🧚🧛🧜🧝🧞🧟🏃🏄🏊🏋🏌🏂🕴🕵⛹🫅🏴🏳🐈🐕🐻🐦❤👁😶😮😵⛓🍋🍄🦰🦱🦳🦲💋🤝🫱♀♂⚕⚖✈"

INVISIBLE = r"\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{feff}\x{ffa0}"
#: The same without the joiner.
UNJOINED = INVISIBLE.replace(r"\x{200b}-\x{200f}", r"\x{200b}\x{200c}\x{200e}\x{200f}")
SELECTORS = r"\x{fe00}-\x{fe0f}"
SPACES = r"\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SYMBOL = r"\x{2600}-\x{27bf}\x{2b00}-\x{2bff}\x{1f000}-\x{1faff}\x{20e3}"
#: Rows with no other character need no SQL at all; used on the JVM side.
PLAIN = r"\x09\x0a\x0d\x20-\x7e\xa1-\xa7\xab\xac\xae\xb0\xb1\xb6\xb7\xbb\xbf-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}“”„‘’‚‹›–—…"


@lru_cache(1)
def compatibility() -> tuple[str, str, dict[str, str]]:
    """Characters with a compatibility form of one character (from, to), and those with a longer one.

    Built from the Unicode data; typographic punctuation such as the ellipsis is proper and left out.
    """
    one_from, one_to, many = [], [], {}
    for code in [*range(0xA8, 0x2010), *range(0x2070, 0xD7FC), *range(0xF900, 0x10000), *range(0x1CCD6, 0x1F7FF), *range(0x1FBF0, 0x1FBFA), *range(0x2F800, 0x2FA1E)]:
        ch = chr(code)
        plain = unicodedata.normalize("NFKC", ch)
        if plain == ch or unicodedata.normalize("NFC", ch) == plain or not plain.strip() or unicodedata.category(ch) in ("Zs", "Sk"):
            continue
        if len(plain) == 1:
            one_from.append(ch)
            one_to.append(plain)
        else:
            many[ch] = plain
    return "".join(one_from), "".join(one_to), many


@lru_cache(1)
def text_symbols() -> str:
    """Symbols shown as text unless a selector follows."""
    codes = [*range(0xA9, 0xAF), *range(0x2000, 0x3300), *range(0x1F000, 0x1FB00)]
    return "".join(chr(c) for c in codes if regex.match(r"\p{Emoji}", chr(c)) and not regex.match(r"\p{Emoji_Presentation}", chr(c)))


TOKEN_SQL = rf"""
WITH visible AS (
  SELECT id, s, regexp_replace(nfc_normalize(s),
    CASE WHEN regexp_matches(s, '[{SYMBOL}]') THEN '[\x{{ad}}\x{{200b}}\x{{200e}}\x{{200f}}\x{{2060}}-\x{{206f}}\x{{feff}}]+' ELSE '[{INVISIBLE}{SELECTORS}]+' END, '', 'g') AS t
  FROM tokens
), narrow AS (
  SELECT id, s, translate(t, $one_from, $one_to) AS t FROM visible
), spelled AS (
  SELECT n.id, string_agg(coalesce(m.plain, c.ch), '' ORDER BY c.pos) AS t
  FROM (SELECT id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS pos FROM narrow WHERE regexp_matches(t, $many)) c
  JOIN narrow n ON n.id = c.id LEFT JOIN longer m ON m.ch = c.ch GROUP BY n.id
), plain AS (
  SELECT n.id, n.s, trim(regexp_replace(nfc_normalize(coalesce(p.t, n.t)), '[{SPACES}]+', ' ', 'g')) AS t FROM narrow n LEFT JOIN spelled p ON p.id = n.id
), mixed AS (
  SELECT *, regexp_matches(t, '\p{{Latin}}[\p{{Cyrillic}}\p{{Greek}}]|[\p{{Cyrillic}}\p{{Greek}}]\p{{Latin}}') AS is_mixed FROM plain
)
SELECT id, CASE WHEN is_mixed THEN translate(translate(t, $cyrillic_from, $cyrillic_to), $greek_from, $greek_to) ELSE t END AS t, is_mixed OR t <> s AS changed
FROM mixed ORDER BY id
"""

SYMBOL_SQL = rf"""
WITH bare AS (
  SELECT id, s, regexp_replace(translate(s, '０１２３４５６７８９', '0123456789'), '[{SPACES}{UNJOINED}{SELECTORS}]+', '', 'g') AS t FROM tokens
), joined AS (
  SELECT id, s, regexp_replace(regexp_replace(regexp_replace(t, '\x{{200d}}+', chr(8205), 'g'), '(^|[^' || $joiners || '\x{{1f3fb}}-\x{{1f3ff}}])\x{{200d}}', '\1', 'g'), '\x{{200d}}$', '') AS t FROM bare
), selected AS (
  SELECT id, s, regexp_replace(regexp_replace(regexp_replace(t, '([' || $text_symbols || '])', '\1' || chr(65039), 'g'), chr(65039) || '([\x{{1f3fb}}-\x{{1f3ff}}])', '\1', 'g'), '([0-9#*])\x{{20e3}}', '\1' || chr(65039) || chr(8419), 'g') AS t
  FROM joined
)
SELECT id, t, t <> s AS changed FROM selected ORDER BY id
"""


def _connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 1; SET memory_limit = '400MB'")
    _, _, many = compatibility()
    con.register("longer_rows", pa.table({"ch": list(many), "plain": list(many.values())}))
    con.execute("CREATE TABLE longer AS SELECT * FROM longer_rows")
    return con


def _normalise(con: duckdb.DuckDBPyConnection, sql: str, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Canonical spelling of each distinct string and whether it differs; embedded SQL."""
    one_from, one_to, many = compatibility()
    con.register("tokens", pa.table({"id": pa.array(np.arange(len(words))), "s": words}))
    names = {"one_from": one_from, "one_to": one_to, "many": "[" + "".join(many) + "]", "cyrillic_from": CYRILLIC_FROM, "cyrillic_to": CYRILLIC_TO, "greek_from": GREEK_FROM, "greek_to": GREEK_TO, "joiners": JOINERS, "text_symbols": text_symbols()}
    out = con.execute(sql, {k: v for k, v in names.items() if f"${k}" in sql}).to_arrow_table()
    con.unregister("tokens")
    return as_array(out.column("t")).cast(pa.string()), pc.fill_null(as_array(out.column("changed")), False).to_numpy(zero_copy_only=False)


def _spell(con, sql: str, values: pa.Array, skip_garbled: bool) -> tuple[pa.Array, np.ndarray]:
    coded = values.dictionary_encode()
    words = coded.dictionary.cast(pa.string())
    if not len(words):
        return values, np.zeros(len(values), bool)
    spelled, changed = _normalise(con, sql, words)
    if skip_garbled and changed.any():
        spots = np.flatnonzero(changed & pc.match_substring_regex(words, SUSPECT).to_numpy(zero_copy_only=False))
        _, garbled = token_verdicts(words.take(pa.array(spots)))
        changed[spots[garbled]] = False
    spelled = pc.if_else(pa.array(changed), spelled, words)
    flags = pa.array(changed).take(coded.indices)
    return spelled.take(coded.indices), pc.fill_null(flags, False).to_numpy(zero_copy_only=False)


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _connection()
    for batch in batches:
        flat, rows = flat_strings(batch.column("toks"))
        spelled, changed = _spell(con, TOKEN_SQL, flat, skip_garbled=True)
        n = np.bincount(rows[changed], minlength=batch.num_rows).astype(np.int32)
        lists = lists_from(spelled, rows, batch.num_rows)
        nulls = as_array(batch.column("toks")).is_null()
        lists = pc.if_else(nulls, pa.scalar(None, lists.type), lists)
        yield pa.RecordBatch.from_arrays([batch.column("key"), lists, pa.array(n)], ["key", "toks", "changed"])


def _symbol_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _connection()
    for batch in batches:
        spelled, changed = _spell(con, SYMBOL_SQL, as_array(batch.column("e")), skip_garbled=False)
        yield pa.RecordBatch.from_arrays([batch.column("key"), spelled, pa.array(changed)], ["key", "e", "changed"])


def consistent_tokens(rows: DataFrame, key: str, toks: str) -> DataFrame:
    """(key, toks, changed): every row, its tokens in one spelling, and how many were changed.

    Words wholly in another script, curly quotes and dashes stay; garbled tokens are left as they are. Rows with
    only plain characters bypass Python. Null lists stay null, null tokens stay null, empty lists stay empty; rows
    delivered again come out again.
    """
    slim = rows.select(F.col(key).alias("key"), F.col(toks).alias("toks"))
    odd = F.coalesce(F.array_join("toks", "\n").rlike(f"[^{PLAIN}]|(^|\n)\\s|\\s(\n|$)|[\\x09\\x0d]|  "), F.lit(False))
    kind = dict(rows.dtypes)[key]
    changed = slim.where(odd).mapInArrow(_token_batches, f"key {kind}, toks array<string>, changed int")
    return slim.where(~odd).select("key", "toks", F.lit(0).cast("int").alias("changed")).unionByName(changed)


def consistent_symbols(rows: DataFrame, key: str, symbol) -> DataFrame:
    """(key, e, changed): every row with its symbols fully qualified and free of stray characters; null stays null."""
    slim = rows.select(F.col(key).alias("key"), symbol.alias("e"))
    kind = dict(rows.dtypes)[key]
    return slim.mapInArrow(_symbol_batches, f"key {kind}, e string, changed boolean")

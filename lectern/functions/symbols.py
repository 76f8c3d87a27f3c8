"""Checks and repairs of symbol strings."""

from __future__ import annotations

import re

KEYCAP = re.compile("[0-9#*]️?⃣")
_GENDER = re.compile("‍[♀♂]️?")
#: Code point ranges that hold symbols of their own, and the mathematical operators, which are none. Fixed values.
SYMBOL_RANGES = [(0x1F000, 0x10FFFF), (0x2600, 0x27BF), (0x2190, 0x21FF), (0x2300, 0x23FF), (0x25A0, 0x25FF), (0x2B00, 0x2BFF)]
OPERATORS = (0x2200, 0x22FF)
PEOPLE = frozenset("👦👧👨👩👴👵👶🧒🧑🧓")
MOST_UNITS, MOST_CHARS = 2, 10


def is_symbol(text: str) -> bool:
    codes = [ord(c) for c in text]
    return any(a <= o <= b for o in codes for a, b in SYMBOL_RANGES) and not any(OPERATORS[0] <= o <= OPERATORS[1] for o in codes)


def without_gender(text: str) -> str:
    """Joined gender signs dropped; the base symbol means the same."""
    return _GENDER.sub("", text.strip())


def _bare(text: str) -> list[str]:
    return [c for c in text if c not in "️⃣" and not "\U0001f3fb" <= c <= "\U0001f3ff"]


def sane(text: str) -> bool:
    """Empty, one keycap, or at most two symbols without letters, digits or blanks; a joined sequence is one symbol."""
    if not text or KEYCAP.fullmatch(text):
        return True
    if len(text) > MOST_CHARS or any(c.isspace() or c.isascii() and c.isalnum() for c in text):
        return False
    bare = _bare(text)
    return len(bare) - 2 * bare.count("‍") <= MOST_UNITS and is_symbol(text)


def sane_run(text: str) -> bool:
    """As ``sane``, but several keycaps in a row pass too."""
    return bool(re.fullmatch(f"(?:{KEYCAP.pattern})+", text)) or sane(text)


def rejoined(text: str) -> str:
    """Three or more people without joiners are one family."""
    bare = _bare(text)
    return "‍".join(bare) if "‍" not in text and len(bare) >= 3 and PEOPLE.issuperset(bare) else text

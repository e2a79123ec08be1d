"""Numbers as documents write them, and the nouns that they number."""

from __future__ import annotations

import re

from ..operators.structure import PLURALS

#: Number words, ordinals, roman digits and short forms of nouns.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = (
    "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
)
TENTHS = {"thirtieth": 30, "fortieth": 40, "fiftieth": 50}
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
SHORT_NOUNS = {"ch": "chapter", "chap": "chapter", "sec": "section", "art": "article", "annexure": "annex", "annexures": "annex", "appendixes": "appendix"}
SINGULAR = {p: s for s, p in PLURALS.items()} | {s: s for s in PLURALS}
NUMBER_WORD = rf"(?:(?:{'|'.join(TENS)})(?:[- ](?:{'|'.join(UNITS[1:10])}))?|{'|'.join(UNITS[1:])})"
NOUN = rf"(?:{'|'.join(sorted(PLURALS, key=len, reverse=True))}|annexure|ch\.?|chap\.?|sec\.?|art\.?)"

WORDS = {w: n for n, w in enumerate(UNITS)} | {w: n for n, w in enumerate(ORDINALS, start=1)} | TENTHS | {w: 10 * n for n, w in enumerate(TENS, start=2)}


def roman(value: str) -> int | None:
    """Value of a roman numeral: a digit counts against the larger ones behind it."""
    digits = [ROMAN[c] for c in value]
    total = sum(-d if d < max(digits[i:]) else d for i, d in enumerate(digits))
    return total if 0 < total < 4000 else None


def parse_number(value: str) -> int | None:
    """Digits, number words, ordinals, roman numerals (not a lone d, c, l or m) or a letter's place in the alphabet."""
    value = value.strip().casefold().rstrip(".")
    if value.isdigit():
        return int(value)
    if value in WORDS:
        return WORDS[value]
    parts = re.split("[- ]", value)
    if parts[0] in TENS:
        return WORDS[parts[0]] + (UNITS.index(parts[1]) if len(parts) > 1 and parts[1] in UNITS else 0)
    if value and set(value) <= set(ROMAN) and value not in ("d", "c", "l", "m"):
        return roman(value)
    return ord(value) - 96 if re.fullmatch("[a-z]", value) else None


def singular(noun: str | None) -> str | None:
    """The known noun that a word is a form of."""
    if not noun:
        return None
    noun = noun.casefold().rstrip(".")
    return SINGULAR.get(SHORT_NOUNS.get(noun, noun))


def plural(noun: str, count: int | None = None) -> str:
    return noun if count == 1 else PLURALS.get(noun, noun + "s")

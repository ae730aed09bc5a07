"""Index stems: the published Porter algorithm, and the folding of words before it."""

from __future__ import annotations

import re
import unicodedata


def _form(word: str) -> str:
    """Letters as v and c: y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _cvc(word: str) -> bool:
    return _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


LONGEST = 64
# The published suffix tables of steps 2, 3 and 4.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_TABLES = [sorted((tuple(x.split(":")) for x in s.split()), key=lambda p: -len(p[0])) for s in (STEP2, STEP3)]
_STEP4 = sorted(STEP4.split(), key=lambda s: -len(s))


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two bytes and very long ones stay."""
    if not 2 < len(word.encode("utf-8", "replace")) <= LONGEST:
        return word
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: -len(end)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _form(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    for table in _TABLES:
        for end, to in table:
            if word.endswith(end):
                word = word[: -len(end)] + to if _measure(word[: -len(end)]) > 0 else word
                break
    for end in _STEP4:
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or m == 1 and not _cvc(word[:-1]) else word
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def fold(word: str) -> str:
    """Without diacritics, as the index sees a word."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))

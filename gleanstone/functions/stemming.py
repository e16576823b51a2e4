"""The Porter stemmer, from its published definition, applied to a vocabulary rather than to texts."""

from __future__ import annotations

import re
from functools import cache

#: The suffixes of steps 2, 3 and 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


@cache
def porter(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: -len(suffix)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                if "v" in _shape(stem):
                    if stem.endswith(("at", "bl", "iz")):
                        stem += "e"
                    elif _shape(stem).endswith("cc") and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                        stem = stem[:-1]
                    elif _measure(stem) == 1 and _short(stem):
                        stem += "e"
                    w = stem
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for suffix, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]):
                    w = w[: -len(suffix)] + new
                break
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w

"""The Porter stemmer for English (M. F. Porter, 1980)."""

from __future__ import annotations

import functools

# Suffixes and what stands for them, as the algorithm defines them.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _consonants(w: str) -> str:
    """c or v for each letter; y after a consonant is a vowel."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(w: str) -> int:
    return _consonants(w).count("vc")


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonants(w)[-3:] == "cvc" and w[-1] not in "wxy"


@functools.lru_cache(maxsize=100_000)
def porter(w: str) -> str:
    """The stem of a word of three or more letters a to z; anything else as it is."""
    if len(w) < 3 or not (w.isascii() and w.isalpha() and w.islower()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _consonants(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _doubled(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
            if w.endswith(end):
                break
    if w.endswith("y") and "v" in _consonants(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _doubled(w) and w.endswith("l"):
        w = w[:-1]
    return w

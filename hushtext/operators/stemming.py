"""The Porter stemmer (An algorithm for suffix stripping, 1980), as published and in the variant that scorers use."""

from __future__ import annotations

import re


def _shape(stem: str) -> str:
    """v for vowels and c for consonants; y behind a consonant is a vowel."""
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short(stem: str, variant: bool) -> bool:
    shape = _shape(stem)
    return shape[-3:] == "cvc" and stem[-1] not in "wxy" or variant and shape == "vc"


#: Suffixes and what they become, in the order in which the algorithm tries them.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


#: Fixed values of the variant: words that it knows whole, and rules that it adds or has instead.
WHOLE = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
VARIANT_2 = {k: v for k, v in STEP_2.items() if k != "abli"} | {"bli": "ble", "fulli": "ful", "logi": "log"}


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str, variant: bool) -> str:
    if variant and len(word) == 4 and word.endswith("ies"):
        return word[:-1]
    for s, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(s):
            return word[: len(word) - len(s)] + to
    return word


def _past(word: str, variant: bool) -> str:
    if variant and word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    s = _longest(word, ("ed", "ing"))
    if not s or not _has_vowel(word[: -len(s)]):
        return word
    word = word[: -len(s)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _shape(word)[-2:] == "cc" and word[-1] == word[-2]:
        return word if word[-1] in "lsz" else word[:-1]
    return word + "e" if _measure(word) == 1 and _short(word, variant) else word


def _derived(word: str, variant: bool) -> str:
    if variant and word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-2], variant)
    table = VARIANT_2 if variant else STEP_2
    s = _longest(word, table)
    # of -logi the l counts as part of the stem
    return word[: -len(s)] + table[s] if s and _measure(word[: -len(s) + (s == "logi")]) > 0 else word


def stem(word: str, variant: bool = True) -> str:
    """The stem of a lower-case word. variant: as the usual scorer's stemmer does it, else as published."""
    if variant and word in WHOLE:
        return WHOLE[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word, variant), variant)
    if word.endswith("y") and (len(word) > 2 and _shape(word[:-1])[-1] == "c" if variant else _has_vowel(word[:-1])):
        word = word[:-1] + "i"
    word = _derived(word, variant)
    if (s := _longest(word, STEP_3)) and _measure(word[: -len(s)]) > 0:
        word = word[: -len(s)] + STEP_3[s]
    if (s := _longest(word, STEP_4)) and _measure(word[: -len(s)]) > 1 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1], variant)):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word

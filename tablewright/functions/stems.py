"""Porter stems, with the common extensions (irregular words, short words, ``-ies``/``-ied``, ``-fulli``, ``-logi``)."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import format_tokens

#: Words with stems of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes and what takes their place, where the rest has a measure over 0.
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
SINGLE_SUFFIXES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes dropped where the rest has a measure over 1.
LAST_SUFFIXES = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """A letter ``c`` or ``v`` for each letter; ``y`` is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x and y; or is just a vowel and a consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    end = _longest(word, ("ed", "ing"))
    if end is None or "v" not in _shape(word[: -len(end)]):
        return word
    rest = word[: -len(end)]
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _doubled(rest):
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if _measure(rest) == 1 and _short(rest) else rest


def _swap(word: str, table: dict[str, str]) -> str:
    end = _longest(word, table)
    if end is None:
        return word
    rest = word[: -len(end)]
    # the measure before -logi counts its l
    return rest + table[end] if _measure(rest + ("l" if end == "logi" else "")) else word


def _last(word: str) -> str:
    end = _longest(word, LAST_SUFFIXES)
    rest = word[: -len(end)] if end else ""
    return rest if _measure(rest) > 1 and (end != "ion" or rest[-1] in "st") else word


def _tidy(word: str) -> str:
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@functools.lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    if word.endswith("alli") and _measure(word[:-4]):
        word = word[:-2]
    return _tidy(_last(_swap(_swap(word, DOUBLE_SUFFIXES), SINGLE_SUFFIXES)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else list(dict.fromkeys(stem(t) for t in ts if t is not None)))


def stem_set(x: str | Column) -> Column:
    """Distinct stems of a text's formatted tokens, in order of appearance; null for null."""
    return _stems(format_tokens(x))

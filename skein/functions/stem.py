"""English suffix stripping after Porter (1980), written from the paper.

Spark has no stemming expression, so this is the one Python function in the
index path. It runs over Arrow batches and remembers words it has seen, so its
cost follows the vocabulary of a task rather than its token count.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix tables of the paper's steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)

#: letters at the end of a stem that its word may not have in that place ("able" of "ability")
STEM_TAIL = 2


def _shape(stem: str) -> str:
    """Vowel/consonant string of a stem; y is a vowel after a consonant."""
    out: list[str] = []
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _ends_cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _ends_double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    hits = [s for s in suffixes if word.endswith(s)]
    return max(hits, key=len) if hits else None


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    ending = _longest(w, ("ed", "ing"))
    if ending is None or not _has_vowel(w[: -len(ending)]):
        return w
    w = w[: -len(ending)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _ends_double(w) and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if _measure(w) == 1 and _ends_cvc(w) else w


def _mapped(w: str, table: dict[str, str]) -> str:
    s = _longest(w, table)
    if s and _measure(w[: -len(s)]) > 0:
        return w[: -len(s)] + table[s]
    return w


def _long_suffix(w: str) -> str:
    s = _longest(w, STEP4)
    if s is None:
        return w
    stem = w[: -len(s)]
    if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
        return stem
    return w


def _final_e(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=1 << 18)
def porter(word: str) -> str:
    """Stem of a lower-case token; short and non-Latin tokens pass through."""
    if len(word) < 3 or not word.isascii():
        return word
    w = _past(_plural(word))
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _mapped(_mapped(w, STEP2), STEP3)
    return _final_e(_long_suffix(w))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_arrays(batch: pd.Series) -> pd.Series:
    return batch.map(lambda words: [porter(w) for w in words])


@F.pandas_udf(T.StringType())
def _stem_words(batch: pd.Series) -> pd.Series:
    return batch.map(porter)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _stem_groups(batch: pd.Series) -> pd.Series:
    return batch.map(lambda groups: None if groups is None else [[porter(w) for w in words] for words in groups])


def stem_groups(groups: Column) -> Column:
    """Stems of an array of token arrays."""
    return _stem_groups(groups)


def stem_array(tokens: Column) -> Column:
    return _stem_arrays(tokens)


def stem_word(token: Column) -> Column:
    return _stem_words(token)

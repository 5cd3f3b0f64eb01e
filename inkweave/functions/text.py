"""Tokenising column functions and the published Porter stemmer as an Arrow-batched function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space of Unicode, with the four separators of ASCII.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def terms(text: Column | str) -> Column:
    """Words between white space, empties dropped."""
    return F.filter(F.split(text, WHITE), lambda x: x != "")


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def word_runs(text: Column | str) -> Column:
    """Runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{M}_]+"), 0)


def stop_words() -> list[str]:
    """The English stop words that come with Spark."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def admitted(token: Column, stop: list[str]) -> Column:
    """Neither a stop word nor a whole number below 10 000, and without a character from U+007F to U+3FFF or a mark of punctuation."""
    return ~token.isin(*stop) & ~token.rlike(r"^(0|[1-9][0-9]{0,3})$") & token.rlike(r"^[0-9A-Za-z\x{4000}-\x{10ffff}]+$")


def is_subword(token: Column) -> Column:
    """Whether a token goes on a word begun before it, as marked by a double sharp."""
    return token.startswith("##")


def plain_quotes(text: Column | str) -> Column:
    return F.translate(text, "’", "'")


def pad_ids(ids: Column, length: int, end: int | None = None) -> Column:
    """ids cut or filled with 0 to a length; with end, a cut sequence ends in it."""
    cut = F.slice(ids, 1, length)
    if end is not None:
        cut = F.when(F.size(ids) > length, F.concat(F.slice(ids, 1, length - 1), F.array(F.lit(end).cast("int")))).otherwise(cut)
    return F.concat(cut, F.array_repeat(F.lit(0), F.greatest(F.lit(0), length - F.size(ids))))


def mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x != 0).cast("int"))


def _measure(stem: str) -> int:
    n, last = 0, False
    for i in range(len(stem)):
        v = _vowel(stem, i)
        n += last and not v
        last = v
    return n


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or w[i] == "y" and i > 0 and not _vowel(w, i - 1)


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


# The suffix tables of Porter's steps 2, 3 and 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(w: str) -> str:
    """Porter (1980)."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                base = w[: -len(suffix)]
                if _has_vowel(base):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif len(base) > 1 and base[-1] == base[-2] and not _vowel(base, len(base) - 1) and base[-1] not in "lsz":
                        base = base[:-1]
                    elif _measure(base) == 1 and _cvc(base):
                        base += "e"
                    w = base
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + table[suffix]
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """Stems of a column of words; apply it to distinct words."""
    return words.map(stem, na_action="ignore")

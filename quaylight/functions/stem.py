"""Porter's stemmer (1980), written from its published rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix rules of steps 2 to 4.
STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted((tuple((r + " ").split(" ")[:2]) for r in text.split(",")), key=lambda r: -len(r[0]))


_step2, _step3, _step4 = _rules(STEP2), _rules(STEP3), sorted(STEP4, key=len, reverse=True)


def _kinds(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _kinds(word)))


def _cvc(word: str) -> bool:
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def stem(w: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _kinds(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _kinds(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_step2, _step3):
        for suffix, new in rules:
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in sorted([*_step4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems(tokens: Column) -> Column:
    """STR9: stems of an array of tokens, in batches."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def each(batch: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return batch.map(lambda ws: None if ws is None else [known.get(w) or known.setdefault(w, stem(w)) for w in ws])

    return each(tokens)

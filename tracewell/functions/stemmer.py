"""The English (Porter2) stemmer, applied to vocabularies and never to running text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = sorted({
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}.items(), key=lambda x: -len(x[0]))
STEP_3 = sorted({"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}.items(), key=lambda x: -len(x[0]))
STEP_4 = sorted(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"), key=len, reverse=True)
REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if head:
        r1 = len(head)
    else:
        m = REGION.search(w)
        r1 = m.end() if m else len(w)
    m = REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def _has_vowel(w: str) -> bool:
    return any(c in VOWELS for c in w)


def porter2(word: str) -> str:
    """The stem of a lower-case ASCII word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.lstrip("'")
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = re.sub(r"(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    for tail in ("'s'", "'s", "'"):
        if w.endswith(tail):
            w = w[: -len(tail)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    for tail in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(tail):
            if tail in ("eed", "eedly"):
                if len(w) - len(tail) >= r1:
                    w = w[: -len(tail)] + "ee"
            elif _has_vowel(w[: -len(tail)]):
                w = w[: -len(tail)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLES):
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    for tail, to in STEP_2:
        if w.endswith(tail):
            if len(w) - len(tail) >= r1:
                w = w[: -len(tail)] + to
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    # 3
    for tail, to in STEP_3:
        if w.endswith(tail):
            if len(w) - len(tail) >= r1:
                w = w[: -len(tail)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    # 4
    for tail in STEP_4:
        if w.endswith(tail):
            if len(w) - len(tail) >= r2:
                w = w[: -len(tail)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


def stem(word: str) -> str:
    """The stem of a term: only a-z words of four letters or more have one."""
    return porter2(word) if len(word) >= 4 and word.isascii() and word.isalpha() and word.islower() else word


@F.pandas_udf(StringType())
def _stems(terms: pd.Series) -> pd.Series:
    return terms.map(stem)


def stem_vocabulary(terms: DataFrame, col: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms that have a stem other than themselves."""
    wanted = terms.select(F.col(col).alias("term")).where(F.col(col).rlike("^[a-z]{4,}$")).distinct()
    return wanted.select("term", _stems("term").alias("stem")).where("stem <> term")


def add_stems(counts: DataFrame, tf: str = "tf") -> DataFrame:
    """Add to counts(term, ..., tf) those of the stems: a term counts for its stem as well, so an exact match counts twice."""
    keys = [c for c in counts.columns if c not in ("term", tf)]
    extra = counts.join(stem_vocabulary(counts), "term").select(F.col("stem").alias("term"), *keys, tf)
    return counts.select("term", *keys, tf).unionByName(extra).groupBy("term", *keys).agg(F.sum(tf).alias(tf))

"""Text analysis: tokenisers, bit widths, times and the Porter2 (English) stemmer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexigrid.sources.store import ship

WORD = "([A-Za-z0-9_]+)"


def word_terms(text: Column) -> Column:
    """ASCII word tokens, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), F.lower)


def query_terms(line: Column) -> Column:
    """Terms of a query line, split at tabs and blanks."""
    return F.filter(F.split(line, "[\t ]+"), lambda x: x != "")


def nbits(n: Column) -> Column:
    """floor(log2 n), 0 for 0."""
    return (F.length(F.bin(n)) - 1).cast("int")


def nbytes(n: Column) -> Column:
    return F.ceil((nbits(n) + 1) / 8).cast("int")


def clock(milliseconds: Column) -> Column:
    """hh:mm:ss.mmm"""
    ms = milliseconds.cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


# Porter2, written from the algorithm's published description.
_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
            break
    else:
        m = _REGION.search(w)
        r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def stem(word: str | None) -> str | None:
    """The Porter2 stem. Case isn't folded: upper-case letters are consonants to it."""
    if word is None or len(word) < 3:
        return word
    w = word[1:] if word[0] == "'" else word
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    w = ("Y" + w[1:]) if w.startswith("y") else w
    w = re.sub(r"([aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eedly", "eed"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(c in _V for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for s, t in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    if w[-4:-3] == "l":
                        w = w[:-1]
                elif s == "li":
                    if w[-3:-2] and w[-3] in "cdeghkmnrt":
                        w = w[:-2]
                else:
                    w = w[: -len(s)] + t
            break
    # 3
    for s, t in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + t
            break
    # 4
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stems(s: pd.Series) -> pd.Series:
    return s.map(stem)


def stem_column(term: str | Column) -> Column:
    """Arrow batches through the stemmer; null stays null."""
    ship(SparkSession.active())
    return F.pandas_udf(_stems, StringType())(term)


def stem_terms(terms: DataFrame) -> DataFrame:
    """term, stem of the distinct terms of terms(term): each is stemmed once."""
    return terms.select("term").distinct().withColumn("stem", stem_column("term"))

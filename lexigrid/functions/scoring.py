"""Scoring as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, MIN_IDF, MU = 1.2, 0.5, 1e-6, 2500.0


def d(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def bm25(tf="tf", size="len", df="df", n="n", avgdl="avgdl", k1: float = K1, b: float = B) -> Column:
    idf = F.greatest(F.lit(MIN_IDF), F.ln((d(n) - d(df) + 0.5) / (d(df) + 0.5)))
    return d(tf) * idf * (k1 + 1) / (d(tf) + k1 * (1 - b) + b * k1 / d(avgdl) * d(size))


def query_likelihood(tf="tf", size="len", cf="cf", c="c", maxlen="maxlen", mu: float = MU) -> Column:
    """Dirichlet-smoothed, shifted so that no score is negative."""
    g = F.lit(mu) * d(cf) / d(c)
    return F.ln(d(tf) + g) - F.ln(d(size) + mu) - (F.ln(1 + g) - F.ln(d(maxlen) + mu))


def tfidf(tf="tf", df="df", n="n") -> Column:
    return d(tf) * F.ln(d(n) / (1 + d(df)))


def count(tf="tf") -> Column:
    return d(tf)


SCORERS = {"bm25": bm25, "ql": query_likelihood, "tfidf": tfidf, "count": count}


def scorer(name: str) -> Column:
    """By name, over columns tf, len, df, cf, n, c, avgdl, maxlen; a leading * (computed on the fly) may stand before it."""
    try:
        return SCORERS[name.lstrip("*")]()
    except KeyError:
        raise ValueError(f"unknown scorer {name!r}; known: {sorted(SCORERS)}") from None


def quantize(x: Column, low: Column, high: Column, lo: int, hi: int) -> Column:
    """trunc((hi - lo) / (high - low) * (x - low)) + lo, without clamping; lo where the range is empty."""
    ratio = F.try_divide(F.lit(float(hi - lo)), high - low)
    return F.coalesce((ratio * (x - low)).cast("long"), F.lit(0)) + lo

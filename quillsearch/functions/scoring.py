"""Ranking formulas as Column expressions. Logarithms are natural; all results are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scoring modes a retrieval can use.
MODES = ("tfidf", "bm25")


def _d(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def tfidf_idf(n_docs: Column, df: Column) -> Column:
    """ln(N / df), 0 without documents."""
    return F.when((n_docs > 0) & (df > 0), F.ln(_d(n_docs) / _d(df))).otherwise(F.lit(0.0))


def tfidf_term(idf: Column, tf: Column) -> Column:
    """idf (1 + ln tf), 0 for tf 0; no length normalisation."""
    return F.when(tf > 0, idf * (F.lit(1.0) + F.ln(_d(tf)))).otherwise(F.lit(0.0))


def bm25_idf(n_docs: Column, df: Column) -> Column:
    """ln(1 + (N - df + 1/2) / (df + 1/2)), which is above 0."""
    return F.when(
        (n_docs > 0) & (df > 0), F.ln(F.lit(1.0) + (_d(n_docs) - _d(df) + F.lit(0.5)) / (_d(df) + F.lit(0.5)))
    ).otherwise(F.lit(0.0))


def bm25_term(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """Saturated term frequency with length normalisation; an average length of 0 counts as 1."""
    avg = F.when(avgdl > 0, _d(avgdl)).otherwise(F.lit(1.0))
    length = F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * _d(dl) / avg)
    return F.when(tf > 0, idf * _d(tf) * F.lit(k1 + 1.0) / (_d(tf) + length)).otherwise(F.lit(0.0))


def idf(mode: str, n_docs: Column, df: Column) -> Column:
    return tfidf_idf(n_docs, df) if mode == "tfidf" else bm25_idf(n_docs, df)


def term(mode: str, weight: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tfidf_term(weight, tf) if mode == "tfidf" else bm25_term(weight, tf, dl, avgdl, k1, b)


def checked(mode: str) -> str:
    """The mode in lower case; ValueError for any other."""
    if mode.lower() not in MODES:
        raise ValueError(f"scoring is one of {MODES}, not {mode!r}")
    return mode.lower()

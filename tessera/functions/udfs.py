"""The few functions that Spark has no built-in for, as Arrow-batched UDFs, and plug-in models with offline fallbacks."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ship(module_name: str) -> None:
    """Pickle a module's functions by value: executors then need no copy of this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def lcs_ratio(a: str, b: str) -> float:
    """200 * LCS / (|a| + |b|), with the longest common subsequence by bit-parallel addition."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return 200.0 * (len(a) - bin(v).count("1")) / (len(a) + len(b))


def weighted_ratio(a: str, b: str) -> float:
    """Lenient score for look-ups: the best of plain, sorted-token (x 0.95), token-set (x 0.95) and, where lengths differ, partial (x 0.9) ratios."""
    if not a or not b:
        return 0.0
    ta, tb = sorted(set(a.split())), sorted(set(b.split()))
    best = max(lcs_ratio(a, b), 0.95 * lcs_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
    both = [t for t in ta if t in tb]
    if both:
        joined = " ".join(both)
        whole = [" ".join(both + [t for t in x if t not in both]) for x in (ta, tb)]
        best = max(best, 0.95 * max(lcs_ratio(joined, whole[0]), lcs_ratio(joined, whole[1]), lcs_ratio(*whole)))
    short, long = sorted((a, b), key=len)
    if len(long) >= 1.5 * len(short):
        scale = 0.6 if len(long) > 8 * len(short) else 0.9
        best = max(best, scale * max(lcs_ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)))
    return best


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def lookup_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


_ABBREVIATION = re.compile(r"(?:\b(?:et al|e\.g|i\.e|cf|vs|fig|figs|eq|eqs|sec|tab|dr|mr|mrs|prof|no|vol|pp|approx|resp|ref|refs|dept|univ)|\b(?-i:[A-Z]))\.$", re.IGNORECASE)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of sentences; abbreviations, initials and decimals don't end one."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*\s+|\n{2,}", text):
        head = text[start : m.start() + 1]
        if m.group(0)[0] == "." and _ABBREVIATION.search(head.split("\n")[-1]):
            continue
        if text[m.end() : m.end() + 1].islower() and m.group(0)[0] == ".":
            continue
        end = m.start() + len(m.group(0).rstrip())
        if text[start:end].strip():
            out.append((start, end))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text.rstrip())))
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("text", T.StringType())))
def sentences(text: pd.Series) -> pd.Series:
    """CHK7."""
    return text.map(lambda t: [{"start": a, "end": b, "text": t[a:b].strip()} for a, b in sentence_spans(t)] if t else [])


def snapped(text: str, at: int, reach: int = 40) -> int:
    """CHK3: the nearest sentence end within reach, else the place after the nearest blank, else `at`; ties to the lower."""
    if at >= len(text):
        return len(text)
    lo, hi = max(0, at - reach), min(len(text), at + reach)
    ends = [i + 1 for i in range(lo, hi - 1) if text[i] in ".!?" and text[i + 1].isspace()]
    if ends:
        return min(ends, key=lambda i: (abs(i - at), i))
    blanks = [i + 1 for i in range(lo, hi) if text[i].isspace()]
    return min(blanks, key=lambda i: (abs(i - 1 - at), i)) if blanks else at


def hash_embedding(text: str, size: int = 64) -> list[float]:
    """Offline embedder: signed feature hashing of words and word pairs, unit norm, the same everywhere."""
    v = np.zeros(size)
    tokens = re.findall(r"\w+", (text or "").lower())
    for t in tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]:
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
        v[h % size] += 1.0 if h >> 63 else -1.0
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).astype("float32").tolist()


def embedder(model: Callable[[list[str]], list[list[float]]] | None = None) -> Callable[[Column], Column]:
    """RET1: a batch embedding UDF; the hashing embedder unless a model is plugged in."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        texts = text.fillna("").tolist()
        return pd.Series(model(texts) if model else [hash_embedding(t) for t in texts])

    return embed


def scorer(model: Callable[[list[tuple[str, str]]], list[float]] | None = None) -> Callable[[Column, Column], Column]:
    """RET6: a re-ranking UDF; word overlap (share of the question's words in the passage) unless a model is plugged in."""

    @F.pandas_udf(T.DoubleType())
    def score(question: pd.Series, passage: pd.Series) -> pd.Series:
        pairs = list(zip(question.fillna(""), passage.fillna("")))
        if model:
            return pd.Series(model(pairs), dtype="float64")
        out = []
        for q, p in pairs:
            qs, ps = set(re.findall(r"\w+", q.lower())), set(re.findall(r"\w+", p.lower()))
            out.append(len(qs & ps) / len(qs) if qs else 0.0)
        return pd.Series(out, dtype="float64")

    return score

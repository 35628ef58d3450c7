"""Hashed bag-of-words embedding, vectorised over a whole Arrow batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from .text import BLANK, BLANK_SET, nfkd

DIMENSIONS = 768
SHARED, CONTENT = 0.7, 0.3  # squared weights of the constant direction and of the words


def words_of(text: Column) -> Column:
    """Words longer than two characters; combining marks split words here."""
    t = F.regexp_replace(nfkd(F.lower(text)), rf"[^\p{{L}}\p{{N}}{BLANK_SET}]", " ")
    return F.filter(F.split(t, rf"{BLANK}+"), lambda w: F.length(w) > 2)


def fnv1a(grams: list[str]) -> np.ndarray:
    """32-bit FNV-1a over UTF-16 units of every gram at once."""
    units = [np.frombuffer(g.encode("utf-16-le"), dtype=np.uint16) for g in grams]
    sizes = np.fromiter((len(u) for u in units), dtype=np.int64, count=len(units))
    h = np.full(len(units), 2166136261, dtype=np.uint64)
    order = np.argsort(-sizes, kind="stable")
    flat, starts = np.concatenate(units) if units else np.empty(0, np.uint16), np.cumsum(sizes) - sizes
    alive = order
    for i in range(int(sizes.max()) if len(sizes) else 0):
        alive = alive[sizes[alive] > i]
        h[alive] = ((h[alive] ^ flat[starts[alive] + i].astype(np.uint64)) * 16777619) & 0xFFFFFFFF
    return h


RUN_CHARS = 1 << 20  # characters of texts whose words are held at a time


def embed_texts(texts: pd.Series) -> list[np.ndarray]:
    """Vectors of texts of words with single blanks; only the words of a run of texts are held at a time."""
    out, run, size = [], [], 0
    for text in texts:
        run.append([] if text is None else text.split(" ") if text else [])
        size += len(text or "")
        if size >= RUN_CHARS:
            out += embed_words(run)
            run, size = [], 0
    return out + embed_words(run)


def embed_words(words: list[list[str]]) -> list[np.ndarray]:
    index: dict[str, int] = {}
    docs = []
    for w in words:
        grams = w + [f"{a}_{b}" for a, b in zip(w, w[1:])]
        docs.append(np.fromiter((index.setdefault(g, len(index)) for g in grams), dtype=np.int64, count=len(grams)))
    h = fnv1a(list(index))
    bucket = (h % (DIMENSIONS - 1) + 1).astype(np.int64)
    sign = np.where(h & 1, 1.0, -1.0)
    out = []
    for ids in docs:
        v = np.bincount(bucket[ids], weights=sign[ids], minlength=DIMENSIONS) if len(ids) else np.zeros(DIMENSIONS)
        v = v / (np.linalg.norm(v) or 1.0) * np.sqrt(CONTENT)
        v[0] = np.sqrt(SHARED)
        out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32))
    return out


@pandas_udf(ArrayType(FloatType()))
def _embed(texts: pd.Series) -> pd.Series:
    return pd.Series(embed_texts(texts))


def embed(text: Column) -> Column:
    """Unit vector of 768 dimensions of a text."""
    return _embed(F.array_join(words_of(text), " "))

"""Language of a text by character trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import BLANK

TOP = 300  # trigrams kept per language unless told otherwise: a profile table is that small by construction
MIN_CHARS = 40


def padded(text: Column) -> Column:
    """The lower-cased letters, words parted by single blanks, a blank at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def _codes(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(trigram as 63 bits, row) of all trigrams; a text of two characters is one trigram."""
    rows = [t if len(t) > 2 else t.ljust(3, "\0") for t in texts]
    chars = np.frombuffer("".join(rows).encode("utf-32-le"), "<u4").astype(np.uint64)
    if not len(chars):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(t) for t in rows])
    codes = (chars[:-2] << np.uint64(42)) | (chars[1:-1] << np.uint64(21)) | chars[2:]
    whole = owner[:-2] == owner[2:]
    return codes[whole], owner[:-2][whole]


def _gram(code: int) -> str:
    return "".join(chr(code >> k & 0x1FFFFF) for k in (42, 21, 0)).rstrip("\0")


def _code(gram: str) -> int:
    a, b, c = (ord(x) for x in gram.ljust(3, "\0"))
    return a << 42 | b << 21 | c


def _parts(texts: pd.Series, size: int = 1 << 20) -> Iterator[slice]:
    """Slices of about ``size`` characters, so that long texts do not fill a task."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield slice(first, i + 1)
            first, held = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def language_profiles(texts: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, gram, weight): the ``top`` most frequent trigrams per language of labelled texts.

    Trigrams are counted inside each batch before anything is shuffled.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, group in b.groupby("lang", dropna=False):
                for part in _parts(group["text"]):
                    code, n = np.unique(_codes(group["text"].iloc[part])[0], return_counts=True)
                    yield pd.DataFrame({"lang": None if pd.isna(name) else name, "gram": [_gram(int(c)) for c in code], "n": n})

    rows = texts.filter(F.col(text).isNotNull()).select(F.col(lang).alias("lang"), padded(F.col(text)).alias("text"))
    counts = rows.mapInPandas(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.select(F.col("lang").alias(lang), "gram", (F.lit(top + 1) - F.col("rank")).alias("weight"))


def language_column(profiles: DataFrame, text: Column) -> Column:
    """The language whose profile fits a text best; null when short or undecided.

    The profiles have a fixed number of rows per language, so they go to the tasks, and every text
    is scored where it is read.
    """
    known = profiles.select("lang", "gram", "weight").filter("lang is not null").collect()
    names = sorted({r["lang"] for r in known})
    grams = np.array(sorted({_code(r["gram"]) for r in known}), np.uint64)
    place = {int(g): i for i, g in enumerate(grams)}
    weights = np.zeros((len(names), max(len(grams), 1)))
    for r in known:
        weights[names.index(r["lang"]), place[_code(r["gram"])]] = r["weight"]

    @F.pandas_udf("string")
    def best(texts: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(texts)
        if not len(grams):
            return pd.Series(out, dtype=object)
        for part in _parts(texts):
            rows = texts.iloc[part]
            codes, owner = _codes(rows)
            at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
            hit = grams[at] == codes
            scores = np.array([np.bincount(owner[hit], w[at[hit]], len(rows)) for w in weights])
            order = np.sort(scores, axis=0)
            second = order[-2] if len(names) > 1 else np.zeros(len(rows))
            for i in np.flatnonzero(order[-1] > second):
                out[part.start + i] = names[int(scores[:, i].argmax())]
        return pd.Series(out, dtype=object)

    long = F.length(F.trim(F.regexp_replace(text, rf"{BLANK}+", " "))) >= MIN_CHARS
    body = F.when(long, padded(text)).otherwise(F.lit(""))
    return F.when(long, best(body))


def detect_language(docs: DataFrame, profiles: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, detected): the language of every text, see ``language_column``."""
    return docs.select(doc_id, language_column(profiles, F.col(text)).alias("detected"))

"""Token counts through a digest cache.

The cache is a table (digest, tokenizer, n_tokens). A text is normalised so far as no count can
change, digested, and looked up under the digest of the tokenizer file; only distinct misses are
encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CACHE = "digest string, tokenizer string, n_tokens long"
MEMO_WORDS = 150_000  # pieces between white space in a generation of the memo


def normalised(text: Column) -> Column:
    """Text with each run of ASCII white space as one space.

    Tokenizers of this package drop or collapse white space before anything else, so the count is the
    same. Case is left alone: strings of special tokens are matched before case folding.
    """
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def file_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordCounter:
    """Counts the tokens of a text as the sum over its pieces between ASCII white space.

    Exact for tokenizers whose pre-tokenizer splits at white space and drops it: no token, special
    strings included, reaches over it. Counts of pieces are remembered in two generations of up to
    ``MEMO_WORDS``: pieces that are met again move to the young one, the old one is dropped when the
    young one is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def counts(self, texts: list[bytes]) -> list[int]:
        """Pieces new to the memo are encoded in one batch."""
        split = [t.split() for t in texts]
        if len(self.young) > MEMO_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for p in {p for ps in split for p in ps if p not in young}:
            if p in old:
                young[p] = old[p]
            else:
                new.append(p)
        coded = self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in new], add_special_tokens=False)
        young.update(zip(new, map(len, coded)))
        return [sum(map(young.__getitem__, ps)) for ps in split]


_counters: dict[str, WordCounter] = {}  # of a Python worker, kept from task to task


def counter_of(path: str) -> WordCounter:
    if path not in _counters:
        _counters[path] = WordCounter(path)
    return _counters[path]


def encode_counts(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        counter = counter_of(tokenizer_path)
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            out, part, size = [], [], 0
            for value in column:
                t = value.as_py()
                part.append(t)
                size += len(t)
                if size > 1 << 19:
                    out += counter.counts(part)
                    part, size = [], 0
            out += counter.counts(part)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(count, "digest string, n_tokens long")


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts; a cache that does not exist yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE).parquet(cache_path)
    return spark.createDataFrame([], CACHE)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document; appends the counts of new texts to the cache.

    Null texts count as empty and have no tokens; texts of any length are counted whole; repeated
    rows stay as many and are encoded once; an empty table leaves the cache as it is. The cache is
    kept per tokenizer file, so another version never meets these counts. Other columns are not read.
    If a run is lost before its append is committed, the next run encodes its misses again. Counts
    that two runs append at once are the same, and one of them is taken.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer_path)
    norm = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        F.sha2(norm, 256).alias("digest"),
    )
    known = read_cache(spark, cache_path).filter(F.col("tokenizer") == version)
    # one row for each distinct text, combined before the shuffle
    distinct = docs.select(norm.alias("text")).groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"))
    misses = distinct.join(known.select("digest"), "digest", "left_anti")
    encode_counts(misses, tokenizer_path).select(
        "digest", F.lit(version).alias("tokenizer"), "n_tokens"
    ).write.mode("append").parquet(cache_path)
    stored = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(stored, "digest", "left").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

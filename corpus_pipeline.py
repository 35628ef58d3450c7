"""From raw documents to a training mix, in five stages that each write their result.

The intermediate tables go to the shared folder, so a stage that is lost is repeated from the last one
that was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from laborlens.llm import dartminhash, lines, mixing, tiling, toxicity
from laborlens.llm.common import cut, table


def wrapped(docs: DataFrame) -> DataFrame:
    """(doc_id, text, others): further columns travel in one struct, so no name meets one that a stage adds."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_none")).alias("others"))


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; it is fitted on the labels of those at hand.

    Null and empty texts hold no match and stay; repeated rows are judged alike; an empty table, or one
    without labels, gives back what it was given. All columns are kept, whatever their names.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(wrapped(docs), model, keep=("text", "others"))
    return unwrapped(scored.filter("predicted = 0"), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go; every document stays, with the length of what is left.

    Earlier is by document id, then line. Null texts and rows without an id stay as they are; of rows
    with one id the same lines go; a document of which nothing is left has an empty text. ``n_chars`` is
    renewed where it is a column, all others are kept.
    """
    kept = unwrapped(lines.without_lines(wrapped(docs)), docs.columns)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; one without an id stays.

    Texts without words, null or empty, are alone. Equal rows of the id that stays are one; different texts
    under it all stay. Ties cannot occur, as the smallest id is one. All columns are kept.
    """
    groups = dartminhash.near_duplicates(docs)
    firsts = groups.filter("doc_id = class_id").select("doc_id").distinct()
    named = docs.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return named.unionByName(docs.filter("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item, in whatever order, go.

    Null and empty texts match nothing and stay; repeated rows are judged alike; an empty benchmark
    leaves every document. All columns are kept.
    """
    judged = tiling.contamination(wrapped(docs), table(spark, sf_dir, "benchmark"), keep=("doc_id", "text", "others"))
    return unwrapped(judged.filter("not contaminated"), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that are taken, with the words taken and how often the document is read.

    Documents without words, null texts included, are never taken; a null source is a source of its own;
    repeated rows count as often as they stand there; an empty table gives an empty mix.
    """
    mix = mixing.mix_sources(docs).filter("taken > 0")
    return mix.select(
        "doc_id", "source", "size", "source_size", "target", "taken", (F.col("taken") / F.col("size")).cast("int").alias("copies")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_benchmark),
    ("mixing", mixed),
]

#: Fitted scores and hashed signatures have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each but the last is written and read again.

    Rows with nulls, empty or very long texts, repeated rows and empty tables pass through as each stage
    says. A lost stage is repeated from the last table that was written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again for the
next one. All but the last return the columns of documents; doc_id tells documents apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewise.llm import decontaminate, language_id, mixing, ngram_join, pii
from basewise.llm.common import cut, scratch, spare, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null texts, and texts without a letter); a missing lang is set to the predicted one.

    The model is learned from the documents' own lang, without the held-out quarter."""
    names, model = language_id.train(docs.where(~language_id.held_out(F.coalesce("doc_id", F.lit(0)))))
    found = language_id.identify(docs, names, model, pred="__pred", score="__score", mixture="__mixture")
    told = found.where("__pred != 'und'") if names else docs.where(F.udf(language_id.has_letter, "boolean")(F.coalesce("text", F.lit("")))).withColumn("__pred", F.lit(None).cast("string"))
    return told.withColumn("lang", F.coalesce("lang", "__pred")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies, the document with the smallest doc_id; repeated rows become one."""
    got = ngram_join.jaccard_join(docs)
    dropped = got.where("component_id != doc_id").select("doc_id").distinct()
    left = docs.join(F.broadcast(dropped) if dropped.count() <= ngram_join.BROADCAST else dropped, "doc_id", "left_anti")
    repeated = got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not repeated.limit(1).count():
        return left
    return left.join(repeated, "doc_id", "left_anti").unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold windows of two or more benchmark items, and cuts such windows out of the others."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), length="n_chars")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in square brackets."""
    return pii.redact(docs, length="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as they are now, with how many of their words the mix takes (repeats counted).

    mixing.mix_blocks gives the same mix as shards of blocks of words."""
    columns = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    h, r = spare(docs, "__h", "__r")
    got = mixing.mix_sources(docs, with_hash=h).select(h, "size", "source_size", "target", "taken").withColumn(r, F.row_number().over(Window.partitionBy(h).orderBy("taken")))
    rows = docs.select(*columns, mixing.row_hash("doc_id", "text").alias(h)).withColumn(r, F.row_number().over(Window.partitionBy(h).orderBy(h)))
    return rows.join(got, [h, r]).drop(h, r)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_join", near_copies),
    ("decontaminate", benchmarks),
    ("pii", private),
    ("mixing", mixed),
]

#: Stages 1, 4 and 5 (a trained model, scored patterns, seeded draws) can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        docs = table(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir))
        return keep(STAGES[-1][1](spark, docs, sf_dir))

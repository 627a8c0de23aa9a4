"""Corpus pipeline: language ID, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet in the shared checkpoint folder and read again as the next one's
``docs``.  All but the last return the columns of ``documents``; extra columns
go along until packing.  Every stage accepts null and empty texts, nulls in any
column, repeated rows and an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import language_id
from quarry.llm.mixing import mixed_documents
from quarry.llm.packing import pack
from quarry.llm.simhash import one_of_each
from quarry.llm.suffix_array import without_repeats
from quarry.session import ensure_checkpoint_dir, ship_package, table

#: expected share of a document's words that its language must reach
MIN_LANGUAGE_SHARE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null or letterless texts, and those whose best label is too weak.

    The model learns from ``documents``, never from its held-out third.
    """
    field = language_id.learn(table(spark, sf_dir, "documents"))
    judged = language_id.with_language(docs, field)
    kept = judged.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays: the least by id, null ids last.

    Rows under one id, or under null, are documents of their own.
    """
    ship_package(spark)
    return one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a 100-byte string that also starts earlier goes; documents of which nothing is left go whole."""
    ship_package(spark)
    # rows without an id are told apart by their text; below zero, they come before the others as null does
    own = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(-(1 << 63))
    # the other columns travel as one, so that no name of theirs can clash
    rest = F.struct(F.lit(0), *[docs[c] for c in docs.columns if c not in ("text", "n_chars")])
    named = docs.select(F.coalesce(docs.doc_id.cast("bigint"), own).alias("id"), docs.text.alias("text"), rest.alias("rest"))
    cut = without_repeats(named, id_col="id").where(F.col("text") != "")
    made = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[made.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: one row for each pass over a source that takes words of the document."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed into sequences of 2048 tokens."""
    import public_tokenizers
    ship_package(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", repeat_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: learned weights, fingerprints, byte spans, random blocks and tokenizers are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes through Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs

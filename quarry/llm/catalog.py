"""Queries of the numbered training-data operators and of the pipeline, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import (ann_forest, embedding_dedup, exact_topk, fill_in_middle, hard_negatives, language_id, license_scan,
               suffix_array, suffix_tree, url_filter)
from .mixing import digest, mixture
from .packing import pack
from .simhash import near_duplicates

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


@_query("op1_source_mixing")
def op1(spark, sf_dir):
    return digest(mixture(table(spark, sf_dir, "documents")))


@_query("op2_substring_dedup")
def op2(spark, sf_dir):
    return suffix_tree.remove_repeats(table(spark, sf_dir, "documents"), window=13)


@_query("op3_license_scan", license_scan.oracle_sql())
def op3(spark, sf_dir):
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


@_query("op4_ann_forest")
def op4(spark, sf_dir):
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), k=5, query_step=50)


@_query("op5_simhash_dedup")
def op5(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


@_query("op6_exact_topk")
def op6(spark, sf_dir):
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), k=10, query_step=100)


@_query("op7_suffix_array_dedup")
def op7(spark, sf_dir):
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents"), match=100)


@_query("op8_url_filter")
def op8(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@_query("op9_language_id")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs))


@_query("op10_packing")
def op10(spark, sf_dir):
    import public_tokenizers
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op11_hard_negatives", hard_negatives.oracle_sql())
def op11(spark, sf_dir):
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


@_query("op12_embedding_dedup", embedding_dedup.oracle_sql())
def op12(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query("op13_fill_in_middle", fill_in_middle.oracle_sql())
def op13(spark, sf_dir):
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def queries() -> dict[str, QueryFn]:
    import corpus_pipeline
    return {k: v[0] for k, v in REGISTRY.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline
    out = {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

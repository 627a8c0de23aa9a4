"""Text features and word statistics.

Words are exploded once and pre-aggregated per (word[, colour]) before any
shuffle; the vocabulary (top-N) is a bounded DataFrame broadcast into a
``left_semi`` join, so no word list ever passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ENGLISH_STOP_WORDS, tokens
from ..session import cut_lineage
from .aggregates import full_grid

TASK_TEXT = 32 << 20        # bytes of text that a task counts the words of


def words(df: DataFrame, text: str, keep: Sequence[str] = (), stop_words=ENGLISH_STOP_WORDS,
          word: str = "word") -> DataFrame:
    """One row per word occurrence, beside the ``keep`` columns."""
    return df.select(*keep, F.explode(tokens(text, stop_words)).alias(word))


def top_words(word_counts: DataFrame, n: int, word: str = "word", count: str = "n") -> DataFrame:
    """The ``n`` words of largest total count (ties by word), as a DataFrame."""
    return (word_counts.groupBy(word).agg(F.sum(count).alias("__total"))
                       .orderBy(F.desc("__total"), F.asc(word))
                       .limit(n).select(word))


def text_stats(df: DataFrame, x: str, y: str | None = None, color: str | None = None,
               max_features: int = 25, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Word counts (and tf-weighted mean of ``y``) for the top words.

    The vocabulary is the ``max_features`` most frequent words over all rows.
    With a colour, every (word, colour) pair appears; ``count`` is the total
    number of occurrences in that colour and ``mean`` = sum(tf*y)/sum(tf).
    """
    keep = ([F.col(color).alias("color")] if color else []) + ([F.col(y).cast("double").alias("y")] if y else [])
    # explode_outer keeps rows without any word, so their colour still counts
    src = df.select(F.col(x).alias("__text"), *keep)
    kept = [c for c in ("color", "y") if c in src.columns]
    occ = src.select(*kept, F.explode_outer(tokens("__text", stop_words)).alias("x"))
    by = ["x"] + (["color"] if color else [])
    aggs = [F.count(F.lit(1)).alias("count")] + ([F.sum("y").alias("__sy")] if y else [])
    # (word, colour) totals feed the vocabulary, the counts and the colour list:
    # written once to the shared checkpoint folder so the text is tokenised once
    pre = cut_lineage(occ.groupBy(*by).agg(*aggs))
    vocab = top_words(pre.where(F.col("x").isNotNull()).withColumnRenamed("count", "n"),
                      max_features, word="x")
    stats = pre.join(F.broadcast(vocab), "x", "left_semi")
    if color:
        # every vocabulary word beside every colour of the rows (bounded lists)
        colors = pre.select(F.sort_array(F.collect_set("color")).alias("c"))
        grid = vocab.select("x", F.explode(colors.scalar()).alias("color"))
        stats = grid.join(stats, by, "left").fillna({"count": 0})
    cols = [F.col(c) for c in by] + [F.col("count")]
    if y:
        cols.append((F.col("__sy") / F.col("count")).alias("mean"))
    return stats.select(*cols)


def grouped_average_text(df: DataFrame, feature: str, columns: Sequence[str] | None = None,
                         max_features: int = 100, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Top-100 words of ``feature``; total count and tf-weighted mean of each column."""
    data = df.where(F.col(feature).isNotNull())
    others = [c for c in (columns or data.columns) if c != feature]
    occ = data.select(*[F.col(c).cast("double").alias(c) for c in others],
                      F.explode(tokens(feature, stop_words)).alias("x"))
    pre = occ.groupBy("x").agg(F.count(F.lit(1)).alias("count"), *[F.sum(c).alias(c) for c in others])
    vocab = pre.orderBy(F.desc("count"), F.asc("x")).limit(max_features)
    return vocab.select("x", "count", *[(F.col(c) / F.col("count")).alias(c) for c in others])


def term_counts(df: DataFrame, key: str, text: str, stop_words=ENGLISH_STOP_WORDS,
                colocate: bool = False) -> DataFrame:
    """T5: (key, word, tf) -- the sparse document x word matrix in long form.

    ``colocate`` hash-partitions the rows by ``key`` before tokenising, so the
    counts come out partitioned by document: the per-document steps that follow
    (L2 norms) need no further shuffle.  Keys are unique rows: no hot key.
    """
    src = df.select(key, text)
    if colocate:
        # a task's counts take several times its text: tasks grow in number, not in size
        size = src.agg(F.sum(F.octet_length(text))).first()[0] or 0
        src = src.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_TEXT)), key)
    return (words(src, text, keep=[key], stop_words=stop_words)
            .groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf")))


def min_df_vocabulary(df: DataFrame, key: str, text: str, min_df: float = 0.005,
                      stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """T4: words present in at least ``min_df`` of the rows, alphabetical index.

    Returns (word, df, index).  The index is a rank over the vocabulary, which
    is bounded by 1/min_df x (distinct words per row); computed distributed.
    """
    n_docs = df.select(F.count(F.lit(1))).scalar()
    tc = term_counts(df, key, text, stop_words)
    vocab = (tc.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
               .where(F.col("df") >= F.lit(min_df) * n_docs))
    return vocab.withColumn("index", (F.row_number().over(Window.orderBy("word")) - 1).cast("int"))


def tfidf(df: DataFrame, key: str, text: str, min_df: float = 0.005,
          stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """(key, word, weight) with tf*(ln((1+n)/(1+df))+1), L2-normalised per row.

    ``n`` counts all rows (including rows without any kept word), as the
    reference's vectoriser does.
    """
    n_docs = df.select(F.count(F.lit(1))).scalar()
    # term counts feed both the document frequencies and the weights: tokenise once
    tc = cut_lineage(term_counts(df, key, text, stop_words, colocate=True))
    vocab = (tc.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
               .where(F.col("df") >= F.lit(min_df) * n_docs))
    idf = vocab.select("word", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    # at most 1/min_df x (distinct words per row) words
    raw = tc.join(F.broadcast(idf), "word").select(key, "word", (F.col("tf") * F.col("idf")).alias("w"))
    norm = Window.partitionBy(key)
    return raw.select(key, "word", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm))).alias("weight"))

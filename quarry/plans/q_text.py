"""Registered queries: text features and word statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens_sql
from ..operators import text as T
from . import plots as P
from .catalog import query

TOK = tokens_sql("x")


@query("count_plot_text", f"""
WITH pre AS (SELECT text AS x, lang AS color FROM documents),
co AS (SELECT color AS v FROM pre WHERE color IS NOT NULL GROUP BY color ORDER BY count(*) DESC, color LIMIT 10),
pd AS (SELECT x, color FROM pre WHERE x IS NOT NULL AND color IS NOT NULL AND color IN (SELECT v FROM co)),
occ AS (SELECT unnest({TOK}) AS w, color FROM pd),
vocab AS (SELECT w FROM occ GROUP BY w ORDER BY count(*) DESC, w LIMIT 25),
st AS (SELECT w, color, count(*) AS n FROM occ WHERE w IN (SELECT w FROM vocab) GROUP BY w, color),
grid AS (SELECT v.w, c.color FROM vocab v, (SELECT DISTINCT color FROM pd) c)
SELECT g.w AS x, g.color, CAST(coalesce(st.n, 0) AS BIGINT) AS count,
  CAST(coalesce(sum(coalesce(st.n, 0)) OVER (PARTITION BY g.w ORDER BY g.color
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bottom
FROM grid g LEFT JOIN st ON g.w = st.w AND g.color = st.color
""")
def count_plot_text(t):
    """P1/D5 on text: top-25 words over all documents, occurrences per language."""
    return P.count_plot(t("documents"), "text", color="lang", x_type="text")


@query("mean_plot_text", f"""
WITH pd AS (SELECT d.text AS x, CAST(l.quality AS DOUBLE) AS y, d.source AS color
            FROM documents d JOIN labels l ON d.doc_id = l.doc_id
            WHERE d.text IS NOT NULL AND l.quality IS NOT NULL AND d.source IS NOT NULL),
co AS (SELECT color AS v FROM pd GROUP BY color ORDER BY count(*) DESC, color LIMIT 10),
occ AS (SELECT unnest({TOK}) AS w, y, color FROM pd WHERE color IN (SELECT v FROM co)),
vocab AS (SELECT w FROM occ GROUP BY w ORDER BY count(*) DESC, w LIMIT 25),
st AS (SELECT w, color, count(*) AS n, sum(y) AS sy FROM occ WHERE w IN (SELECT w FROM vocab) GROUP BY w, color),
grid AS (SELECT v.w, c.color FROM vocab v, (SELECT DISTINCT color FROM pd WHERE color IN (SELECT v FROM co)) c)
SELECT g.w AS x, g.color, round(st.sy / st.n, 6) AS mean
FROM grid g LEFT JOIN st ON g.w = st.w AND g.color = st.color
""")
def mean_plot_text(t):
    """P2/D6 on text: tf-weighted share of good-quality documents per word and source."""
    d = t("documents").join(t("labels"), "doc_id")
    return P.mean_plot(d, "text", "quality", color="source", x_type="text")


@query("word_stats", f"""
WITH pd AS (SELECT p_name AS x, p_retailprice AS y FROM part WHERE p_name IS NOT NULL AND p_retailprice IS NOT NULL),
occ AS (SELECT unnest({TOK}) AS w, y FROM pd)
SELECT w AS x, count(*) AS count, round(sum(y) / count(*), 6) AS mean
FROM occ GROUP BY w ORDER BY count(*) DESC, w LIMIT 25
""")
def word_stats(t):
    """D5/D6 without colour: word counts and tf-weighted mean price of part names."""
    return T.text_stats(t("part").where(F.col("p_retailprice").isNotNull()), "p_name", "p_retailprice")


@query("grouped_average_text", f"""
WITH d AS (SELECT d.text AS x, CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL),
occ AS (SELECT unnest({TOK}) AS w, quality, toxic FROM d)
SELECT w AS x, count(*) AS count, round(sum(quality) / count(*), 6) AS quality,
       round(sum(toxic) / count(*), 6) AS toxic
FROM occ GROUP BY w ORDER BY count(*) DESC, w LIMIT 100
""")
def grouped_average_text(t):
    """Top-100 words, tf-weighted mean of each label column."""
    d = t("documents").join(t("labels"), "doc_id").select("text", "quality", "toxic")
    return T.grouped_average_text(d, "text")


@query("term_counts", f"""
SELECT doc_id, w AS word, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS w FROM documents)
GROUP BY doc_id, w
""")
def term_counts(t):
    """Document x word counts over every document, whole texts."""
    return T.term_counts(t("documents"), "doc_id", "text")


@query("vocabulary", f"""
WITH tc AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS w FROM documents)),
v AS (SELECT w AS word, count(*) AS df FROM tc GROUP BY w
      HAVING count(*) >= 0.005 * (SELECT count(*) FROM documents))
SELECT word, df, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS index FROM v
""")
def vocabulary(t):
    """T4: words in at least 0.5 % of documents, alphabetical column index."""
    return T.min_df_vocabulary(t("documents"), "doc_id", "text", min_df=0.005)


@query("tfidf", f"""
WITH n AS (SELECT count(*) AS n FROM documents),
tc AS (SELECT doc_id, w AS word, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS w FROM documents)
       GROUP BY doc_id, w),
v AS (SELECT word, count(*) AS df FROM tc GROUP BY word HAVING count(*) >= 0.005 * (SELECT n FROM n)),
raw AS (SELECT tc.doc_id, tc.word, tc.tf * (ln((1.0 + (SELECT n FROM n)) / (1.0 + v.df)) + 1.0) AS w
        FROM tc JOIN v ON tc.word = v.word)
SELECT doc_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw
""")
def tfidf(t):
    """Smoothed tf-idf (+1), L2-normalised per document."""
    return T.tfidf(t("documents"), "doc_id", "text", min_df=0.005)

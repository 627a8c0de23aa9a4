"""Golden values from the reference's worked example (word-weighted averages)."""

from pyspark.sql import functions as F

from quarry.operators.text import grouped_average_text, text_stats
from quarry.functions.text import ENGLISH_STOP_WORDS


def toy(spark):
    rows = [("dog", 100.0), ("cat", 0.0), ("cat dog", 1.0), ("cat cat cat", 10.0)]
    return spark.createDataFrame(rows, "text string, y double")


def test_word_average_golden(spark):
    out = {r["x"]: (r["count"], r["y"]) for r in grouped_average_text(toy(spark), "text").collect()}
    assert out["cat"][0] == 5 and abs(out["cat"][1] - 6.2) < 1e-12
    assert out["dog"][0] == 2 and abs(out["dog"][1] - 50.5) < 1e-12


def test_text_stats_mean_matches_golden(spark):
    out = {r["x"]: (r["count"], r["mean"]) for r in text_stats(toy(spark), "text", "y").collect()}
    assert out == {"cat": (5, 6.2), "dog": (2, 50.5)}


def test_stop_words_match_spark(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert tuple(StopWordsRemover.loadDefaultStopWords("english")) == ENGLISH_STOP_WORDS


def test_accented_letters_kept(spark):
    from quarry.functions.text import tokens
    df = spark.createDataFrame([("Él comió crème brûlée über straße",)], "t string")
    words = df.select(tokens("t").alias("w")).first()["w"]
    assert words == ["él", "comió", "crème", "brûlée", "über", "straße"]

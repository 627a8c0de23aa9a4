"""File sources and sinks.

A1 opens CSV (header, inferred types) or parquet after checking the path and
its extension.  A7 writes predictions with Spark's writers (one file per
partition, no driver collect).  A8 saves a project as plain parts: a JSON
spec, the trial log as parquet and every fitted pipeline with Spark ML's own
writer -- no pickles.
"""

from __future__ import annotations

import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

EXTENSIONS = (".csv", ".parquet")


def open_table(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    """A1: a CSV (header + inferred schema) or parquet table; other extensions are errors."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in EXTENSIONS:
        raise ValueError(f"unsupported file type {ext!r}: expected one of {EXTENSIONS}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if ext == ".parquet":
        df = spark.read.parquet(path)
        return df.limit(nrows) if nrows is not None else df
    reader = spark.read.option("header", True)
    if nrows is None:
        return reader.option("inferSchema", True).csv(path)
    # the first rows alone decide the types of a preview; the rest of the file is not read for it
    head = [r["value"] for r in spark.read.text(path).limit(nrows + 1).collect()]
    return reader.option("inferSchema", True).csv(spark.sparkContext.parallelize(head, 1))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system, local or not."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def score_source(training: DataFrame, data: DataFrame | str | None) -> DataFrame:
    """Rows to predict -- the training data, a file path, or a DataFrame."""
    if data is None:
        return training
    if isinstance(data, str):
        return open_table(training.sparkSession, data)
    return data


def write_predictions(predictions: DataFrame, path: str, fmt: str = "csv") -> None:
    """Predictions to CSV (with header, no index) or parquet."""
    w = predictions.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def save_project_part(spark: SparkSession, path: str, spec: dict, trials: DataFrame | None,
                      fitted: dict[str, PipelineModel]) -> None:
    """Spec JSON, trial log parquet, fitted pipelines with the ML writer."""
    saved = {}
    for name, model in fitted.items():
        saved[name] = os.path.join(path, "models", name.replace(" ", "_"))
        model.write().overwrite().save(saved[name])
    spark.createDataFrame([(json.dumps(dict(spec, models=saved), default=str),)], "spec string") \
        .coalesce(1).write.mode("overwrite").text(os.path.join(path, "spec"))
    if trials is not None:
        trials.write.mode("overwrite").parquet(os.path.join(path, "trials"))


def load_project_part(spark: SparkSession, path: str) -> tuple[dict, DataFrame | None, dict[str, PipelineModel]]:
    spec = json.loads(spark.read.text(os.path.join(path, "spec")).first()[0])
    tpath = os.path.join(path, "trials")
    trials = spark.read.parquet(tpath) if exists(spark, tpath) else None
    return spec, trials, {name: PipelineModel.load(target) for name, target in spec.get("models", {}).items()}

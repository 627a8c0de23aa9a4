"""Preprocessing stages (C1, C8, F2-F11, T1-T7) as Spark ML pipeline stages.

* numeric block (F3-F8): impute, **then** scale, fitted with two aggregates
  (fill values, then statistics of the filled columns) and applied as column
  expressions.  Scalers follow the reference library's definitions: min-max
  to [0, 1], max-abs, centred by mean over the *population* std, robust
  (median, inter-quartile range); a zero range/scale leaves values unscaled.
* categoric block (F9): text form of each value (null -> ``'nan'``),
  ``StringIndexer(alphabetAsc, keep)`` + ``OneHotEncoder(dropLast)`` -- the
  "unseen" index is the dropped last slot, so unseen values encode as zeros.
* text block (T1-T7): tokens, stop words, counts of the words in at least 0.5 %
  of the rows (a ``CountVectorizerModel`` on a vocabulary from one aggregate:
  Spark's estimator holds the words of all rows as objects while it fits), smoothed idf with the +1 of the reference library (tf * (idf + 1)), L2.
* ``VectorAssembler`` joins the blocks (F10); feature names are kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, IDF, Normalizer, OneHotEncoder,
                                RegexTokenizer, StopWordsRemover, StringIndexer, VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol, HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ENGLISH_STOP_WORDS, WORD_PATTERN
from .quantiles import exact_quantiles

IMPUTERS = ("mean", "median", "most_frequent")
SCALERS = ("MinMax", "MaxAbs", "Standard", "Robust")


class _Stage(Params, DefaultParamsReadable, DefaultParamsWritable):
    pass


# --- numeric block ---------------------------------------------------------------------

def _with_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with the numeric columns it lacks as nulls (C1), which are then imputed."""
    return df.withColumns({c: F.lit(None).cast("double") for c in cols if c not in df.columns})


class NumericBlock(Estimator, HasInputCols, HasOutputCol, _Stage):
    """Impute then scale the numeric columns into one vector."""
    imputer = Param(Params._dummy(), "imputer", "mean | median | most_frequent", TypeConverters.toString)
    scaler = Param(Params._dummy(), "scaler", "None | MinMax | MaxAbs | Standard | Robust", TypeConverters.toString)
    accuracy = Param(Params._dummy(), "accuracy", "0 = exact percentiles, else sketch accuracy",
                     TypeConverters.toInt)
    apart = Param(Params._dummy(), "apart", "whether the values are columns of their own as well", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCols=None, outputCol="nums_vec", imputer="mean", scaler="None", accuracy=0, apart=False):
        super().__init__()
        self._setDefault(imputer="mean", scaler="None", accuracy=0, outputCol="nums_vec", apart=False)
        self._set(**self._input_kwargs)

    def setParams(self, **kw):
        return self._set(**kw)

    def _quantiles(self, df: DataFrame, values, probs) -> list[list[float]]:
        """The quantiles of every column at once: one row per column, exact unless ``accuracy`` asks for a sketch."""
        acc = self.getOrDefault(self.accuracy)
        if acc:
            row = df.agg(*[F.percentile_approx(v, F.array(*map(F.lit, probs)), acc) for v in values]).first()
            return [list(q) if q else [None] * len(probs) for q in row]
        long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values)])))
        found = {r["i"]: list(r["q"]) for r in exact_quantiles(long, ["i"], "v", probs).collect()}
        return [found.get(i, [None] * len(probs)) for i in range(len(values))]

    def _fit(self, df: DataFrame) -> "NumericBlockModel":
        cols = self.getInputCols()
        how = self.getOrDefault(self.imputer)
        df = _with_columns(df, cols)
        raw = [F.col(f"`{c}`").cast("double") for c in cols]
        if how == "median":
            found = [q[0] for q in self._quantiles(df, raw, [0.5])]
        elif how in ("mean", "most_frequent"):
            found = list(df.agg(*[F.avg(x) if how == "mean" else F.mode(x, True) for x in raw]).first())
        else:
            raise ValueError(how)
        fill = [0.0 if f is None else float(f) for f in found]
        scaler = self.getOrDefault(self.scaler)
        center = [0.0] * len(cols)
        scale = [1.0] * len(cols)
        if scaler != "None":
            filled = [F.coalesce(x, F.lit(f)) for x, f in zip(raw, fill)]
            if scaler == "Robust":
                pairs = [(q[1], None if q[0] is None else q[2] - q[0])
                         for q in self._quantiles(df, filled, [0.25, 0.5, 0.75])]
            else:
                table = {"MinMax": lambda v: (F.min(v), F.max(v) - F.min(v)),
                         "MaxAbs": lambda v: (F.first(F.lit(0.0)), F.max(F.abs(v))),
                         "Standard": lambda v: (F.avg(v), F.stddev_pop(v))}
                if scaler not in table:
                    raise ValueError(scaler)
                flat = list(df.agg(*[a for v in filled for a in table[scaler](v)]).first())
                pairs = list(zip(flat[::2], flat[1::2]))
            for i, (a, b) in enumerate(pairs):
                center[i] = a or 0.0
                scale[i] = b if b and not math.isnan(b) else 1.0
        return NumericBlockModel(inputCols=cols, outputCol=self.getOutputCol(),
                                 fill=fill, center=center, scale=scale, apart=self.getOrDefault(self.apart))


class NumericBlockModel(Model, HasInputCols, HasOutputCol, _Stage):
    fill = Param(Params._dummy(), "fill", "fill values", TypeConverters.toListFloat)
    center = Param(Params._dummy(), "center", "centre", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "scale", TypeConverters.toListFloat)
    apart = Param(Params._dummy(), "apart", "whether the values are columns of their own as well", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCols=None, outputCol=None, fill=None, center=None, scale=None, apart=False):
        super().__init__()
        self._setDefault(apart=False)
        self._set(**self._input_kwargs)

    def columns(self):
        f, c, s = (self.getOrDefault(p) for p in (self.fill, self.center, self.scale))
        return [((F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(f[i])) - F.lit(c[i])) / F.lit(s[i]))
                for i, n in enumerate(self.getInputCols())]

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.getInputCols()
        # ML attribute metadata: the vector size and names, as VectorAssembler expects
        meta = {"ml_attr": {"num_attrs": len(names),
                            "attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]}}}
        vector = array_to_vector(F.array(*self.columns())).alias(self.getOutputCol(), metadata=meta)
        missing = [c for c in names if c not in df.columns]
        out = _with_columns(df, names).withColumn(self.getOutputCol(), vector)
        if self.getOrDefault(self.apart):
            out = out.withColumns({f"{self.getOutputCol()}__{i}": v for i, v in enumerate(self.columns())})
        return out.drop(*missing)


# --- categoric block -------------------------------------------------------------------

class CategoryText(Transformer, HasInputCols, _Stage):
    """``__cat_<col>`` = value as text, null -> 'nan'; absent column -> 'nan' (C1)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        present = set(df.columns)
        for c in self.getInputCols():
            v = F.col(f"`{c}`").cast("string") if c in present else F.lit(None).cast("string")
            df = df.withColumn(f"__cat_{c}", F.coalesce(v, F.lit("nan")))
        return df


def categoric_stages(cats: Sequence[str]) -> list:
    """one-hot of every categoric column; unseen -> all zero; names col_value."""
    if not cats:
        return []
    idx = StringIndexer(inputCols=[f"__cat_{c}" for c in cats], outputCols=[f"__idx_{c}" for c in cats],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    # the indexer's metadata counts the "unseen" index as the last category;
    # dropLast removes exactly that slot, so unseen values encode as zeros
    ohe = OneHotEncoder(inputCols=[f"__idx_{c}" for c in cats], outputCols=[f"__ohe_{c}" for c in cats],
                        dropLast=True, handleInvalid="error")
    return [CategoryText(inputCols=list(cats)), idx, ohe]


# --- text block ------------------------------------------------------------------------

class TextFill(Transformer, HasInputCols, _Stage):
    """C1 for text: absent column or null cell -> ''."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        present = set(df.columns)
        for c in self.getInputCols():
            v = F.col(f"`{c}`") if c in present else F.lit(None).cast("string")
            df = df.withColumn(f"__txt_{c}", F.coalesce(v.cast("string"), F.lit("")))
        return df


class WordCounts(Estimator, HasInputCol, HasOutputCol, _Stage):
    """T4/T5: word counts over the words that at least ``minDF`` of the rows hold.

    Columns are ordered by the words' total counts, the greatest first, equal
    ones by the word.
    """
    minDF = Param(Params._dummy(), "minDF", "least share of rows that hold a word", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, minDF=0.005):
        super().__init__()
        self._setDefault(minDF=0.005)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CountVectorizerModel:
        words = F.col(self.getInputCol())
        least = self.getOrDefault(self.minDF) * df.count()
        long = df.select(F.inline(F.concat(
            F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
            F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("word"), F.lit(0).alias("tf"), F.lit(1).alias("df"))))))
        counts = long.groupBy("word").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        kept = counts.where(F.col("df") >= F.lit(least)).orderBy(F.desc("tf"), "word").select("word").collect()
        if not kept:
            raise ValueError("no word is in enough rows: the vocabulary is empty")
        return CountVectorizerModel.from_vocabulary([r["word"] for r in kept], self.getInputCol(), self.getOutputCol())


class SmoothTfIdf(Estimator, HasInputCol, HasOutputCol, _Stage):
    """Tf * (ln((1+n)/(1+df)) + 1), then L2 normalisation (as a fitted pipeline)."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        tmp = f"{self.getOutputCol()}__idf"
        idf = IDF(inputCol=self.getInputCol(), outputCol=tmp).fit(df)
        plus_one = DenseVector(idf.idf.toArray() + 1.0)
        scaled = f"{self.getOutputCol()}__w"
        return PipelineModel(stages=[
            ElementwiseProduct(inputCol=self.getInputCol(), outputCol=scaled, scalingVec=plus_one),
            Normalizer(inputCol=scaled, outputCol=self.getOutputCol(), p=2.0)])


def text_stages(text: Sequence[str], min_df: float = 0.005) -> list:
    """One tokeniser / vectoriser / tf-idf chain per text column."""
    if not text:
        return []
    stages = [TextFill(inputCols=list(text))]
    for c in text:
        stages += [
            RegexTokenizer(inputCol=f"__txt_{c}", outputCol=f"__tok_{c}", pattern=WORD_PATTERN, gaps=False,
                           toLowercase=True, minTokenLength=2),
            StopWordsRemover(inputCol=f"__tok_{c}", outputCol=f"__words_{c}", stopWords=list(ENGLISH_STOP_WORDS)),
            WordCounts(inputCol=f"__words_{c}", outputCol=f"__tf_{c}", minDF=min_df),
            SmoothTfIdf(inputCol=f"__tf_{c}", outputCol=f"__tfidf_{c}"),
        ]
    return stages


# --- constant and random-feature stages -------------------------------------------------

class ConstantFeature(Transformer, HasOutputCol, _Stage):
    """a single zero feature (the benchmark models need no input)."""

    @keyword_only
    def __init__(self, outputCol="features"):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(F.lit(0.0))))


class RBFFeatures(Estimator, HasInputCol, HasOutputCol, _Stage):
    """random Fourier features sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi)."""
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    nComponents = Param(Params._dummy(), "nComponents", "output dimension", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="rbf_features", gamma=1.0, nComponents=100, seed=42):
        super().__init__()
        self._setDefault(gamma=1.0, nComponents=100, seed=42, inputCol="features", outputCol="rbf_features")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "RBFFeaturesModel":
        d = df.select(F.size(vector_to_array(F.col(self.getInputCol()))).alias("d")).first()["d"]
        rng = np.random.RandomState(self.getOrDefault(self.seed))
        n = self.getOrDefault(self.nComponents)
        w = rng.normal(0.0, math.sqrt(2.0 * self.getOrDefault(self.gamma)), size=(d, n))
        b = rng.uniform(0.0, 2.0 * math.pi, size=n)
        return RBFFeaturesModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
                                weights=w.ravel().tolist(), offsets=b.tolist(), dims=[d, n])


class RBFFeaturesModel(Model, HasInputCol, HasOutputCol, _Stage):
    weights = Param(Params._dummy(), "weights", "projection (row major d x D)", TypeConverters.toListFloat)
    offsets = Param(Params._dummy(), "offsets", "phases", TypeConverters.toListFloat)
    dims = Param(Params._dummy(), "dims", "d, D", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, weights=None, offsets=None, dims=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        d, n = self.getOrDefault(self.dims)
        w = np.asarray(self.getOrDefault(self.weights)).reshape(d, n)
        b = np.asarray(self.getOrDefault(self.offsets))
        bw = df.sparkSession.sparkContext.broadcast((w, b))   # fixed size: d x D
        norm = math.sqrt(2.0 / n)

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            ww, bb = bw.value
            X = np.stack(x.to_numpy()) if len(x) else np.zeros((0, ww.shape[0]))
            Z = norm * np.cos(X @ ww + bb)
            return pd.Series(list(Z))

        return df.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(F.col(self.getInputCol())))))


# --- features as plain numbers --------------------------------------------------------------

PLAIN_FEATURES = 64     # most features that are also kept as an array of expressions


class FeatureArray(Transformer, HasInputCols, HasOutputCol, _Stage):
    """``<output>__x``: what the assembled vector ``<output>`` holds, as an array of column expressions.

    Building a vector calls a function for each block of each row; who only
    needs numbers reads this array, whose elements are plain expressions of the
    source columns.  ``inputCols`` are the categoric columns, ``nums`` the
    number of numeric ones.  Many categories leave the array out.
    """
    nums = Param(Params._dummy(), "nums", "numeric features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, outputCol=None, nums=0):
        super().__init__()
        self._setDefault(nums=0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        apart = [f"__nums__{i}" for i in range(self.getOrDefault(self.nums))]
        parts = [F.col(c) for c in apart]
        for c in self.getInputCols():
            labels = df.schema[f"__idx_{c}"].metadata.get("ml_attr", {}).get("vals")
            if labels is None or len(parts) + len(labels) - 1 > PLAIN_FEATURES:
                return df.drop(*apart)
            # the last label stands for unseen values
            parts += [F.when(F.col(f"__cat_{c}") == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)) for v in labels[:-1]]
        if len(parts) > PLAIN_FEATURES:
            return df.drop(*apart)
        return df.withColumn(f"{self.getOutputCol()}__x", F.array(*parts)).drop(*apart)


# --- the whole preprocessor --------------------------------------------------------------

def preprocessor(nums: Sequence[str] = (), cats: Sequence[str] = (), text: Sequence[str] = (),
                 imputer: str = "mean", scaler: str | None = None, output: str = "features",
                 min_df: float = 0.005, accuracy: int = 0) -> Pipeline:
    """numeric, categoric and text blocks (each only if non-empty) -> one vector."""
    stages, parts = [], []
    if nums:
        stages.append(NumericBlock(inputCols=list(nums), outputCol="__nums", imputer=imputer,
                                   scaler=scaler or "None", accuracy=accuracy, apart=not text))
        parts.append("__nums")
    if cats:
        stages += categoric_stages(cats)
        parts += [f"__ohe_{c}" for c in cats]
    if text:
        stages += text_stages(text, min_df)
        parts += [f"__tfidf_{c}" for c in text]
    if not parts:
        return Pipeline(stages=[ConstantFeature(outputCol=output)])
    stages.append(VectorAssembler(inputCols=parts, outputCol=output, handleInvalid="keep"))
    if not text:
        stages.append(FeatureArray(inputCols=list(cats), outputCol=output, nums=len(nums)))
    return Pipeline(stages=stages)


def feature_names(model: PipelineModel, nums: Sequence[str] = (), cats: Sequence[str] = (),
                  text: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(name, source column) of the assembled features: nums, ``col_value``, ``col_word``."""
    names = [(c, c) for c in nums]
    for st in model.stages:
        if cats and type(st).__name__ == "StringIndexerModel":
            for c, labels in zip(cats, st.labelsArray):
                names += [(f"{c}_{v}", c) for v in labels]
    for c in text:
        for st in model.stages:
            if type(st).__name__ == "CountVectorizerModel" and st.getInputCol() == f"__words_{c}":
                names += [(f"{c}_{w}", c) for w in st.vocabulary]
    return names


def sparse_entries(vector_col: str, index: str = "i", value: str = "value"):
    """Non-zero (index, value) pairs of an ML vector column, without densifying it.

    The vector's storage struct (type, size, indices, values) is read through
    its JSON form -- a JVM-side conversion -- so a 10 000-word tf-idf vector
    costs its non-zeros, not 10 000 array slots.
    """
    schema = "struct<v:struct<type:tinyint,size:int,indices:array<int>,values:array<double>>>"
    parsed = F.from_json(F.to_json(F.struct(F.col(vector_col).alias("v"))), schema)["v"]
    dense = F.transform(parsed["values"], lambda v, i: F.struct(i.alias(index), v.alias(value)))
    sparse = F.arrays_zip(parsed["indices"].alias(index), parsed["values"].alias(value))
    return F.explode(F.when(parsed["type"] == 0, sparse).otherwise(dense))

"""Project and Experiment: the reference's two user-facing objects, on Spark.

``Project`` profiles a table (B3-B10).  ``Experiment`` holds one prediction
task: splits (V1-V5), the model catalogue, the search (H1-H10), predictions
(X1-X3), explanations (X4-X8, D10, D11) and evaluation (M10, M11, W2).

Spark has no row order, so an explicit ``key`` (one or more columns) is part of
the spec; every split is a hash of it.  Classes are the target's distinct
values in sorted order; a classifier's ``prediction`` is an index into them.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import key_hash
from ..operators import aggregates as A
from ..operators import metrics as M
from ..operators import profile as B
from ..operators import validation as V
from ..operators.features import feature_names, preprocessor
from ..operators.jobs import side_by_side
from ..operators.models.catalogue import (Context, classification_benchmark, classification_models,
                                          regression_benchmark, regression_models)
from ..operators.search import TRIAL_SCHEMA, best_parameters, decoded, leaderboard, run_search, training_curve
from ..operators.text import grouped_average_text
from ..sources import files

# Validation option names accepted by the reference (plus ours).
CV_NAMES = (None, "cv", "Cross Validation", "random cv")
TEST_NAMES = ("test", "Train-Test Split")
MAX_REASONS = 5
FOLDS_AT_ONCE = 5         # folds of a trial whose jobs run together


class Project:
    """Column profiling of one table."""

    def __init__(self, data: DataFrame, name: str | None = None):
        self.data = data
        self.name = name or "Untitled Project"
        self.experiments: list[Experiment] = []

    def all_columns(self) -> list[str]:
        return list(self.data.columns)

    def numeric_columns(self) -> list[str]:
        return B.column_types(self.data)["nums"]

    def non_negative_columns(self) -> DataFrame:
        return B.non_negative_columns(self.data)

    def metrics(self, target: str, dtype: str) -> DataFrame:
        return B.metric_suggestions(self.data, target, dtype)

    def column_summary(self, approx: bool = False) -> DataFrame:
        return B.column_summary(self.data, approx)

    def frequencies(self, feature: str) -> DataFrame:
        return B.frequencies(self.data, feature)

    def save(self, path: str) -> None:
        """The list of experiments, and each of them in a folder of its own."""
        spark = self.data.sparkSession
        rows = [(i, self.name, e.name) for i, e in enumerate(self.experiments)]
        spark.createDataFrame(rows, "position int, project string, experiment string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/experiments")
        for i, e in enumerate(self.experiments):
            e.save(f"{path}/experiment-{i}")

    @classmethod
    def load(cls, data: DataFrame, path: str) -> "Project":
        rows = data.sparkSession.read.parquet(f"{path}/experiments").orderBy("position").collect()
        project = cls(data, rows[0]["project"] if rows else None)
        project.experiments = [Experiment.load(data, f"{path}/experiment-{r['position']}") for r in rows]
        return project

    def new_experiment(self, **options) -> "Experiment":
        exp = Experiment(self.data, **options)
        self.experiments.append(exp)
        return exp


class Experiment:
    def __init__(self, data: DataFrame, target: str, classification: bool, key: str | Sequence[str],
                 weights: str | None = None, validation_method: str | None = None,
                 validation_size: float | None = None, holdout_size: float | None = None,
                 scorer: str | None = None, nums: Sequence[str] | None = None,
                 cats: Sequence[str] | None = None, text: Sequence[str] | None = None,
                 name: str | None = None, groups: str | None = None, seed: int = 42):
        self.data, self.target, self.classification = data, target, classification
        self.key = [key] if isinstance(key, str) else list(key)
        self.name = name or "Untitled Experiment"
        if validation_method in CV_NAMES:
            self.validation_method = "random cv"
        elif validation_method in TEST_NAMES:
            self.validation_method = "test"
        elif validation_method in ("stratified", "group"):
            self.validation_method = validation_method
        else:
            raise ValueError(f"unknown validation method {validation_method!r}")
        if self.validation_method == "group" and not groups:
            raise ValueError("group validation needs a groups column")
        self.validation_size = validation_size if validation_size is not None else (
            0.1 if self.validation_method == "test" else 5)
        self.holdout_size = 0.1 if holdout_size is None else holdout_size
        self.weights, self.groups, self.seed = weights, groups, seed
        self.scorer = scorer or ("accuracy" if classification else "r2")
        self.nums, self.cats, self.text = list(nums or []), list(cats or []), list(text or [])
        self.classes: list = []
        if classification:
            # every class is a column of the result, so that their list is part of any model
            self.classes = sorted(r[0] for r in data.where(F.col(target).isNotNull()).select(target).distinct().collect())
            self.models = classification_models(self.nums, self.cats, self.text, len(self.classes))
            self.models[classification_benchmark().name] = classification_benchmark()
        else:
            self.models = regression_models(self.nums, self.cats, self.text)
            self.models[regression_benchmark().name] = regression_benchmark()
        self.trials: dict[str, list[dict]] = {}
        self.fitted: dict[str, PipelineModel] = {}
        self.holdout_scores: dict[str, float | None] = {}

    # --- data with label, weights and split columns ---------------------------------------

    def _label(self) -> Column:
        if not self.classification:
            return F.col(self.target).cast("double")
        arr = F.array(*[F.lit(c) for c in self.classes])
        return (F.array_position(arr, F.col(self.target)) - 1).cast("double")

    def prepared(self) -> DataFrame:
        """All rows with ``label``, ``__w``, ``__cw``, ``__hold`` and the validation column.

        Only the used columns are kept; the frame is
        persisted (memory, then disk) once for the whole search -- every fold
        fit and score reads it instead of re-reading and re-hashing the source.
        Membership columns are key hashes, so a lost partition recomputes the
        same rows.  ``release()`` drops it.
        """
        if getattr(self, "_prepared", None) is not None:
            return self._prepared
        used = list(dict.fromkeys(self.key + [self.target] + self.nums + self.cats + self.text +
                                  ([self.weights] if self.weights else []) + ([self.groups] if self.groups else [])))
        df = self.data.where(F.col(self.target).isNotNull()).select(*[F.col(f"`{c}`") for c in used])
        df = df.withColumn("label", self._label())
        df = df.withColumn("__w", F.col(self.weights).cast("double") if self.weights else F.lit(1.0))
        df = df.withColumn("__hold", V.holdout_flag(self.key, self.holdout_size))
        if self.classification:
            counts = df.where(~F.col("__hold")).groupBy("label").agg(F.count(F.lit(1)).alias("__nc"))
            whole = Window.partitionBy()
            cw = counts.select("label", (F.sum("__nc").over(whole) /
                                         (F.count(F.lit(1)).over(whole) * F.col("__nc"))).alias("__bal"))
            # one row for each class: joined without moving the rows, which a label of many would put into one task
            df = df.join(F.broadcast(cw), "label", "left") \
                   .withColumn("__cw", F.col("__w") * F.coalesce(F.col("__bal"), F.lit(1.0))).drop("__bal")
        else:
            df = df.withColumn("__cw", F.col("__w"))
        m = self.validation_method
        if m == "test":
            df = df.withColumn("__test", V.holdout_flag(self.key, float(self.validation_size), salt="test"))
        elif m == "random cv":
            df = V.kfold(df, self.key, int(self.validation_size), out="__fold")
        elif m == "stratified":
            df = V.stratified_kfold(df, self.key, "label", int(self.validation_size), out="__fold")
        else:
            df = V.group_folds(df, self.groups, out="__fold")
        self._prepared = df.persist(StorageLevel.MEMORY_AND_DISK)
        return self._prepared

    def release(self) -> None:
        """Unpersist the prepared training frame."""
        if getattr(self, "_prepared", None) is not None:
            self._prepared.unpersist()
            self._prepared = None

    def split(self, train: bool = True) -> DataFrame:
        d = self.prepared()
        return d.where(~F.col("__hold")) if train else d.where(F.col("__hold"))

    # --- pipelines and scoring -----------------------------------------------------------------

    def pipeline(self, model: str, params: dict, n: float) -> Pipeline:
        spec = self.models[model]
        pre = preprocessor(self.nums, self.cats, self.text, imputer=params.get("pre__nums__imputer", "mean"),
                           scaler=params.get("pre__nums__scaler") if spec.scaled else None)
        ctx = Context(n=n, n_classes=len(self.classes), key=tuple(self.key))
        return Pipeline(stages=pre.getStages() + spec.build(params, ctx))

    def _scored(self, fitted: PipelineModel, df: DataFrame) -> DataFrame:
        out = fitted.transform(df)
        if self.classification:
            prob = vector_to_array("probability")
            out = out.withColumn("__p_true", F.element_at(prob, F.col("label").cast("int") + 1)) \
                     .withColumn("__p1", F.element_at(prob, 2))
        return out

    def score(self, fitted: PipelineModel, df: DataFrame) -> float:
        """The experiment's scorer on ``df`` (greater is better), weighted by ``__w``."""
        out = self._scored(fitted, df)
        if self.scorer == "roc_auc":
            return M.roc_auc(out, F.col("label") == 1.0, "__p1", "__w").first()[0]
        if self.scorer == "neg_median_absolute_error":
            return -M.median_absolute_error(out, "label", "prediction", "__w" if self.weights else None).first()["medae"]
        col = M.scorer_column(self.scorer, "label", "prediction", "__p_true", "__w", positive=1.0)
        return out.agg(col.alias("s")).first()["s"]

    def _evaluator(self, model: str, train: DataFrame, n: float):
        k = int(self.validation_size) if self.validation_method != "test" else 0
        if self.validation_method == "group":
            k = train.select(F.max("__fold")).first()[0] + 1

        def one_fold(params, f):
            t0 = time.time()
            fitted = self.pipeline(model, params, n).fit(train.where(F.col("__fold") != f))
            return self.score(fitted, train.where(F.col("__fold") == f)), time.time() - t0

        def evaluate(params, best_mean, best_std):
            pipe = self.pipeline(model, params, n)
            if self.validation_method == "test":
                t0 = time.time()
                fitted = pipe.fit(train.where(~F.col("__test")))
                s = self.score(fitted, train.where(F.col("__test")))
                return s, 0.0, time.time() - t0
            scores, times = [], []
            folds = side_by_side(train.sparkSession, [lambda f=f: one_fold(params, f) for f in range(k)], FOLDS_AT_ONCE)
            for score, seconds in folds:
                scores.append(score)
                times.append(seconds)
                if V.should_reject(scores, best_mean, best_std):
                    break
            folds.close()
            import numpy as np
            return float(np.mean(scores)), float(np.std(scores)), float(np.mean(times))
        return evaluate

    def fit_model(self, model: str, max_train_time: float = 600.0, max_trials: int | None = None) -> None:
        """H4-H6: search, refit the best on all training rows, score the holdout (V8)."""
        train = self.split(train=True)
        n = train.agg(F.sum("__w")).first()[0]
        spec = self.models[model]
        self.trials[model] = run_search(train.sparkSession, self.name, model, spec.domain,
                                        self._evaluator(model, train, n), max_train_time=max_train_time,
                                        max_trials=max_trials, seed=self.seed,
                                        previous=self.trials.get(model, ()), method=self.validation_method)
        if not self.trials[model]:
            raise TimeoutError(f"no trial of {model} finished within {max_train_time} s")
        best = max(self.trials[model], key=lambda t: t["score"])
        self.fitted[model] = self.pipeline(model, decoded(best["params"]), n).fit(train)
        self.holdout_scores[model] = self.score(self.fitted[model], self.split(train=False))

    def fit_fixed(self, model: str, params: dict | None = None) -> PipelineModel:
        """Fit one model with given parameters on the training rows (no search)."""
        train = self.split(train=True)
        n = train.agg(F.sum("__w")).first()[0]
        self.fitted[model] = self.pipeline(model, params or {}, n).fit(train)
        return self.fitted[model]

    # --- trial summaries ------------------------------------------------------------------

    def trials_table(self) -> DataFrame:
        spark = self.data.sparkSession
        rows = [t for ts in self.trials.values() for t in ts]
        return spark.createDataFrame(rows, TRIAL_SCHEMA)

    def training_scores(self) -> DataFrame:
        return training_curve(self.trials_table(), self.scorer)

    def leaderboard(self) -> DataFrame:
        spark = self.data.sparkSession
        hold = spark.createDataFrame([(self.name, k, v) for k, v in self.holdout_scores.items()],
                                     "experiment string, model string, holdout_score double")
        return leaderboard(self.trials_table(), hold)

    def best_parameters(self) -> DataFrame:
        return best_parameters(self.trials_table())

    # --- predictions (X1-X3) --------------------------------------------------------------

    def predictions(self, model: str, data: DataFrame | str | None = None, append: bool = False) -> DataFrame:
        """``Prediction`` [``Probability <class>``...] [input columns]."""
        df = files.score_source(self.data, data)
        out = self.fitted[model].transform(df)
        if self.classification:
            arr = F.array(*[F.lit(c) for c in self.classes])
            cols = [F.element_at(arr, F.col("prediction").cast("int") + 1).alias("Prediction")]
            prob = vector_to_array("probability")
            cols += [prob[i].alias(f"Probability {c}") for i, c in enumerate(self.classes)]
        else:
            cols = [F.col("prediction").alias("Prediction")]
        return out.select(*cols, *([F.col(f"`{c}`") for c in df.columns] if append else []))

    # --- explanations (X4-X8, D10, D11) ---------------------------------------------------------

    def prediction_reasons(self, model: str, rows: DataFrame, key: str | Sequence[str] | None = None) -> DataFrame:
        """Per row and feature, prediction minus the prediction with that feature blanked.

        Blank = null (numeric, categoric) or '' (text).  For a classifier the
        value compared is the probability of the row's original predicted
        class.  The original prediction is carried on each row and the blanked
        variants are exploded beside it: no join and no shuffle.
        """
        keys = self.key if key is None else ([key] if isinstance(key, str) else list(key))
        feats = self.nums + self.cats + self.text
        fitted = self.fitted[model]
        base = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys(keys + feats)])
        first = fitted.transform(base)
        if self.classification:
            orig = first.select(*base.columns, F.col("prediction").alias("__pred0"),
                                vector_to_array("probability").alias("__prob0"))
            orig = orig.withColumn("__v0", F.element_at("__prob0", F.col("__pred0").cast("int") + 1))
        else:
            orig = first.select(*base.columns, F.col("prediction").alias("__v0"))
        variants = orig.select("*", F.posexplode(F.array(*[F.lit(f) for f in feats])).alias("__i", "Feature"))
        variants = variants.withColumns({
            f: F.when(F.col("Feature") == f, F.lit("") if f in self.text else F.lit(None).cast(base.schema[f].dataType))
                .otherwise(F.col(f"`{f}`")) for f in feats})
        second = fitted.transform(variants)
        if self.classification:
            v = F.element_at(vector_to_array("probability"), F.col("__pred0").cast("int") + 1)
        else:
            v = F.col("prediction")
        return second.select(*keys, "Feature", (F.col("__v0") - v).alias("Difference"))

    def top_reasons(self, model: str, rows: DataFrame, n: int = MAX_REASONS) -> DataFrame:
        """The ``n`` largest absolute differences per row (ties by feature name)."""
        r = self.prediction_reasons(model, rows)
        w = Window.partitionBy(*self.key).orderBy(F.desc(F.abs("Difference")), "Feature")
        return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

    def feature_dependence(self, feature: str, model: str | None = None, cat=None, train: bool = True,
                           bins: int | None = None) -> DataFrame:
        """Mean actual (or share of ``cat``) and mean prediction against a feature."""
        if feature in self.nums:
            dtype = "numeric"
        elif feature in self.cats:
            dtype = "categoric"
        elif feature in self.text:
            dtype = "text"
        else:
            raise ValueError(f"{feature} is not a feature")
        d = self.split(train=train)
        if model is not None:
            d = self._scored(self.fitted[model], d)
        y = F.col(self.target) if cat is None else (F.col(self.target) == F.lit(cat)).cast("double")
        cols = [F.col(f"`{feature}`").alias("x"), y.cast("double").alias("y")]
        if model is not None:
            if cat is None:
                pred = F.col("prediction")
            else:
                pred = vector_to_array("probability")[self.classes.index(cat)]
            cols.append(pred.alias("ypred"))
        df = d.select(*cols)
        if dtype == "numeric":
            return A.grouped_average_numeric(df, "x", bins=bins or 10)
        if dtype == "categoric":
            return A.grouped_average_categoric(df, "x")
        return grouped_average_text(df, "x")

    def dependence_table(self, feature: str, model: str | None = None, cat=None, train: bool = True) -> DataFrame:
        """Category/Word, Count, Mean/Proportion, Predicted."""
        dep = self.feature_dependence(feature, model, cat, train)
        first = "Word" if feature in self.text else "Category"
        mean = "Proportion" if cat is not None else "Mean"
        cols = [F.col("x").alias(first), F.col("count").alias("Count"), F.col("y").alias(mean)]
        if model is not None:
            cols.append(F.col("ypred").alias("Predicted"))
        return dep.select(*cols)

    def feature_importance(self, model: str) -> DataFrame | None:
        """Tree importances scaled by their maximum, with feature names."""
        fitted = self.fitted[model]
        last = fitted.stages[-1]
        if not hasattr(last, "featureImportances"):
            return None
        imp = last.featureImportances.toArray()
        top = imp.max() if len(imp) and imp.max() > 0 else 1.0
        names = feature_names(fitted, self.nums, self.cats, self.text)
        spark = self.data.sparkSession
        return spark.createDataFrame([(n, float(v / top)) for (n, _), v in zip(names, imp)],
                                     "Feature string, Importance double")

    def importance_by_variable(self, model: str) -> DataFrame | None:
        """Importances summed back to the source column (planned in the reference)."""
        fi = self.feature_importance(model)
        if fi is None:
            return None
        names = feature_names(self.fitted[model], self.nums, self.cats, self.text)
        # in the order of the features: a value's text never decides whose feature it is
        imp = [r["Importance"] for r in fi.collect()]
        return (self.data.sparkSession.createDataFrame([(src, v) for (_, src), v in zip(names, imp)],
                                                       "Variable string, Importance double")
                .groupBy("Variable").agg(F.sum("Importance").alias("Importance")))

    def what_if(self, model: str, edits: DataFrame) -> DataFrame:
        """Default row (B10) overlaid by the edited values, then class probabilities."""
        defaults = B.default_row(self.data, self.nums, self.cats, self.text)
        feats = self.nums + self.cats + self.text
        row = edits
        for f in feats:
            dflt = defaults.select(F.col(f"`{f}`")).scalar()     # one value (scalar subquery)
            given = F.col(f"`{f}`").cast(self.data.schema[f].dataType) if f in edits.columns else F.lit(None)
            row = row.withColumn(f, F.coalesce(given, dflt))
        out = self.fitted[model].transform(row)
        keys = [c for c in edits.columns if c not in feats]
        if not self.classification:
            return out.select(*keys, F.col("prediction").alias("Prediction"))
        prob = vector_to_array("probability")
        pairs = F.arrays_zip(F.array(*[F.lit(str(c)) for c in self.classes]).alias("Category"),
                             prob.alias("Probability"))
        return out.select(*keys, F.inline(pairs))

    def confusion_matrix(self, model: str, train: bool = True) -> DataFrame:
        out = self._scored(self.fitted[model], self.split(train))
        return M.confusion_matrix(out, "label", "prediction")

    def roc_curves(self, model: str, train: bool = True) -> DataFrame:
        out = self._scored(self.fitted[model], self.split(train))
        prob = vector_to_array("probability")
        out = out.select("label", "__w", *[prob[i].alias(f"__pc{i}") for i in range(len(self.classes))])
        return M.one_vs_rest_roc(out.withColumn("label", F.col("label").cast("int").cast("string")), "label",
                                 {str(i): f"__pc{i}" for i in range(len(self.classes))}, weight="__w")

    # --- persistence (A8) -----------------------------------------------------------------------

    OPTIONS = ("name", "target", "classification", "key", "weights", "validation_method", "validation_size",
               "holdout_size", "scorer", "nums", "cats", "text", "groups", "seed")

    def save(self, path: str) -> None:
        """Options as JSON, the trial log as parquet, every fitted pipeline with Spark's writer."""
        spec = {k: getattr(self, k) for k in self.OPTIONS}
        spec |= {"classes": self.classes, "holdout_scores": self.holdout_scores}
        files.save_project_part(self.data.sparkSession, path, spec, self.trials_table() if self.trials else None,
                                self.fitted)

    @classmethod
    def load(cls, data: DataFrame, path: str) -> "Experiment":
        """An experiment saved by :meth:`save`, over ``data``: it predicts, explains, and resumes its search."""
        spec, trials, models = files.load_project_part(data.sparkSession, path)
        options = {k: spec[k] for k in cls.OPTIONS}
        if options["validation_method"] == "random cv":
            options["validation_method"] = "cv"
        exp = cls(data, **options)
        exp.fitted, exp.holdout_scores = models, spec["holdout_scores"]
        # the models number the classes they were trained on
        if exp.classification:
            exp.classes = spec["classes"]
        for row in trials.orderBy("model", "trial").collect() if trials is not None else ():
            exp.trials.setdefault(row["model"], []).append(row.asDict())
        return exp

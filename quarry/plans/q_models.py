"""Registered queries: models, predictions, explanations and search (R*, K*, X*, D10-D11, H*).

Closed-form models (least squares, ridge, Gaussian naive Bayes, LDA, QDA,
dummies) and what is derived from them are checked against DuckDB; iterative
models and searches are checked by their properties in the tests.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.expressions import key_hash_sql
from ..operators.jobs import side_by_side
from ..session import cut_lineage
from ..sources import files
from .catalog import query
from .experiment import Experiment

LI_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LI_NUMS = ["l_quantity", "l_discount", "l_tax"]
#: values of an embedding, all of them features
EMB_DIMS = 64
EMB_NUMS = [f"e{i}" for i in range(EMB_DIMS)]


# --- helpers --------------------------------------------------------------------------------

def _emb_experiment(t, model: str) -> Experiment:
    e = t("embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}")
                                                    for i in range(EMB_DIMS)])
    exp = Experiment(e, "label", True, key="vec_id", nums=EMB_NUMS, scorer="accuracy", validation_method="test",
                     name="embeddings")
    exp.fit_fixed(model, {})
    return exp


def _li_experiment(t, nums=("l_quantity",), cats=(), name="lineitem", validation="test"):
    li = t("lineitem")
    return Experiment(li, "l_extendedprice", False, key=LI_KEY, nums=list(nums), cats=list(cats), scorer="r2",
                      validation_method=validation, name=name)


def _flag_experiment(t, model: str = "Gaussian Naive Bayes") -> Experiment:
    exp = Experiment(t("lineitem"), "l_returnflag", True, key=LI_KEY, nums=LI_NUMS, scorer="accuracy",
                     validation_method="test", name="flags")
    exp.fit_fixed(model, {})
    return exp


def _length_experiment(t, model: str) -> Experiment:
    d = t("documents").join(t("labels"), "doc_id")
    exp = Experiment(d, "quality", True, key="doc_id", nums=["n_chars"], scorer="accuracy", validation_method="test",
                     name="length")
    exp.fit_fixed(model, {})
    return exp


def _hold(*key: str) -> str:
    return f"({key_hash_sql(*key)} < 0.1 * 4294967296)"


_EMB = f"""SELECT vec_id AS id, vec_id, label AS y, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS arr,
  {_hold('vec_id')} AS hold FROM embeddings"""
_FLAG = f"""SELECT row_number() OVER () AS id, {', '.join(LI_KEY)}, l_returnflag AS y,
  [CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE)] AS arr,
  {_hold(*LI_KEY)} AS hold FROM lineitem"""


def _gnb_sql(base: str, out: str, rows: str = "SELECT id, j, x FROM x") -> str:
    """Gaussian NB fitted on the training rows of ``base``; ``pp`` has each class's probability of every row of ``rows``."""
    return f"""
WITH d AS ({base}),
x AS (SELECT id, y, hold, unnest(range(0, len(arr))) AS j, unnest(arr) AS x FROM d),
m AS (SELECT j, avg(x) AS mu, var_pop(x) AS v FROM x WHERE NOT hold GROUP BY j),
par AS (SELECT y AS c, j, avg(x) AS mu, var_pop(x) + 1e-9 * (SELECT max(v) FROM m) AS v FROM x WHERE NOT hold GROUP BY y, j),
pri AS (SELECT y AS c, ln(count(*) / (SELECT count(*) FROM d WHERE NOT hold)) AS lp FROM d WHERE NOT hold GROUP BY y),
scored AS ({rows}),
term AS (SELECT s.id, s.j, par.c, -0.5 * ln(2 * pi() * par.v) - 0.5 * (s.x - par.mu) ^ 2 / par.v AS t,
                -0.5 * ln(2 * pi() * par.v) - 0.5 * (m.mu - par.mu) ^ 2 / par.v AS blank
         FROM scored s JOIN par USING (j) JOIN m USING (j)),
jll AS (SELECT id, c, sum(t) + any_value(lp) AS s FROM term JOIN pri USING (c) GROUP BY id, c),
pr AS (SELECT *, exp(s - max(s) OVER (PARTITION BY id)) AS ex FROM jll),
pp AS (SELECT id, c, ex / sum(ex) OVER (PARTITION BY id) AS p FROM pr){out}"""


_REASONS = """,
orig AS (SELECT id, arg_max(c, p) AS c0, max(p) AS p0 FROM pp GROUP BY id),
vs AS (SELECT term.id, j, term.c, jll.s - t + blank AS s FROM term JOIN jll ON term.id = jll.id AND term.c = jll.c
       JOIN d ON d.id = term.id WHERE d.hold),
vx AS (SELECT *, exp(s - max(s) OVER (PARTITION BY id, j)) AS ex FROM vs),
vp AS (SELECT id, j, c, ex / sum(ex) OVER (PARTITION BY id, j) AS p FROM vx),
reason AS (SELECT vp.id, j, p0 - p AS diff FROM vp JOIN orig ON vp.id = orig.id AND vp.c = orig.c0)"""


@query("gnb_predictions", _gnb_sql(_EMB, """
SELECT d.vec_id, arg_max(c, p) AS "Prediction", """ + ", ".join(
    f'round(max(CASE WHEN c = {c} THEN p END), 6) AS "Probability {c}"' for c in range(10)) + ", " + ", ".join(
    f"round(any_value(arr)[{i + 1}], 6) AS e{i}" for i in range(EMB_DIMS)) + """
FROM pp JOIN d ON pp.id = d.id WHERE hold GROUP BY d.vec_id"""))
def gnb_predictions(t):
    """K16 + X1-X3: class and 'Probability <class>' columns for the held-out rows, all 64 inputs appended."""
    exp = _emb_experiment(t, "Gaussian Naive Bayes")
    return exp.predictions("Gaussian Naive Bayes", exp.split(False).select("vec_id", *EMB_NUMS), append=True)


@query("prediction_reasons", _gnb_sql(_EMB, _REASONS + """
SELECT id AS vec_id, 'e' || j AS "Feature", round(diff, 6) AS "Difference" FROM reason"""))
def prediction_reasons(t):
    """Probability of the predicted class minus that with one of the 64 features blanked (imputed)."""
    exp = _emb_experiment(t, "Gaussian Naive Bayes")
    return exp.prediction_reasons("Gaussian Naive Bayes", exp.split(False))


@query("dependence_table", _gnb_sql(_EMB, """,
b AS (SELECT min(arr[1]) AS lo, max(arr[1]) AS hi FROM d WHERE NOT hold),
r AS (SELECT CASE WHEN d.y = 3 THEN 1.0 ELSE 0.0 END AS yy, pp.p AS yp,
             least(CAST(floor((d.arr[1] - lo) / ((hi - lo) / 10.0)) AS INTEGER), 9) AS bin
      FROM d JOIN pp ON d.id = pp.id AND pp.c = 3, b WHERE NOT d.hold),
st AS (SELECT bin, count(*) AS n, avg(yy) AS yy, avg(yp) AS yp FROM r GROUP BY bin),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
SELECT round(lo + (bins.bin + 0.5) * ((hi - lo) / 10.0), 6) AS "Category", CAST(coalesce(n, 0) AS BIGINT) AS "Count",
       round(st.yy, 6) AS "Proportion", round(st.yp, 6) AS "Predicted"
FROM bins CROSS JOIN b LEFT JOIN st ON bins.bin = st.bin"""))
def dependence_table(t):
    """Share of class 3 and mean predicted probability in 10 bins of e0 (training rows, 64 features)."""
    exp = _emb_experiment(t, "Gaussian Naive Bayes")
    return exp.dependence_table("e0", "Gaussian Naive Bayes", cat=3, train=True)


_KEYS = ", ".join(f"d.{k}" for k in LI_KEY)


@query("top_reasons", _gnb_sql(_FLAG, _REASONS + f""",
named AS (SELECT {_KEYS}, diff, ['l_quantity', 'l_discount', 'l_tax'][j + 1] AS f FROM reason JOIN d USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(LI_KEY)} ORDER BY abs(diff) DESC, f) AS rank FROM named)
SELECT {', '.join(LI_KEY)}, f AS "Feature", round(diff, 6) AS "Difference", CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= 5"""))
def top_reasons(t):
    """The largest |difference| reasons per held-out row (the table has three numeric features)."""
    exp = _flag_experiment(t)
    return exp.top_reasons("Gaussian Naive Bayes", exp.split(False))


@query("what_if", _gnb_sql(_FLAG, f"""
SELECT {_KEYS}, c AS "Category", round(p, 6) AS "Probability" FROM pp JOIN d USING (id)""", """
  SELECT id, j, CASE WHEN j = 0 THEN x ELSE (SELECT avg(a.x) FROM x a WHERE a.j = x.j) END AS x FROM x WHERE hold"""))
def what_if(t):
    """Held-out rows of which only the quantity is given (defaults fill the rest), class probabilities long form."""
    exp = _flag_experiment(t)
    return exp.what_if("Gaussian Naive Bayes", exp.split(False).select(*LI_KEY, "l_quantity"))


_INDEXED = """,
lab AS (SELECT y AS c, CAST(row_number() OVER (ORDER BY y) - 1 AS DOUBLE) AS k FROM (SELECT DISTINCT y FROM d)),
pred AS (SELECT pp.id, any_value(d.hold) AS hold, any_value(lt.k) AS "true", arg_max(lp.k, p) AS predicted
         FROM pp JOIN d USING (id) JOIN lab lt ON lt.c = d.y JOIN lab lp ON lp.c = pp.c GROUP BY pp.id)"""


@query("model_confusion", _gnb_sql(_FLAG, _INDEXED + """,
n AS (SELECT "true", predicted, count(*) AS n FROM pred WHERE hold GROUP BY ALL),
l AS (SELECT DISTINCT k FROM (SELECT "true" AS k FROM n UNION SELECT predicted FROM n)),
g AS (SELECT a.k AS t, b.k AS p, coalesce(n.n, 0) AS n FROM l a CROSS JOIN l b
      LEFT JOIN n ON n."true" = a.k AND n.predicted = b.k)
SELECT t AS "true", p AS predicted, CAST(n AS BIGINT) AS count,
       round(CASE WHEN sum(n) OVER (PARTITION BY t) > 0 THEN n / sum(n) OVER (PARTITION BY t) END, 6) AS share FROM g"""))
def model_confusion(t):
    """M10 on a fitted model's held-out predictions (three classes)."""
    return _flag_experiment(t).confusion_matrix("Gaussian Naive Bayes", train=False)


@query("model_roc", _gnb_sql(_FLAG, _INDEXED + """,
s AS (SELECT CAST(CAST(lab.k AS INTEGER) AS VARCHAR) AS class, pp.p AS t, d.y = pp.c AS pos
      FROM pp JOIN d USING (id) JOIN lab ON lab.c = pp.c WHERE NOT d.hold),
g AS (SELECT class, t, sum(CASE WHEN pos THEN 1.0 ELSE 0.0 END) AS tp, sum(CASE WHEN pos THEN 0.0 ELSE 1.0 END) AS fp
      FROM s GROUP BY class, t),
c AS (SELECT *, sum(tp) OVER (PARTITION BY class ORDER BY t DESC) AS ctp, sum(fp) OVER (PARTITION BY class ORDER BY t DESC) AS cfp,
             sum(tp) OVER (PARTITION BY class) AS P, sum(fp) OVER (PARTITION BY class) AS N FROM g)
SELECT class, CAST(count(*) AS BIGINT) > 100 AS many, round(sum(fp / N * (2 * ctp - tp) / (2 * P)), 6) AS auc,
       round(max(t), 6) AS top, round(min(t), 6) AS low FROM c GROUP BY class"""))
def model_roc(t):
    """One ROC curve per class (one-vs-rest) on the training rows, each by its area and ends.

    Points themselves are checked by ``roc_curve``: here scores that are equal
    in one engine may differ in the last digit in the other.
    """
    curves = _flag_experiment(t).roc_curves("Gaussian Naive Bayes", train=True)
    return curves.groupBy("class").agg((F.count("*") > 100).alias("many"), F.sum("area").alias("auc"),
                                       F.max("threshold").alias("top"), F.min("threshold").alias("low"))


def _one_feature_sql(score: str, params: str) -> str:
    return f"""
WITH d AS (SELECT d.doc_id, l.quality AS y, CAST(d.n_chars AS DOUBLE) AS x, {_hold('d.doc_id')} AS hold
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
tr AS (SELECT * FROM d WHERE NOT hold),
cls AS (SELECT y AS c, count(*) AS n, avg(x) AS mu, var_pop(x) * count(*) AS ss FROM tr GROUP BY y),
par AS ({params}),
jll AS (SELECT d.doc_id, par.c, {score} AS s FROM d, par WHERE d.hold),
pr AS (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id)) AS ex FROM jll),
pp AS (SELECT doc_id, c, ex / sum(ex) OVER (PARTITION BY doc_id) AS p FROM pr)
SELECT doc_id, arg_max(c, p) AS "Prediction", round(max(p), 6) AS top_probability FROM pp GROUP BY doc_id"""


def _top_prob(exp, model):
    p = exp.predictions(model, exp.split(False).select("doc_id", "n_chars"), append=True)
    return p.select("doc_id", "Prediction",
                    F.greatest(*[F.col(f"`Probability {c}`") for c in exp.classes]).alias("top_probability"))


@query("lda_predictions", _one_feature_sql(
    "d.x * mu / s2 - 0.5 * mu * mu / s2 + ln(prior)",
    "SELECT c, mu, n / (SELECT sum(n) FROM cls) AS prior, "
    "(SELECT sum(ss) FROM cls) / ((SELECT sum(n) FROM cls) - (SELECT count(*) FROM cls)) AS s2 FROM cls"))
def lda_predictions(t):
    """Shared-covariance discriminant of document quality by length."""
    return _top_prob(_length_experiment(t, "Linear Discriminant Analysis"), "Linear Discriminant Analysis")


@query("qda_predictions", _one_feature_sql(
    "-0.5 * ln(v) - 0.5 * (d.x - mu) ^ 2 / v + ln(prior)",
    "SELECT c, mu, n / (SELECT sum(n) FROM cls) AS prior, ss / (n - 1) AS v FROM cls"))
def qda_predictions(t):
    """One covariance per class, document quality by length."""
    return _top_prob(_length_experiment(t, "Quadratic Discriminant Analysis"), "Quadratic Discriminant Analysis")


@query("dummy_classifier", _one_feature_sql(
    "ln(prior)", "SELECT c, n / (SELECT sum(n) FROM cls) AS prior FROM cls"))
def dummy_classifier(t):
    """Class priors from the training rows; the most frequent class."""
    return _top_prob(_length_experiment(t, "Dummy Benchmark"), "Dummy Benchmark")


_LI_HOLD = _hold(*LI_KEY)


@query("linear_predictions", f"""
WITH d AS (SELECT *, {_LI_HOLD} AS hold FROM lineitem),
m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
      FROM d WHERE NOT hold)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(a + b * l_quantity, 4) AS "Prediction" FROM d, m WHERE hold
""")
def linear_predictions(t):
    """Least squares (normal equations) fitted on the training rows, predicted on the holdout."""
    exp = _li_experiment(t)
    exp.fit_fixed("Linear Regression", {"pre__nums__imputer": "mean"})
    p = exp.predictions("Linear Regression", exp.split(False).select(*LI_KEY, "l_quantity"), append=True)
    return p.select(*LI_KEY, F.round("Prediction", 4).alias("Prediction"))


@query("ridge_predictions", f"""
WITH d AS (SELECT *, {_LI_HOLD} AS hold FROM lineitem),
s AS (SELECT count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, sum(l_quantity * l_quantity) AS sxx,
             sum(l_quantity * l_extendedprice) AS sxy FROM d WHERE NOT hold),
m AS (SELECT (sxy - sx * sy / n) / (sxx - sx * sx / n + 5000.0) AS b FROM s),
m2 AS (SELECT b, ((SELECT sy FROM s) - b * (SELECT sx FROM s)) / (SELECT n FROM s) AS a FROM m)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(a + b * l_quantity, 3) AS "Prediction" FROM d, m2 WHERE hold
""")
def ridge_predictions(t):
    """Ridge (alpha 5000, the reference library's sum-of-squares scale), one feature."""
    exp = _li_experiment(t)
    exp.fit_fixed("Ridge Regression", {"pre__nums__imputer": "mean", "mod__alpha": 5000.0})
    p = exp.predictions("Ridge Regression", exp.split(False).select(*LI_KEY, "l_quantity"), append=True)
    return p.select(*LI_KEY, F.round("Prediction", 3).alias("Prediction"))


@query("dummy_regressor", f"""
WITH d AS (SELECT *, {_LI_HOLD} AS hold FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       round((SELECT avg(l_extendedprice) FROM d WHERE NOT hold), 4) AS "Prediction" FROM d WHERE hold
""")
def dummy_regressor(t):
    """The mean of the training target."""
    exp = _li_experiment(t)
    exp.fit_fixed("Dummy Benchmark")
    p = exp.predictions("Dummy Benchmark", exp.split(False).select(*LI_KEY, "l_quantity"), append=True)
    return p.select(*LI_KEY, F.round("Prediction", 4).alias("Prediction"))


# --- search, importances, sinks ------------------------------------------------------------------

def _searched(t, models=("Ridge Regression", "Decision Tree"), trials=5):
    exp = _li_experiment(t, nums=LI_NUMS, cats=("l_returnflag",), name="search")
    for m in models:
        exp.fit_model(m, max_trials=trials)
    return exp


@query("search_trials")
def search_trials(t):
    """H1-H6: five planned trials of two models; one row per trial."""
    return _searched(t).trials_table().drop("seconds", "total_seconds")


@query("training_curve")
def training_curve(t):
    """Best score so far per model."""
    return _searched(t).training_scores().drop("time")


@query("leaderboard")
def leaderboard(t):
    """H9: validation and holdout score, trials and time per model."""
    return _searched(t).leaderboard().drop("total_seconds")


@query("best_parameters")
def best_parameters(t):
    """Parameters of the best trial by stage."""
    return _searched(t).best_parameters()


_CV = f"""
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y, {{fold}} AS fold
           FROM (SELECT *, {_hold(*LI_KEY)} AS hold FROM lineitem) WHERE NOT hold),
k AS (SELECT DISTINCT fold FROM d),
m AS (SELECT k.fold, regr_slope(d.y, d.x) AS b, regr_intercept(d.y, d.x) AS a FROM k JOIN d ON d.fold <> k.fold GROUP BY k.fold),
s AS (SELECT fold, 1 - sum((y - a - b * x) ^ 2) / (var_pop(y) * count(*)) AS r2 FROM d JOIN m USING (fold) GROUP BY fold)
SELECT 'Linear Regression' AS model, round(avg(r2), 6) AS score, round(stddev_pop(r2), 6) AS score_std FROM s"""


def _cv_trial(t, **options):
    exp = Experiment(t("lineitem"), "l_extendedprice", False, key=LI_KEY, nums=["l_quantity"], scorer="r2",
                     name="folds", **options)
    exp.fit_model("Linear Regression", max_trials=1)
    return exp.trials_table().select("model", "score", "score_std")


@query("cv_trial", _CV.format(fold=f"{key_hash_sql(*LI_KEY, salt='fold')} % 5"))
def cv_trial(t):
    """V3/V6: the experiment's own five-fold loop, mean and deviation of a trial's fold scores."""
    return _cv_trial(t, validation_method="cv", validation_size=5)


@query("group_cv_trial", _CV.format(fold="l_returnflag"))
def group_cv_trial(t):
    """V5/V6: the experiment's loop over leave-one-group-out folds."""
    return _cv_trial(t, validation_method="group", groups="l_returnflag")


@query("feature_importance")
def feature_importance(t):
    """Forest importances scaled to a maximum of 1, names nums / col_value."""
    exp = _li_experiment(t, nums=("l_quantity", "l_discount", "l_tax"), cats=("l_returnflag",))
    exp.fit_fixed("Random Forest", {"mod__max_depth": 4, "mod__min_samples_leaf": 5, "pre__nums__imputer": "mean"})
    return exp.feature_importance("Random Forest")


@query("importance_by_variable")
def importance_by_variable(t):
    """Importances summed per source column."""
    exp = _li_experiment(t, nums=("l_quantity", "l_discount", "l_tax"), cats=("l_returnflag",))
    exp.fit_fixed("Random Forest", {"mod__max_depth": 4, "mod__min_samples_leaf": 5, "pre__nums__imputer": "mean"})
    return exp.importance_by_variable("Random Forest")


@query("rbf_features")
def rbf_features(t):
    """random Fourier features of the embedding vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from ..operators.features import RBFFeatures
    e = t("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    out = RBFFeatures(gamma=0.5, nComponents=50).fit(e).transform(e)
    return out.select("vec_id", F.size(vector_to_array("rbf_features")).alias("dims"),
                      F.aggregate(vector_to_array("rbf_features"), F.lit(0.0), lambda a, b: a + b * b).alias("sq"))


_LINE = f"""
WITH d AS (SELECT *, {_LI_HOLD} AS hold FROM lineitem),
m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
      FROM d WHERE NOT hold)"""


@query("prediction_file", _LINE + """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(a + b * l_quantity, 4) AS "Prediction" FROM d, m""")
def prediction_file(t):
    """Predictions written as CSV to the shared folder, then read back as a score file."""
    exp = _li_experiment(t)
    exp.fit_fixed("Linear Regression")
    spark = exp.data.sparkSession
    base = spark.conf.get("spark.checkpoint.dir")
    path = os.path.join(base, f"predictions-{uuid.uuid4().hex}.csv")
    files.write_predictions(exp.predictions("Linear Regression", append=True), path)
    back = files.open_table(spark, path)
    return back.select(*[F.col(k).cast(exp.data.schema[k].dataType).alias(k) for k in LI_KEY],
                       F.round("Prediction", 4).alias("Prediction"))


# --- nearest neighbours (R14, K12) -----------------------------------------------------------------

KNN_SIZES = (1, 5, 20)

_KNN_VOTES = """
g AS (SELECT id, kk.k, kk.weights, y, CASE WHEN kk.weights = 'uniform' THEN 1.0
             WHEN min(d) OVER (PARTITION BY id, kk.k, kk.weights) = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d END AS w
      FROM near JOIN (SELECT unnest([1, 5, 20]) AS k, w AS weights FROM (VALUES ('uniform'), ('distance')) v(w)) kk ON r <= kk.k)"""


@query("knn_regression", f"""
WITH d AS (SELECT c_custkey AS id, c_acctbal AS y, c_nationkey AS n, c_mktsegment AS s,
                  {_hold('c_custkey')} AS hold FROM customer),
p AS (SELECT a.id, b.id AS other, b.y, sqrt((a.n - b.n) ^ 2 + CASE WHEN a.s <> b.s THEN 2 ELSE 0 END) AS d
      FROM d a JOIN d b ON a.hold AND NOT b.hold),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM p QUALIFY r <= 20),{_KNN_VOTES}
SELECT id AS c_custkey, CAST(k AS INTEGER) AS k, weights, round(sum(w * y) / sum(w), 6) AS "Prediction" FROM g GROUP BY ALL""")
def knn_regression(t):
    """Account balance by the nearest customers (nation number, market segment), k = 1, 5, 20, both weightings."""
    exp = Experiment(t("customer"), "c_acctbal", False, key="c_custkey", nums=["c_nationkey"], cats=["c_mktsegment"],
                     scorer="r2", validation_method="test", name="neighbours")
    return _knn_answers(exp, "c_custkey", lambda out: [F.col("prediction").alias("Prediction")])


_EMB_KNN = f"""
WITH d AS ({_EMB}),
p AS (SELECT a.id, b.id AS other, b.y, list_distance(a.arr, b.arr) AS d FROM d a JOIN d b ON a.hold AND NOT b.hold),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM p QUALIFY r <= 20),{_KNN_VOTES},
c AS (SELECT id, k, weights, y, sum(w) AS w FROM g GROUP BY ALL),
f AS (SELECT id, k, weights, w / sum(w) OVER (PARTITION BY id, k, weights) AS p FROM c)
SELECT id AS vec_id, CAST(k AS INTEGER) AS k, weights, round(max(p), 6) AS top_probability FROM f GROUP BY ALL"""


@query("knn_classification", _EMB_KNN)
def knn_classification(t):
    """Label of the nearest vectors (64 features), k = 1, 5, 20, both weightings: share of the winning class."""
    from pyspark.ml.functions import vector_to_array
    e = t("embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}")
                                                    for i in range(EMB_DIMS)])
    exp = Experiment(e, "label", True, key="vec_id", nums=EMB_NUMS, scorer="accuracy", validation_method="test",
                     name="neighbours")
    return _knn_answers(exp, "vec_id", lambda out: [F.array_max(vector_to_array("probability")).alias("top_probability")])


def _knn_answers(exp: Experiment, key: str, columns):
    """One fit, an index for 20 neighbours, and its answers on the holdout for every size and weighting."""
    from ..operators.models.neighbours import WEIGHTINGS
    train = exp.split(True)
    pipe = exp.pipeline("K Nearest Neighbors", {"mod__n_neighbors": max(KNN_SIZES), "mod__weights": "uniform"}, 1.0)
    fitted = pipe.fit(train)
    ready = fitted.stages[0].transform(exp.split(False))
    for stage in fitted.stages[1:-1]:
        ready = stage.transform(ready)
    # the nearest 20 hold the nearest 1 and 5: one search answers every vote
    ready = cut_lineage(fitted.stages[-1].searched(ready.select(key, "features")).drop("features"))
    out = None
    for k in KNN_SIZES:
        for weighting in WEIGHTINGS:
            scored = fitted.stages[-1].voting(k, weighting).transform(ready)
            part = scored.select(key, F.lit(k).alias("k"), F.lit(weighting).alias("weights"), *columns(scored))
            out = part if out is None else out.unionAll(part)
    return out


# --- trees grown here (R8, K6, R13) ------------------------------------------------------------------

def _split_sql(table: str, label: str, hold: str, features: dict[str, str], gain: str, sides: str) -> str:
    """Best first split of the training rows by trying every midpoint of every feature; ``sides`` are a side's sums."""
    long = " UNION ALL ".join(f"SELECT {i} AS j, '{n}' AS f, CAST({e} AS DOUBLE) AS x, {label} AS y FROM d"
                              for i, (n, e) in enumerate(features.items()))
    return f"""
WITH d AS (SELECT * FROM {table} WHERE NOT {hold}),
x AS ({long}),
k AS (SELECT DISTINCT j, f, x FROM x),
t AS (SELECT j, f, (x + lead(x) OVER (PARTITION BY j ORDER BY x)) / 2 AS t FROM k QUALIFY t IS NOT NULL),
s AS (SELECT t.j, t.f, t.t, x.x <= t.t AS l, {sides} FROM t JOIN x USING (j) GROUP BY ALL),
g AS (SELECT j, f, t, {gain} AS gain FROM s GROUP BY j, f, t)
SELECT f AS feature, round(t, 6) AS threshold, round(gain, 4) AS gain FROM g ORDER BY gain DESC, j, t LIMIT 1"""


def _first_split(t, exp: Experiment, params: dict, scale: float = 1.0):
    """(feature, threshold, gain) of the root of a fitted tree of depth 1."""
    fitted = exp.fit_fixed("Decision Tree", {"mod__max_depth": 1, "mod__min_samples_leaf": 1, **params})
    last = fitted.stages[-1]
    tree = last.trees()[0]
    gain = max(last.getModelData()[1]) * scale
    exp.release()
    return exp.data.sparkSession.createDataFrame([(exp.nums[tree.feature[0]], tree.threshold[0], gain)],
                                                 "feature string, threshold double, gain double").withColumn("gain", F.round("gain", 4))


_MOMENTS = "count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS v"


@query("tree_split_mse", _split_sql(
    "lineitem", "l_extendedprice", _hold(*LI_KEY), {"l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "l_tax"},
    "any_value(n) FILTER (l) * any_value(n) FILTER (NOT l) / sum(n) "
    "* (any_value(m) FILTER (l) - any_value(m) FILTER (NOT l)) ^ 2 / 1e9", _MOMENTS))
def tree_split_mse(t):
    """First split by squared error of the training rows, against every midpoint (gain in 1e9)."""
    return _first_split(t, _li_experiment(t, nums=LI_NUMS, name="split"), {"mod__criterion": "mse"}, 1e-9)


@query("tree_split_mae", _split_sql(
    "part", "p_size", _hold("p_partkey"),
    {"brand": "CAST(substr(p_brand, 7) AS INTEGER)", "line": "p_partkey % 16"},
    "(SELECT sum(abs(y - (SELECT median(y) FROM x WHERE j = 0))) FROM x WHERE j = 0) - sum(e)",
    "list_sum(list_transform(list(y), lambda v: abs(v - list_median(list(y))))) AS e"))
def tree_split_mae(t):
    """First split by absolute error around the median (part size by brand number and key remainder)."""
    p = t("part").select("p_partkey", "p_size", F.substring("p_brand", 7, 9).cast("int").alias("brand"),
                         (F.col("p_partkey") % 16).alias("line"))
    exp = Experiment(p, "p_size", False, key="p_partkey", nums=["brand", "line"], scorer="r2", validation_method="test", name="split")
    return _first_split(t, exp, {"mod__criterion": "mae"})


@query("tree_split_gini", f"""
WITH d AS (SELECT o_orderpriority AS y, o_orderkey % 16 AS a, o_custkey % 11 AS b FROM orders WHERE NOT {_hold('o_orderkey')}),
x AS (SELECT 0 AS j, 'a' AS f, a AS x, y FROM d UNION ALL SELECT 1, 'b', b, y FROM d),
k AS (SELECT DISTINCT j, f, x FROM x),
t AS (SELECT j, f, (x + lead(x) OVER (PARTITION BY j ORDER BY x)) / 2 AS t FROM k QUALIFY t IS NOT NULL),
c AS (SELECT t.j, t.f, t.t, x.x <= t.t AS l, y, count(*) AS n FROM t JOIN x USING (j) GROUP BY ALL),
s AS (SELECT j, f, t, l, sum(n) - sum(n * n) / sum(n) AS imp FROM c GROUP BY j, f, t, l),
w AS (SELECT sum(n) - sum(n * n) / sum(n) AS imp FROM (SELECT y, count(*) AS n FROM d GROUP BY y) q),
g AS (SELECT j, f, t, (SELECT imp FROM w) - sum(imp) AS gain FROM s GROUP BY j, f, t)
SELECT f AS feature, round(t, 6) AS threshold, round(gain, 4) AS gain FROM g ORDER BY gain DESC, j, t LIMIT 1""")
def tree_split_gini(t):
    """K6: first split by gini (order priority by two key remainders), against every midpoint."""
    o = t("orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 16).alias("a"), (F.col("o_custkey") % 11).alias("b"))
    exp = Experiment(o, "o_orderpriority", True, key="o_orderkey", nums=["a", "b"], scorer="accuracy", validation_method="test", name="split")
    return _first_split(t, exp, {"mod__criterion": "gini"})


@query("second_order_round", f"""
WITH h AS (SELECT *, {_hold(*LI_KEY)} AS hold FROM lineitem),
d AS (SELECT * FROM h WHERE NOT hold),
m AS (SELECT avg(l_extendedprice) AS m FROM d),
x AS (SELECT l_quantity AS x, l_extendedprice - (SELECT m FROM m) AS r FROM d),
k AS (SELECT DISTINCT x FROM x),
t AS (SELECT (x + lead(x) OVER (ORDER BY x)) / 2 AS t FROM k QUALIFY t IS NOT NULL),
s AS (SELECT t.t, x.x <= t.t AS l, sum(r) AS g, count(*) AS n FROM t JOIN x ON true GROUP BY ALL),
b AS (SELECT t FROM s GROUP BY t ORDER BY sum(g * g / (n + 1)) DESC, t LIMIT 1)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       round((SELECT m FROM m) + 0.5 * (SELECT g / (n + 1) FROM s WHERE s.t = b.t AND s.l = (h.l_quantity <= b.t)), 4) AS "Prediction"
FROM h, b WHERE hold""")
def second_order_round(t):
    """One round of second-order boosting with depth 1, rate 0.5 and an L2 penalty of 1, on the holdout."""
    exp = _li_experiment(t)
    exp.fit_fixed("XGBoost", {"mod__max_depth": 1, "mod__learning_rate": 0.5, "mod__n_estimators": 1})
    p = exp.predictions("XGBoost", exp.split(False).select(*LI_KEY, "l_quantity"), append=True)
    return p.select(*LI_KEY, F.round("Prediction", 4).alias("Prediction"))


# --- every catalogue model, fitted once with middle-of-domain parameters --------------------------

def _middle(domain) -> dict:
    """A fixed point of each domain: the middle of every range, the first category."""
    import math
    out = {}
    for d in domain:
        if d.kind == "categoric":
            out[d.name] = d.bounds[0]
            continue
        mid = sum(d.bounds) / 2
        value = math.exp(mid) if d.kind == "exponential" else int(mid) if d.kind == "integer" else mid
        out[d.name] = (value,) if d.name == "mod__hidden_layer_sizes" else value
    return out


MODELS_AT_ONCE = 8        # models of a zoo whose jobs run together: most of their passes are too narrow to fill a cluster


def _zoo(exp: Experiment):
    """Every model's holdout score beside the benchmark's, for models fitted side by side, each on all training rows."""
    exp.prepared()

    def one(name, spec):
        exp.fit_fixed(name, _middle(spec.domain))
        return name, float(exp.score(exp.fitted[name], exp.split(False)))

    spark = exp.data.sparkSession
    # the catalogue ends with the models of many rounds: begun first, they don't wait for the short ones
    rows = list(side_by_side(spark, [lambda m=m: one(*m) for m in reversed(exp.models.items())], MODELS_AT_ONCE))[::-1]
    exp.release()
    return spark.createDataFrame(rows, "model string, holdout_score double")


@query("regression_models")
def regression_models(t):
    """Every regression model, fitted on lineitem, R^2 on the holdout."""
    return _zoo(_li_experiment(t, nums=LI_NUMS, cats=("l_returnflag",), name="zoo"))


@query("classification_models")
def classification_models(t):
    """Every classification model, on order status (three classes), holdout accuracy."""
    return _zoo(Experiment(t("orders"), "o_orderstatus", True, key="o_orderkey", nums=["o_totalprice"],
                           cats=["o_orderpriority"], scorer="accuracy", validation_method="test", name="zoo"))


SVMS = ("Linear SVM", "Kernel SVM")


@query("svm_classifiers")
def svm_classifiers(t):
    """K4/K5: linear and kernel SVMs with Platt probabilities, binary target (document quality)."""
    d = t("documents").join(t("labels"), "doc_id")
    exp = Experiment(d, "quality", True, key="doc_id", nums=["n_chars"], cats=["lang"], scorer="neg_log_loss",
                     validation_method="test", name="svm")
    exp.models = {k: v for k, v in exp.models.items() if k in SVMS}
    return _zoo(exp)


@query("text_classification_models")
def text_classification_models(t):
    """Text features (tf-idf block) with every text-capable classifier: document quality."""
    d = t("documents").join(t("labels"), "doc_id")
    exp = Experiment(d, "quality", True, key="doc_id", cats=["lang"], text=["text"], scorer="neg_log_loss",
                     validation_method="test", name="text")
    return _zoo(exp)


@query("project_roundtrip", _LINE + """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(a + b * l_quantity, 4) AS "Prediction",
       'saved' AS experiment, CAST(1 AS BIGINT) AS trials FROM d, m WHERE hold""")
def project_roundtrip(t):
    """A project saved (options, trial log, fitted pipelines), loaded back, and used to predict."""
    from .experiment import Project
    project = Project(t("lineitem"), "p")
    exp = project.new_experiment(target="l_extendedprice", classification=False, key=LI_KEY, nums=["l_quantity"],
                                 scorer="r2", validation_method="test", name="saved")
    exp.fit_model("Linear Regression", max_trials=1)
    spark = exp.data.sparkSession
    path = os.path.join(spark.conf.get("spark.checkpoint.dir"), f"project-{uuid.uuid4().hex}")
    project.save(path)
    back = Project.load(t("lineitem"), path).experiments[0]
    out = back.predictions("Linear Regression", back.split(False).select(*LI_KEY, "l_quantity"), append=True)
    return out.select(*LI_KEY, F.round("Prediction", 4).alias("Prediction"), F.lit(back.name).alias("experiment"),
                      F.lit(len(back.trials["Linear Regression"])).cast("bigint").alias("trials"))

"""Registered queries: splits, folds, cross-validation and scoring."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.expressions import key_hash_sql
from ..operators import metrics as M
from ..operators import validation as V
from ..operators.models.closed_form import GaussianNB
from ..operators.models.linear import fit_line, line_fold_models, predict_line
from .catalog import query

LI_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LI_HASH = key_hash_sql(*LI_KEY)


@query("holdout_split", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ({LI_HASH} < 0.1 * 4294967296) AS holdout FROM lineitem
""")
def holdout_split(t):
    """V1: 10 % holdout by key hash (stable under re-runs and re-partitioning)."""
    li = t("lineitem").select(*LI_KEY)
    return li.withColumn("holdout", V.holdout_flag(LI_KEY, 0.1))


@query("train_test_split", f"""
SELECT o_orderkey, CASE WHEN ({key_hash_sql('o_orderkey')} < 0.1 * 4294967296) THEN 'holdout'
  WHEN ({key_hash_sql('o_orderkey', salt='test')} < 0.2 * 4294967296) THEN 'test' ELSE 'train' END AS split
FROM orders
""")
def train_test_split(t):
    """V2: test share 0.2 inside the non-holdout rows (second, salted hash)."""
    o = t("orders").select("o_orderkey")
    train, hold = V.holdout_split(o, "o_orderkey", 0.1)
    tr, te = V.train_test_split(train, "o_orderkey", 0.2)
    return (tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))
              .unionByName(hold.withColumn("split", F.lit("holdout"))))


@query("kfold", f"""
SELECT o_orderkey, CAST({key_hash_sql('o_orderkey', salt='fold')} % 5 AS INTEGER) AS fold FROM orders
""")
def kfold(t):
    """V3: 5 folds from a salted key hash."""
    return V.kfold(t("orders").select("o_orderkey"), "o_orderkey", 5)


@query("stratified_kfold", f"""
WITH h AS (SELECT o_orderkey, o_orderstatus, {key_hash_sql('o_orderkey', salt='fold')} AS h FROM orders)
SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus
       ORDER BY h, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM h
""")
def stratified_kfold(t):
    """V4: per-class round-robin over hash order -- fold sizes within a class differ by <= 1."""
    return V.stratified_kfold(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey",
                              "o_orderstatus", 5)


@query("group_folds", """
SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS fold FROM documents
""")
def group_folds(t):
    """V5: leave-one-group-out folds by document source."""
    return V.group_folds(t("documents").select("doc_id", "source"), "source")


_CV_SQL = f"""
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y,
                  CAST({key_hash_sql(*LI_KEY, salt='fold')} % 5 AS INTEGER) AS fold FROM lineitem),
per AS (SELECT fold, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy
        FROM d GROUP BY fold),
tr AS (SELECT fold, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy,
              sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy FROM per),
m AS (SELECT fold, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM tr),
m2 AS (SELECT m.fold, m.slope, (tr.sy - m.slope * tr.sx) / tr.n AS intercept FROM m JOIN tr USING (fold)),
p AS (SELECT d.fold, d.y, m2.intercept + m2.slope * d.x AS p FROM d JOIN m2 USING (fold)),
s AS (SELECT fold, 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2,
             -avg((y - p) * (y - p)) AS neg_mse FROM p GROUP BY fold)
"""


def _cv_scores(t):
    li = t("lineitem").select(*LI_KEY, F.col("l_quantity").cast("double").alias("x"),
                              F.col("l_extendedprice").alias("y"))
    from ..functions.expressions import key_hash
    folded = li.withColumn("fold", (key_hash(*LI_KEY, salt="fold") % 5).cast("int"))
    models = line_fold_models(folded, "x", "y")
    scored = predict_line(folded, models, "x", "p", on=["fold"])
    return scored.groupBy("fold").agg(M.r2("y", "p").alias("r2"), (-M.mse("y", "p")).alias("neg_mse"))


@query("cv_scores", _CV_SQL + "SELECT fold, round(r2, 6) AS r2, round(neg_mse, 4) AS neg_mse FROM s")
def cv_scores(t):
    """5-fold scores of one-feature least squares from per-fold sufficient statistics."""
    return _cv_scores(t).withColumn("neg_mse", F.round("neg_mse", 4))


@query("cv_summary", _CV_SQL + """SELECT round(avg(r2), 6) AS mean, round(stddev_pop(r2), 6) AS std,
  CAST(count(*) AS BIGINT) AS folds FROM s""")
def cv_summary(t):
    """V6: mean and population std of fold scores."""
    return V.fold_summary(_cv_scores(t), score="r2", seconds=None)


@query("early_rejection", _CV_SQL + """SELECT fold, round(r2, 6) AS score,
  round(avg(r2) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_mean,
  count(*) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 1 AND
  avg(r2) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <
  0.3 - 1.6 * 0.01 / sqrt(count(*) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) AS reject
FROM s""")
def early_rejection(t):
    """V7: where a trial is stopped against a previous best (mean 0.3, std 0.01)."""
    s = _cv_scores(t).select("fold", F.col("r2").alias("score"))
    return V.early_rejection(s, 0.3, 0.01)


_REG_SQL = f"""
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y, l_tax AS w,
                  ({LI_HASH} < 0.1 * 4294967296) AS hold FROM lineitem),
m AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM d WHERE NOT hold),
p AS (SELECT y, w, intercept + slope * x AS p FROM d, m WHERE hold)
"""


@query("regression_metrics", _REG_SQL + """
SELECT round(1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2,
  round(-avg((y - p) * (y - p)), 2) AS neg_mean_squared_error, round(-avg(abs(y - p)), 6) AS neg_mean_absolute_error,
  round(-quantile_cont(abs(y - p), 0.5), 6) AS neg_median_absolute_error,
  round(-avg((ln(1 + y) - ln(1 + p)) * (ln(1 + y) - ln(1 + p))), 6) AS neg_mean_squared_log_error FROM p
""")
def regression_metrics(t):
    """M1-M5 on the holdout: least squares price ~ quantity fitted on the training rows."""
    li = t("lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").alias("y"),
                              V.holdout_flag(LI_KEY, 0.1).alias("hold"))
    model = fit_line(li.where(~F.col("hold")), "x", "y")
    pred = predict_line(li.where("hold"), model, "x", "p")
    return M.regression_scores(pred, "y", "p").withColumn(
        "neg_mean_squared_error", F.round("neg_mean_squared_error", 2))


@query("weighted_regression_metrics", _REG_SQL + """
SELECT round(1 - sum(w * (y - p) * (y - p)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)), 6) AS r2,
  round(-sum(w * (y - p) * (y - p)) / sum(w), 2) AS neg_mse, round(-sum(w * abs(y - p)) / sum(w), 6) AS neg_mae
FROM p
""")
def weighted_regression_metrics(t):
    """C12/M1-M3 with sample weights (tax rate as weight)."""
    li = t("lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").alias("y"),
                              F.col("l_tax").alias("w"), V.holdout_flag(LI_KEY, 0.1).alias("hold"))
    model = fit_line(li.where(~F.col("hold")), "x", "y")
    pred = predict_line(li.where("hold"), model, "x", "p")
    return pred.agg(M.r2("y", "p", "w").alias("r2"), F.round(-M.mse("y", "p", "w"), 2).alias("neg_mse"),
                    (-M.mae("y", "p", "w")).alias("neg_mae"))


# --- classification: Gaussian naive Bayes on document length ---------------------------------

_GNB_SQL = f"""
WITH d AS (SELECT d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS x, CAST(l.quality AS DOUBLE) AS y,
                  ({key_hash_sql('d.doc_id')} < 0.3 * 4294967296) AS hold
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
tot AS (SELECT count(*) AS n, sum(x) / count(*) AS mu, sum(x * x) / count(*) - (sum(x) / count(*)) ^ 2 AS v FROM d WHERE NOT hold),
cls AS (SELECT y AS c, count(*) AS n, sum(x) / count(*) AS mu, sum(x * x) / count(*) - (sum(x) / count(*)) ^ 2 AS v
        FROM d WHERE NOT hold GROUP BY y),
par AS (SELECT c, n / (SELECT n FROM tot) AS prior, mu, greatest(v, 0) + 1e-9 * (SELECT v FROM tot) AS v FROM cls),
jll AS (SELECT d.id, d.x, d.y, d.hold, par.c, ln(prior) - 0.5 * ln(2 * pi() * v) - 0.5 * (d.x - mu) * (d.x - mu) / v AS s
        FROM d, par),
pr AS (SELECT id, x, y, hold, c, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM jll),
pp AS (SELECT id, x, y, hold, c, e / sum(e) OVER (PARTITION BY id) AS p FROM pr),
preds AS (SELECT id, x, y, hold, max(CASE WHEN c = 1 THEN p END) AS p1, max(CASE WHEN c = 0 THEN p END) AS p0
          FROM pp GROUP BY id, x, y, hold),
out AS (SELECT x, y, hold, p1, CASE WHEN p1 > p0 THEN 1.0 ELSE 0.0 END AS pred,
               CASE WHEN y = 1 THEN p1 ELSE p0 END AS p_true FROM preds)
"""


def _gnb_predictions(t):
    d = (t("documents").join(t("labels"), "doc_id")
         .select(F.col("n_chars").cast("double").alias("x"), F.col("quality").cast("double").alias("y"),
                 V.holdout_flag("doc_id", 0.3).alias("hold")))
    feats = VectorAssembler(inputCols=["x"], outputCol="features").transform(d)
    model = GaussianNB(labelCol="y").fit(feats.where(~F.col("hold")))
    out = model.transform(feats).withColumn("prob", vector_to_array("probability"))
    return out.select("x", "y", "hold", F.col("prob")[1].alias("p1"), F.col("prediction").alias("pred"),
                      F.when(F.col("y") == 1, F.col("prob")[1]).otherwise(F.col("prob")[0]).alias("p_true"))


@query("classification_metrics", _GNB_SQL + """
SELECT round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(-avg(-ln(least(greatest(p_true, 1e-15), 1 - 1e-15))), 6) AS neg_log_loss,
  round(2.0 * sum(CASE WHEN y = 1 AND pred = 1 THEN 1.0 ELSE 0.0 END) /
   (2.0 * sum(CASE WHEN y = 1 AND pred = 1 THEN 1.0 ELSE 0.0 END) + sum(CASE WHEN y <> 1 AND pred = 1 THEN 1.0 ELSE 0.0 END)
    + sum(CASE WHEN y = 1 AND pred <> 1 THEN 1.0 ELSE 0.0 END)), 6) AS f1
FROM out WHERE hold
""")
def classification_metrics(t):
    """K16 + M6-M8: Gaussian NB quality ~ length, scored on the held-out documents."""
    p = _gnb_predictions(t).where("hold")
    return p.agg(M.accuracy("y", "pred").alias("accuracy"), (-M.log_loss("p_true")).alias("neg_log_loss"),
                 M.f1("y", "pred").alias("f1"))


@query("nb_roc_auc", _GNB_SQL + """,
g AS (SELECT p1 AS t, sum(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) AS tp, sum(CASE WHEN y = 1 THEN 0.0 ELSE 1.0 END) AS fp
      FROM out WHERE hold GROUP BY p1),
c AS (SELECT t, tp, fp, sum(tp) OVER (ORDER BY t DESC) AS ctp, sum(fp) OVER (ORDER BY t DESC) AS cfp,
             sum(tp) OVER () AS P, sum(fp) OVER () AS N FROM g)
SELECT round(sum(fp / N * (2 * ctp - tp) / (2 * P)), 6) AS roc_auc FROM c
""")
def nb_roc_auc(t):
    """M9: exact AUC of the NB probability on the held-out documents."""
    return M.roc_auc(_gnb_predictions(t).where("hold"), "y", "p1")


@query("confusion_matrix", _GNB_SQL + """,
cl AS (SELECT DISTINCT v FROM (SELECT y AS v FROM out UNION SELECT pred FROM out)),
cnt AS (SELECT y, pred, count(*) AS n FROM out GROUP BY y, pred),
g AS (SELECT a.v AS t, b.v AS p, coalesce(cnt.n, 0) AS n FROM cl a CROSS JOIN cl b
      LEFT JOIN cnt ON cnt.y = a.v AND cnt.pred = b.v)
SELECT t AS "true", p AS predicted, CAST(n AS BIGINT) AS count,
       round(CASE WHEN sum(n) OVER (PARTITION BY t) > 0 THEN n / sum(n) OVER (PARTITION BY t) END, 6) AS share FROM g
""")
def confusion_matrix(t):
    """True x predicted counts and row shares over every labelled document."""
    return M.confusion_matrix(_gnb_predictions(t), "y", "pred")


_ROC_SQL = """
WITH d AS (SELECT CAST(d.n_chars AS DOUBLE) AS s, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT s AS t, sum(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) AS tp, sum(CASE WHEN y = 1 THEN 0.0 ELSE 1.0 END) AS fp
      FROM d GROUP BY s),
c AS (SELECT t, tp, fp, sum(tp) OVER (ORDER BY t DESC) AS ctp, sum(fp) OVER (ORDER BY t DESC) AS cfp,
             sum(tp) OVER () AS P, sum(fp) OVER () AS N FROM g)
"""


@query("roc_curve", _ROC_SQL + """
SELECT round(t, 6) AS threshold, round(ctp, 6) AS tp, round(cfp, 6) AS fp, round(ctp / P, 6) AS tpr,
       round(cfp / N, 6) AS fpr, round(fp / N * (2 * ctp - tp) / (2 * P), 6) AS area FROM c
""")
def roc_curve(t):
    """Exact ROC points of quality scored by document length."""
    d = t("documents").join(t("labels"), "doc_id").select(F.col("n_chars").cast("double").alias("s"), "quality")
    return M.roc_curve(d, F.col("quality") == 1, "s")


@query("roc_auc", _ROC_SQL + "SELECT round(sum(fp / N * (2 * ctp - tp) / (2 * P)), 6) AS roc_auc FROM c")
def roc_auc(t):
    """M9: trapezoid area under the exact ROC curve."""
    d = t("documents").join(t("labels"), "doc_id").select(F.col("n_chars").cast("double").alias("s"), "quality")
    return M.roc_auc(d, F.col("quality") == 1, "s")


# --- preprocessing F3-F9, T7 ----------------------------------------------------------------

def _numeric_block(t, imputer, scaler):
    from ..operators.features import NumericBlock
    from .q_explore import _orders_with_nulls
    o = _orders_with_nulls(t).select("o_orderkey", "o_totalprice", "o_custkey")
    train = o.where(~V.holdout_flag("o_orderkey", 0.1))
    model = NumericBlock(inputCols=["o_totalprice", "o_custkey"], outputCol="v",
                         imputer=imputer, scaler=scaler).fit(train)
    arr = vector_to_array(F.col("v"))
    return model.transform(o).select("o_orderkey", arr[0].alias("price"), arr[1].alias("cust"))


def _numeric_sql(fill: str, center: str, scale: str, scale_guard: bool = True) -> str:
    from .q_explore import ORDERS_NULLS
    hold = f"({key_hash_sql('o_orderkey')} < 0.1 * 4294967296)"
    parts = []
    for c, name in (("o_totalprice", "price"), ("o_custkey", "cust")):
        fill_c = fill.format(c=f"CAST({c} AS DOUBLE)")
        parts.append(f"""f_{name} AS (SELECT {fill_c} AS f FROM src WHERE NOT hold),
s_{name} AS (SELECT {center.format(c=f"coalesce(CAST({c} AS DOUBLE), (SELECT f FROM f_{name}))")} AS a,
                    {scale.format(c=f"coalesce(CAST({c} AS DOUBLE), (SELECT f FROM f_{name}))")} AS b
             FROM src WHERE NOT hold)""")
    cols = []
    for c, name in (("o_totalprice", "price"), ("o_custkey", "cust")):
        b = f"(SELECT CASE WHEN b = 0 OR b IS NULL THEN 1.0 ELSE b END FROM s_{name})"
        cols.append(f"round((coalesce(CAST({c} AS DOUBLE), (SELECT f FROM f_{name})) - (SELECT a FROM s_{name})) / {b}, 6) AS {name}")
    return (f"WITH src AS (SELECT *, {hold} AS hold FROM {ORDERS_NULLS}),\n" + ",\n".join(parts) +
            f"\nSELECT o_orderkey, {', '.join(cols)} FROM src")


@query("scale_standard", _numeric_sql("avg({c})", "avg({c})", "stddev_pop({c})"))
def scale_standard(t):
    """F3 mean imputation then F6 standard scaling (population std), fitted on train rows."""
    return _numeric_block(t, "mean", "Standard")


@query("scale_minmax", _numeric_sql("quantile_cont({c}, 0.5)", "min({c})", "max({c}) - min({c})"))
def scale_minmax(t):
    """F3 median imputation then F4 min-max scaling."""
    return _numeric_block(t, "median", "MinMax")


@query("scale_maxabs", _numeric_sql("avg({c})", "0.0", "max(abs({c}))"))
def scale_maxabs(t):
    """F5 max-abs scaling after mean imputation."""
    return _numeric_block(t, "mean", "MaxAbs")


@query("scale_robust", _numeric_sql("avg({c})", "quantile_cont({c}, 0.5)",
                                    "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def scale_robust(t):
    """F7 robust scaling: (x - median) / IQR (exact percentiles)."""
    return _numeric_block(t, "mean", "Robust")


@query("impute_most_frequent", _numeric_sql(
    "(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM src WHERE NOT hold AND {c} IS NOT NULL GROUP BY v) "
    "ORDER BY n DESC, v LIMIT 1) + min(0.0)", "min(0.0)", "max(1.0)"))
def impute_most_frequent(t):
    """F3 most-frequent imputation (smallest value on ties), no scaling."""
    return _numeric_block(t, "most_frequent", "None")


@query("one_hot", """
WITH tr AS (SELECT DISTINCT coalesce(CAST(o_orderpriority AS VARCHAR), 'nan') AS v FROM orders
            WHERE o_orderpriority <> '5-LOW'),
idx AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM tr)
SELECT o.o_orderkey, coalesce(idx.i, -1) AS hot, CAST((SELECT count(*) FROM tr) AS INTEGER) AS width
FROM orders o LEFT JOIN idx ON coalesce(CAST(o.o_orderpriority AS VARCHAR), 'nan') = idx.v
""")
def one_hot(t):
    """categories from the training rows (one priority never seen): unseen -> all zeros."""
    from pyspark.ml import Pipeline
    from ..operators.features import categoric_stages
    o = t("orders").select("o_orderkey", "o_orderpriority")
    model = Pipeline(stages=categoric_stages(["o_orderpriority"])).fit(o.where(F.col("o_orderpriority") != "5-LOW"))
    arr = vector_to_array(F.col("__ohe_o_orderpriority"))
    return model.transform(o).select("o_orderkey", (F.array_position(arr, 1.0) - 1).cast("int").alias("hot"),
                                     F.size(arr).alias("width"))


@query("tfidf_pipeline", f"""
WITH n AS (SELECT count(*) AS n FROM documents),
tc AS (SELECT doc_id, w AS word, count(*) AS tf FROM (SELECT doc_id, unnest({__import__('quarry.functions.text', fromlist=['x']).tokens_sql('text')}) AS w FROM documents)
       GROUP BY doc_id, w),
v AS (SELECT word, count(*) AS df FROM tc GROUP BY word HAVING count(*) >= 0.005 * (SELECT n FROM n)),
raw AS (SELECT tc.doc_id, tc.word, tc.tf * (ln((1.0 + (SELECT n FROM n)) / (1.0 + v.df)) + 1.0) AS w
        FROM tc JOIN v ON tc.word = v.word)
SELECT doc_id, 'text_' || word AS feature, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw
""")
def tfidf_pipeline(t):
    """The ML text block (tokenise, stop words, minDF vocabulary, smoothed tf-idf, L2)."""
    from ..operators.features import feature_names, preprocessor, sparse_entries
    d = t("documents").select("doc_id", "text")
    model = preprocessor(text=["text"]).fit(d)
    names = F.array(*[F.lit(n) for n, _ in feature_names(model, text=["text"])])
    out = model.transform(d).select("doc_id", sparse_entries("features").alias("e"))
    return out.select("doc_id", F.element_at(names, F.col("e.i") + 1).alias("feature"),
                      F.col("e.value").alias("weight")).where(F.col("weight") != 0)

"""Every registered query against its DuckDB oracle (the driver's correctness gate)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from quarry.session import TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


# what SQL can't state: each query is executed, and its rows are held against what must be true of them
RULES = {
    "search_trials": lambda r: len(r) == 10 and r.groupby("model").point.nunique().eq(5).all() and (r.score <= 1).all(),
    "training_curve": lambda r: (r.run_score <= r.best_score).all() and r.groupby("model").improved.first().all(),
    "leaderboard": lambda r: len(r) == 2 and (r.trials == 5).all() and (r.holdout_score <= 1).all(),
    "best_parameters": lambda r: set(r.stage) <= {"mod", "pre"} and r.value.notna().all(),
    "feature_importance": lambda r: r.Importance.between(0, 1).all() and r.Importance.max() == 1,
    "importance_by_variable": lambda r: set(r.Variable) <= {"l_quantity", "l_discount", "l_tax", "l_returnflag"},
    "rbf_features": lambda r: (r.dims == 50).all() and r.sq.between(0, 2).all(),
    # every model but the linear passive-aggressive one does at least as well as the mean of the target
    "regression_models": lambda r: (r.set_index("model").holdout_score.drop("Passive Aggressive Regression") > -0.05).all(),
    "classification_models": lambda r: (r.holdout_score >= 0.2).all() and (r.holdout_score <= 1).all(),
    # the class shares alone score -0.46 on this holdout: calibrated machines may lose at most 0.05 to them
    "svm_classifiers": lambda r: (r.holdout_score <= 0).all() and (r.holdout_score > -0.51).all(),
    "text_classification_models": lambda r: _beats_shares(r.set_index("model").holdout_score),
}


def _beats_shares(score):
    """Negated log losses against that of the class shares: the margin each model must keep."""
    least = {"Linear SVM": 0.05, "Gradient Boosted Trees": 0.05, "Kernel SVM": 0.005, "Neural Network": 0.01,
             "Ridge Logistic Regression": 0.01, "Decision Tree": -0.05, "Random Forest": -0.05, "Extra Trees Classifier": -0.05}
    return all(score[m] >= score["Dummy Benchmark"] + by for m, by in least.items())


@pytest.mark.parametrize("name", sorted(n for n in set(E.queries()) - set(E.oracle_sql())
                                        if n != "pipeline" and not n.startswith("op")))
def test_query_without_oracle(spark, name):
    rows = E.queries()[name](spark, SF).toPandas()
    assert len(rows) and RULES[name](rows), rows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0

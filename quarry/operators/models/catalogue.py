"""Model catalogues (R1-R16, K1-K19) with their hyper-parameter domains.

A domain dimension is ``(name, kind, bounds)`` with kind ``integer`` /
``float`` / ``exponential`` (value e^u) / ``categoric`` (a list).  Names keep
the reference's ``stage__param`` form.  ``build`` turns decoded parameters
into Spark ML stages; penalties are rescaled to Spark's per-row objective
(ridge alpha and 1/C are sums in the reference library: divide by n).

Deviations, stated once: trees, forests, extremely random trees and second-order
boosting ("XGBoost") are grown here (:mod:`.trees`) with all criteria, minimum
splits, random thresholds and penalties; with a text column, whose features are
thousands, they are Spark's own trees (variance or gini / entropy, no minimum
split, no random thresholds), and second-order boosting is not offered.
"Gradient Boosted Trees" is Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.feature import Binarizer
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)

from ..features import IMPUTERS, SCALERS, RBFFeatures
from .closed_form import (DummyClassifier, DummyRegressor, GaussianNB, LinearDiscriminant,
                          QuadraticDiscriminant)
from . import iterative as it
from .trees import REGRESSION_CRITERIA, SecondOrderBoosting, TreeEnsemble
from .neighbours import WEIGHTINGS, KNeighborsClassifier, KNeighborsRegressor
from .linear import PenalisedLinearRegression
from .network import SoftmaxNetwork
from .online import PassiveAggressiveRegressor


@dataclass(frozen=True)
class Dim:
    name: str
    kind: str
    bounds: tuple


@dataclass
class Context:
    """What a model needs to know about the training data."""
    n: float                      # (weighted) number of training rows
    n_classes: int = 0
    n_features: int = 0
    label: str = "label"
    features: str = "features"
    weight: str = "__w"           # sample weight
    class_weight: str = "__cw"    # sample weight x balanced class weight
    key: tuple = ()               # columns that tell rows apart, for ties


@dataclass
class ModelSpec:
    name: str
    task: str
    domain: list[Dim]
    build: Callable[[dict, Context], list]
    scaled: bool = False          # the numeric block uses the scaler parameter
    tree: bool = False            # exposes feature importances
    extra: dict = field(default_factory=dict)


def _numeric_dims(nums, scaler: bool, most_frequent: bool = False) -> list[Dim]:
    if not nums:
        return []
    imputers = IMPUTERS if most_frequent else IMPUTERS[:2]
    dims = [Dim("pre__nums__imputer", "categoric", tuple(imputers))]
    if scaler:
        dims.append(Dim("pre__nums__scaler", "categoric", SCALERS))
    return dims


def _w(p: dict, ctx: Context) -> str:
    return ctx.class_weight if p.get("mod__class_weight") == "balanced" else ctx.weight


# --- regression ----------------------------------------------------------------------------

def regression_models(nums: Sequence[str] = (), cats: Sequence[str] = (),
                      text: Sequence[str] = ()) -> dict[str, ModelSpec]:
    """R1-R15 (R16 is :func:`regression_benchmark`).  AdaBoost is skipped with text."""
    imp = _numeric_dims(nums, False)
    impsc = _numeric_dims(nums, True)
    knn_dims = [Dim("mod__n_neighbors", "integer", (1, 20)), Dim("mod__weights", "categoric", WEIGHTINGS)]

    def svr(p, c, features):
        # the squared loss with epsilon 0: |w|^2 / 2 + C sum r^2 is ridge with l2 = 1 / (2 C n)
        return PenalisedLinearRegression(featuresCol=features, labelCol=c.label, weightCol=c.weight,
                                         l2=1.0 / (2.0 * p["mod__C"] * c.n))

    models = [
        ModelSpec("Linear Regression", "regression", imp,
                  lambda p, c: [LinearRegression(featuresCol=c.features, labelCol=c.label, weightCol=c.weight,
                                                 regParam=0.0, solver="auto")]),
        ModelSpec("Lasso Regression", "regression", [Dim("mod__alpha", "exponential", (-5, 5))] + impsc,
                  lambda p, c: [PenalisedLinearRegression(featuresCol=c.features, labelCol=c.label,
                                                          weightCol=c.weight, l1=p["mod__alpha"])], scaled=True),
        ModelSpec("Ridge Regression", "regression", [Dim("mod__alpha", "exponential", (-5, 5))] + impsc,
                  lambda p, c: [PenalisedLinearRegression(featuresCol=c.features, labelCol=c.label,
                                                          weightCol=c.weight, l2=p["mod__alpha"] / c.n)],
                  scaled=True),
        ModelSpec("ElasticNet Regression", "regression",
                  [Dim("mod__l1_ratio", "float", (1e-3, 1 - 1e-3)), Dim("mod__alpha", "exponential", (-5, 5))] + impsc,
                  lambda p, c: [PenalisedLinearRegression(
                      featuresCol=c.features, labelCol=c.label, weightCol=c.weight,
                      l1=p["mod__alpha"] * p["mod__l1_ratio"], l2=p["mod__alpha"] * (1 - p["mod__l1_ratio"]))],
                  scaled=True),
        ModelSpec("Passive Aggressive Regression", "regression", [Dim("mod__C", "exponential", (-5, 5))] + impsc,
                  lambda p, c: [PassiveAggressiveRegressor(featuresCol=c.features, labelCol=c.label,
                                                           weightCol=c.weight, C=p["mod__C"])], scaled=True),
        ModelSpec("Linear SVM", "regression", [Dim("mod__C", "exponential", (-5, 5))] + impsc,
                  lambda p, c: [svr(p, c, c.features)], scaled=True),
        ModelSpec("Kernel SVM", "regression",
                  [Dim("krn__gamma", "exponential", (-10, 10)), Dim("krn__n_components", "integer", (10, 200)),
                   Dim("mod__C", "exponential", (-5, 5))] + impsc,
                  lambda p, c: [RBFFeatures(inputCol=c.features, outputCol="__rbf", gamma=p["krn__gamma"],
                                            nComponents=p["krn__n_components"]),
                                svr(p, c, "__rbf")], scaled=True),
    ]
    tree_dims = [Dim("mod__max_depth", "integer", (1, 15)), Dim("mod__min_samples_leaf", "integer", (1, 20))] + imp
    if text:
        models += [
            ModelSpec("Decision Tree", "regression", tree_dims,
                      lambda p, c: [DecisionTreeRegressor(featuresCol=c.features, labelCol=c.label, weightCol=c.weight,
                                                          maxDepth=p["mod__max_depth"],
                                                          minInstancesPerNode=p["mod__min_samples_leaf"], seed=42)],
                      tree=True),
            ModelSpec("Random Forest", "regression", tree_dims,
                      lambda p, c: [RandomForestRegressor(featuresCol=c.features, labelCol=c.label, weightCol=c.weight,
                                                          maxDepth=p["mod__max_depth"], numTrees=10,
                                                          minInstancesPerNode=p["mod__min_samples_leaf"],
                                                          featureSubsetStrategy="all", seed=42)], tree=True),
            ModelSpec("Extra Trees", "regression", tree_dims,
                      lambda p, c: [RandomForestRegressor(featuresCol=c.features, labelCol=c.label, weightCol=c.weight,
                                                          maxDepth=p["mod__max_depth"], numTrees=10, bootstrap=False,
                                                          minInstancesPerNode=p["mod__min_samples_leaf"],
                                                          featureSubsetStrategy="onethird", seed=42)], tree=True),
        ]
    else:
        grown_dims = [Dim("mod__criterion", "categoric", REGRESSION_CRITERIA), *tree_dims[:1],
                      Dim("mod__min_samples_split", "integer", (2, 20)), *tree_dims[1:]]

        def grown(**options):
            return lambda p, c: [TreeEnsemble(
                featuresCol=c.features, labelCol=c.label, weightCol=c.weight, criterion=p.get("mod__criterion", "mse"),
                maxDepth=p["mod__max_depth"], minSplit=p.get("mod__min_samples_split", 2),
                minLeaf=p["mod__min_samples_leaf"], keyCols=c.key, **options)]

        models += [
            ModelSpec("Decision Tree", "regression", grown_dims, grown(), tree=True),
            ModelSpec("Random Forest", "regression", grown_dims, grown(numTrees=10, bootstrap=True), tree=True),
            ModelSpec("Extra Trees", "regression", grown_dims, grown(numTrees=10, randomThresholds=True), tree=True),
            ModelSpec("XGBoost", "regression",
                      [Dim("mod__max_depth", "integer", (1, 5)), Dim("mod__learning_rate", "exponential", (-5, 0)),
                       Dim("mod__n_estimators", "integer", (10, 50))] + imp,
                      lambda p, c: [SecondOrderBoosting(featuresCol=c.features, labelCol=c.label, weightCol=c.weight,
                                                        maxDepth=p["mod__max_depth"], learningRate=p["mod__learning_rate"],
                                                        nEstimators=p["mod__n_estimators"], keyCols=c.key)], tree=True),
        ]
    models.append(
        ModelSpec("Gradient Boosted Trees", "regression",
                  [Dim("mod__max_depth", "integer", (1, 5)), Dim("mod__min_samples_leaf", "integer", (1, 20)),
                   Dim("mod__learning_rate", "exponential", (-5, 0)),
                   Dim("mod__n_estimators", "integer", (10, 50))] + imp,
                  lambda p, c: [GBTRegressor(featuresCol=c.features, labelCol=c.label, weightCol=c.weight,
                                             maxDepth=p["mod__max_depth"], stepSize=p["mod__learning_rate"],
                                             maxIter=p["mod__n_estimators"],
                                             minInstancesPerNode=p["mod__min_samples_leaf"], seed=42)],
                  tree=True))
    if not text:
        models += [
            ModelSpec("AdaBoost", "regression",
                      [Dim("mod__loss", "categoric", ("linear", "square", "exponential")),
                       Dim("mod__learning_rate", "exponential", (-5, 5)),
                       Dim("mod__n_estimators", "integer", (10, 50))] + imp,
                      lambda p, c: [it.AdaBoostRegressor(featuresCol=c.features, labelCol=c.label,
                                                         weightCol=c.weight, loss=p["mod__loss"],
                                                         learningRate=p["mod__learning_rate"],
                                                         nEstimators=p["mod__n_estimators"], keyCols=c.key)]),
        ]
    models += [
        ModelSpec("K Nearest Neighbors", "regression", knn_dims + impsc,
                  lambda p, c: [KNeighborsRegressor(featuresCol=c.features, labelCol=c.label, keyCols=c.key,
                                                    nNeighbors=p["mod__n_neighbors"], weighting=p["mod__weights"])],
                  scaled=True),
        ModelSpec("Neural Network", "regression",
                  [Dim("mod__alpha", "exponential", (-10, 10)),
                   Dim("mod__hidden_layer_sizes", "integer", (5, 50))] + impsc,
                  lambda p, c: [it.MLPRegressor(featuresCol=c.features, labelCol=c.label, weightCol=c.weight,
                                                alpha=p["mod__alpha"], hidden=p["mod__hidden_layer_sizes"][0])],
                  scaled=True),
    ]
    return {m.name: m for m in models}


def regression_benchmark() -> ModelSpec:
    """Mean of the target (defined in the reference, called by nothing)."""
    return ModelSpec("Dummy Benchmark", "regression", [],
                     lambda p, c: [DummyRegressor(featuresCol=c.features, labelCol=c.label, weightCol=c.weight)])


# --- classification -----------------------------------------------------------------------

def classification_models(nums: Sequence[str] = (), cats: Sequence[str] = (), text: Sequence[str] = (),
                          n_classes: int = 2) -> dict[str, ModelSpec]:
    """K1-K18 (K19 is :func:`classification_benchmark`)."""
    imp = _numeric_dims(nums, False)
    impsc = _numeric_dims(nums, True)
    knn_dims = [Dim("mod__n_neighbors", "integer", (1, 20)), Dim("mod__weights", "categoric", WEIGHTINGS)]
    cw = Dim("mod__class_weight", "categoric", (None, "balanced"))

    def logistic(p, c, l1):
        if l1 is None:
            return [LogisticRegression(featuresCol=c.features, labelCol=c.label, weightCol=_w(p, c), regParam=0.0)]
        return [LogisticRegression(featuresCol=c.features, labelCol=c.label, weightCol=_w(p, c),
                                   regParam=1.0 / (p["mod__C"] * c.n), elasticNetParam=l1,
                                   standardization=False)]

    def svm(p, c, features):
        return [it.ProbabilisticLinearSVC(featuresCol=features, labelCol=c.label, weightCol=_w(p, c),
                                          regParam=1.0 / (p["mod__C"] * c.n), numClasses=c.n_classes)]

    models = [
        ModelSpec("Logistic Regression", "classification", [cw] + imp, lambda p, c: logistic(p, c, None)),
        ModelSpec("Lasso Logistic Regression", "classification",
                  [Dim("mod__C", "exponential", (-10, 10)), cw] + impsc, lambda p, c: logistic(p, c, 1.0), scaled=True),
        ModelSpec("Ridge Logistic Regression", "classification",
                  [Dim("mod__C", "exponential", (-10, 10)), cw] + impsc, lambda p, c: logistic(p, c, 0.0), scaled=True),
        ModelSpec("Linear SVM", "classification", [Dim("mod__C", "exponential", (-10, 10)), cw] + impsc,
                  lambda p, c: svm(p, c, c.features), scaled=True),
        ModelSpec("Kernel SVM", "classification",
                  [Dim("krn__gamma", "exponential", (-10, 10)), Dim("krn__n_components", "integer", (5, 200)),
                   Dim("mod__C", "exponential", (-10, 10)), cw] + impsc,
                  lambda p, c: [RBFFeatures(inputCol=c.features, outputCol="__rbf", gamma=p["krn__gamma"],
                                            nComponents=p["krn__n_components"])] + svm(p, c, "__rbf"),
                  scaled=True),
    ]
    tree_dims = [Dim("mod__criterion", "categoric", ("gini", "entropy")), Dim("mod__max_depth", "integer", (1, 20)),
                 Dim("mod__min_samples_leaf", "integer", (1, 20)), cw] + imp

    def forest(p, c, bootstrap):
        return [RandomForestClassifier(featuresCol=c.features, labelCol=c.label, weightCol=_w(p, c),
                                       impurity=p["mod__criterion"], maxDepth=p["mod__max_depth"], numTrees=10,
                                       minInstancesPerNode=p["mod__min_samples_leaf"], bootstrap=bootstrap,
                                       featureSubsetStrategy="sqrt", seed=42)]

    if text:
        models += [
            ModelSpec("Decision Tree", "classification", tree_dims,
                      lambda p, c: [DecisionTreeClassifier(featuresCol=c.features, labelCol=c.label, weightCol=_w(p, c),
                                                           impurity=p["mod__criterion"], maxDepth=p["mod__max_depth"],
                                                           minInstancesPerNode=p["mod__min_samples_leaf"], seed=42)],
                      tree=True),
            ModelSpec("Random Forest", "classification", tree_dims, lambda p, c: forest(p, c, True), tree=True),
            ModelSpec("Extra Trees Classifier", "classification", tree_dims, lambda p, c: forest(p, c, False), tree=True),
        ]
    else:
        grown_dims = [*tree_dims[:2], Dim("mod__min_samples_split", "integer", (2, 20)), *tree_dims[2:]]

        def grown(**options):
            return lambda p, c: [TreeEnsemble(
                featuresCol=c.features, labelCol=c.label, weightCol=_w(p, c), criterion=p["mod__criterion"],
                maxDepth=p["mod__max_depth"], minSplit=p.get("mod__min_samples_split", 2), minLeaf=p["mod__min_samples_leaf"],
                numClasses=c.n_classes, keyCols=c.key, **options)]

        models += [
            ModelSpec("Decision Tree", "classification", grown_dims, grown(), tree=True),
            ModelSpec("Random Forest", "classification", grown_dims,
                      grown(numTrees=10, bootstrap=True, featureSubset="sqrt"), tree=True),
            ModelSpec("Extra Trees Classifier", "classification", grown_dims,
                      grown(numTrees=10, randomThresholds=True, featureSubset="sqrt"), tree=True),
            ModelSpec("XGBoost", "classification",
                      [Dim("mod__n_estimators", "integer", (10, 50)), Dim("mod__max_depth", "integer", (1, 5)),
                       Dim("mod__learning_rate", "exponential", (-5, 0)), Dim("mod__reg_alpha", "exponential", (-10, 10)),
                       Dim("mod__reg_lambda", "exponential", (-10, 10))] + imp,
                      lambda p, c: [SecondOrderBoosting(featuresCol=c.features, labelCol=c.label, weightCol=c.weight,
                                                        maxDepth=p["mod__max_depth"], learningRate=p["mod__learning_rate"],
                                                        nEstimators=p["mod__n_estimators"], regAlpha=p["mod__reg_alpha"],
                                                        regLambda=p["mod__reg_lambda"], numClasses=max(2, c.n_classes),
                                                        keyCols=c.key)], tree=True),
        ]

    def gbt(p, c):
        base = GBTClassifier(featuresCol=c.features, labelCol=c.label, weightCol=c.weight,
                             maxDepth=p["mod__max_depth"], stepSize=p["mod__learning_rate"],
                             maxIter=p["mod__n_estimators"],
                             minInstancesPerNode=p.get("mod__min_samples_leaf", 1), seed=42)
        if c.n_classes <= 2:
            return [base]
        return [it.OneVsRestProbabilistic(classifier=base, featuresCol=c.features, labelCol=c.label,
                                          numClasses=c.n_classes)]

    models.append(
        ModelSpec("Gradient Boosted Trees", "classification",
                  [Dim("mod__n_estimators", "integer", (10, 50)), Dim("mod__max_depth", "integer", (1, 5)),
                   Dim("mod__min_samples_leaf", "integer", (1, 20)),
                   Dim("mod__learning_rate", "exponential", (-5, 0))] + imp, gbt, tree=True))
    if not text:
        models += [
            ModelSpec("AdaBoost", "classification",
                      [Dim("mod__n_estimators", "integer", (10, 50)),
                       Dim("mod__learning_rate", "exponential", (-5, 5))] + imp,
                      lambda p, c: [it.AdaBoostClassifier(featuresCol=c.features, labelCol=c.label,
                                                          weightCol=c.weight, learningRate=p["mod__learning_rate"],
                                                          nEstimators=p["mod__n_estimators"],
                                                          numClasses=c.n_classes)]),
        ]
    models += [
        ModelSpec("K Nearest Neighbors", "classification", knn_dims + impsc,
                  lambda p, c: [KNeighborsClassifier(featuresCol=c.features, labelCol=c.label, keyCols=c.key,
                                                     nNeighbors=p["mod__n_neighbors"], weighting=p["mod__weights"],
                                                     numClasses=c.n_classes)], scaled=True),
        ModelSpec("Neural Network", "classification",
                  [Dim("mod__alpha", "exponential", (-10, 10)),
                   Dim("mod__hidden_layer_sizes", "integer", (5, 50))] + impsc,
                  lambda p, c: [SoftmaxNetwork(featuresCol=c.features, labelCol=c.label, weightCol=c.weight,
                                               alpha=p["mod__alpha"], hidden=p["mod__hidden_layer_sizes"][0],
                                               numClasses=c.n_classes)], scaled=True),
        ModelSpec("Bernoulli Naive Bayes", "classification", impsc,
                  lambda p, c: [Binarizer(inputCol=c.features, outputCol="__bin", threshold=0.0),
                                NaiveBayes(featuresCol="__bin", labelCol=c.label, weightCol=c.weight,
                                           modelType="bernoulli", smoothing=1.0)], scaled=True),
    ]
    if not nums:
        models.append(ModelSpec("Multinomial Naive Bayes", "classification", [],
                                lambda p, c: [NaiveBayes(featuresCol=c.features, labelCol=c.label, weightCol=c.weight,
                                                         modelType="multinomial", smoothing=1.0)]))
    if not text:
        models += [
            ModelSpec("Gaussian Naive Bayes", "classification", impsc,
                      lambda p, c: [GaussianNB(featuresCol=c.features, labelCol=c.label, weightCol=c.weight)],
                      scaled=True),
            ModelSpec("Linear Discriminant Analysis", "classification", impsc,
                      lambda p, c: [LinearDiscriminant(featuresCol=c.features, labelCol=c.label,
                                                       weightCol=c.weight)], scaled=True),
            ModelSpec("Quadratic Discriminant Analysis", "classification", _numeric_dims(nums, True, True),
                      lambda p, c: [QuadraticDiscriminant(featuresCol=c.features, labelCol=c.label,
                                                          weightCol=c.weight)], scaled=True),
        ]
    return {m.name: m for m in models}


def classification_benchmark() -> ModelSpec:
    """Class priors (defined in the reference, called by nothing)."""
    return ModelSpec("Dummy Benchmark", "classification", [],
                     lambda p, c: [DummyClassifier(featuresCol=c.features, labelCol=c.label, weightCol=c.weight)])

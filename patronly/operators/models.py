"""Churn models and clusterings on Spark ML, with tables describing them."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .boosting import PenalisedModel, fit_penalised
from .features import (
    class_weights, drop_incomplete, log_robust, one_hot_drop_first, standard_scale,
    stratified_folds,
)
from .metrics import roc_auc


def assembled(df: DataFrame, features, column: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=column).transform(df)


# ---------------------------------------------------------------- principal components
def _variance_table(spark, ratios, share: float) -> DataFrame:
    rows, total = [], 0.0
    for i, ratio in enumerate(ratios):
        rows.append((i + 1, float(ratio), float(total + ratio), bool(total < share)))
        total += ratio
    return spark.createDataFrame(rows, "Component int, Ratio double, Cumulative double, Kept boolean")


def _project(df: DataFrame, features, k: int):
    return PCA(k=k, inputCol="features", outputCol="_pc").fit(assembled(df, features))


def pca_by_variance(df: DataFrame, features, share: float = 0.95):
    """Standardise, then keep the leading components that reach ``share`` of the variance.

    Returns (rows with PC1..PCm added, variance table of all components).
    """
    features = list(features)
    scaled = standard_scale(drop_incomplete(df, features), features)
    model = _project(scaled, features, len(features))
    ratios = list(model.explainedVariance.toArray())
    table = _variance_table(df.sparkSession, ratios, share)
    kept, total = 0, 0.0
    while kept < len(ratios) and total < share:
        total += ratios[kept]
        kept += 1
    values = model.transform(assembled(scaled, features)).withColumn("_pc", vector_to_array("_pc"))
    scored = values.withColumns({f"PC{i + 1}": F.col("_pc")[i] for i in range(kept)})
    return scored.drop("_pc", "features"), table


def pca_mixed(df: DataFrame, numeric, categorical, k: int = 5):
    """Components of scaled numerics with one-hot categories.

    Returns (loadings in long form, variance table of the k components).
    """
    rows = standard_scale(drop_incomplete(df, [*numeric, *categorical]).select(*numeric, *categorical), numeric)
    encoded = one_hot_drop_first(rows, categorical)
    features = encoded.columns
    k = min(k, len(features))
    model = _project(encoded, features, k)
    weights = model.pc.toArray()
    loadings = df.sparkSession.createDataFrame(
        [(f"PC{j + 1}", f, float(weights[i, j])) for i, f in enumerate(features) for j in range(k)],
        "Component string, Feature string, Loading double")
    return loadings, _variance_table(df.sparkSession, model.explainedVariance.toArray(), 2.0)


def top_loadings(loadings: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` features with the largest weight in each component (a table of
    components x features rows)."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("Component").orderBy(F.desc(F.abs("Loading")), "Feature"))
    return loadings.withColumn("Rank", rank).filter(F.col("Rank") <= n)


# ---------------------------------------------------------------- clusters
def fit_kmeans(df: DataFrame, features, k: int, seed: int = 42):
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="Cluster").fit(
        assembled(df, features))


def kmeans(df: DataFrame, features, k: int, seed: int = 42) -> DataFrame:
    """Adds Cluster: index of the nearest of ``k`` centres."""
    model = fit_kmeans(df, features, k, seed)
    return model.transform(assembled(df, features)).drop("features")


def kmeans_masked(df: DataFrame, features, k: int = 3, label: str = "LikelyChurned",
                  seed: int = 42):
    """Scale on everybody, cluster only the customers who have not churned.

    Returns (clustered rows, the whole scaled population).
    """
    population = log_robust(df, features)
    return kmeans(population.filter(~F.col(label)), features, k, seed), population


# ---------------------------------------------------------------- trees
def _labelled(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("label", F.col(label).cast("double"))


def decision_tree(df: DataFrame, features, label: str, depth: int = 4, min_leaf: int = 20,
                  seed: int = 42):
    """Fit a tree to a true/false label; returns (model, rows with LeafID and Predicted).

    The tree is a regression on 0 and 1: for two classes the variance gives the same splits
    as the Gini impurity, and leaves keep their shares, where a classification tree would
    merge sibling leaves that predict the same class.
    """
    rows = assembled(_labelled(df, label), features)
    model = DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed,
                                  leafCol="LeafID").fit(rows)
    scored = model.transform(rows).withColumns({
        "LeafID": F.col("LeafID").cast("int"), "Predicted": (F.col("prediction") > 0.5).cast("int")})
    return model, scored.drop("features", "label", "prediction")


def explain_clusters_tree(df: DataFrame, features, cluster: str = "Cluster", depth: int = 3, seed: int = 42):
    """A shallow tree that predicts the cluster from the features: (model, rows with LeafID
    and Predicted). Sibling leaves that predict the same cluster are one leaf."""
    rows = assembled(_labelled(df, cluster), features)
    model = DecisionTreeClassifier(maxDepth=depth, seed=seed, leafCol="LeafID").fit(rows)
    scored = model.transform(rows).withColumns({
        "LeafID": F.col("LeafID").cast("int"), "Predicted": F.col("prediction").cast("int")})
    return model, scored.drop("features", "label", "rawPrediction", "probability", "prediction")


# ---------------------------------------------------------------- boosting
def boosted_churn(train: DataFrame, features, label: str, weight: str | None = "Weight",
                  depth: int = 6, trees: int = 100, rate: float = 0.3, seed: int = 42, **params):
    """Boosted trees, optionally class-weighted."""
    if weight:
        params["weightCol"] = weight
    rows = assembled(_labelled(train, label), features)
    return GBTClassifier(maxDepth=depth, maxIter=trees, stepSize=rate, seed=seed, **params).fit(rows)


def boosted_regularised(train: DataFrame, features, label: str, trees: int = 100, seed: int = 42, **params) -> PenalisedModel:
    """Shallow trees on 80 % of the rows and 80 % of the features each, with L1 and L2
    penalties on leaf weights."""
    return fit_penalised(train, features, label, trees=trees, depth=4, rate=0.1, l1=1.0, l2=1.0,
                         row_share=0.8, column_share=0.8, seed=seed, **params)


def boosted_in_sample(df: DataFrame, features, label: str, trees: int = 100, seed: int = 42):
    """Boosting scored on its own training rows: (model, scored rows)."""
    model = boosted_churn(df, features, label, weight=None, depth=3, trees=trees, rate=0.1, seed=seed)
    return model, score(model, df, features, label)


def score(model, df: DataFrame, features, label: str) -> DataFrame:
    """Adds label (0/1), score (probability of 1) and margin (raw score of 1)."""
    if isinstance(model, PenalisedModel):
        return model.score(df, label)
    scored = model.transform(assembled(_labelled(df, label), features))
    return scored.withColumns({
        "score": vector_to_array("probability")[1], "margin": vector_to_array("rawPrediction")[1],
        "label": F.col("label").cast("int"),
    }).drop("features", "rawPrediction", "probability", "prediction")


def feature_importance(model, features, spark, top: int = 15) -> DataFrame:
    """Importance per feature, largest first."""
    values = model.importances() if isinstance(model, PenalisedModel) else model.featureImportances.toArray()
    rows = sorted(((f, float(v)) for f, v in zip(features, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows[:top], "Feature string, Importance double")


def cross_validate(df: DataFrame, features, label: str, k: int = 5, fit=None,
                   seed: int = 42, key: str = "CustomerId", **params) -> DataFrame:
    """Fold, AUC, Rows and Positives of each of ``k`` held-out folds, and the mean AUC over
    all rows as fold -1. The folds are stored once; their models (``boosted_regularised``, if
    no ``fit`` is given) are independent and are fitted at the same time, each on its share of
    the cores, which fills a cluster better than one small job after another."""
    fit = fit or partial(boosted_regularised, share=1 / k)
    folds = materialize(stratified_folds(df, label, k, seed, key))
    sizes = {r["Fold"]: (r["n"], r["p"]) for r in folds.groupBy("Fold").agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("p")).collect()}

    def held_out(fold: int) -> tuple:
        model = fit(folds.filter(F.col("Fold") != fold), features, label, **params)
        auc = roc_auc(score(model, folds.filter(F.col("Fold") == fold), features, label)).first()[0]
        return (fold, auc, *sizes.get(fold, (0, 0)))

    with ThreadPoolExecutor(k) as pool:
        rows = list(pool.map(inheritable_thread_target(df.sparkSession)(held_out), range(k)))
    known = [r[1] for r in rows if r[1] is not None]
    rows.append((-1, sum(known) / len(known) if known else None, sum(r[2] for r in rows), sum(r[3] for r in rows)))
    return df.sparkSession.createDataFrame(rows, "Fold int, AUC double, Rows long, Positives long")


# ---------------------------------------------------------------- logistic
def logistic_churn(df: DataFrame, features, label: str, balanced: bool = True):
    """Logistic regression with unit L2 strength on the summed loss.

    The estimator averages the loss, hence the 1 / total-weight penalty.
    """
    rows = class_weights(df, label, "balanced") if balanced else df.withColumn("Weight", F.lit(1.0))
    total = rows.agg(F.sum("Weight")).first()[0]
    return LogisticRegression(
        weightCol="Weight", regParam=1.0 / total, elasticNetParam=0.0, standardization=False,
        maxIter=1000, tol=1e-9,
    ).fit(assembled(_labelled(rows, label), features))


def odds_table(model, features, spark) -> DataFrame:
    """Coefficient and odds ratio per feature, strongest churn effect first."""
    rows = sorted(((f, float(c), math.exp(c)) for f, c in zip(features, model.coefficients.toArray())),
                  key=lambda r: -r[1])
    return spark.createDataFrame(rows, "Feature string, Coefficient double, OddsRatio double")

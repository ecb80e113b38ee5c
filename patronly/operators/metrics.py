"""Classifier evaluation as aggregates over (label, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.quantiles import running_totals


def threshold_predict(df: DataFrame, threshold: float = 0.45, score: str = "score") -> DataFrame:
    """Adds prediction: 1 above the threshold."""
    return df.withColumn("prediction", (F.col(score) > threshold).cast("int"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The four cells, empty ones included."""
    cell = lambda a, p: F.struct(
        F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
        F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias("n"))
    cells = df.agg(F.array(*[cell(a, p) for a in (0, 1) for p in (0, 1)]).alias("cells"))
    return cells.select(F.explode("cells").alias("c")).select("c.*")


def classification_report(df: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Precision, recall, f1 and support per class, accuracy, macro and weighted means."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    is_, said = F.col(label), F.col(prediction)
    counts = df.agg(*[
        c.alias(n) for k in (0, 1) for n, c in {
            f"hit{k}": F.count_if((is_ == k) & (said == k)), f"said{k}": F.count_if(said == k),
            f"true{k}": F.count_if(is_ == k)}.items()])
    col = F.col
    for k in (0, 1):
        counts = counts.withColumn(f"p{k}", ratio(col(f"hit{k}"), col(f"said{k}")))
        counts = counts.withColumn(f"r{k}", ratio(col(f"hit{k}"), col(f"true{k}")))
        counts = counts.withColumn(
            f"f{k}", ratio(2 * col(f"p{k}") * col(f"r{k}"), col(f"p{k}") + col(f"r{k}")))
    total = col("true0") + col("true1")
    accuracy = ratio(col("hit0") + col("hit1"), total)
    macro = [(col(f"{m}0") + col(f"{m}1")) / 2 for m in "prf"]
    weighted = [ratio(col(f"{m}0") * col("true0") + col(f"{m}1") * col("true1"), total) for m in "prf"]
    line = lambda name, p, r, f, n: F.struct(
        F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
        n.cast("bigint").alias("support"))
    lines = [line(str(k), col(f"p{k}"), col(f"r{k}"), col(f"f{k}"), col(f"true{k}")) for k in (0, 1)]
    lines += [line("accuracy", accuracy, accuracy, accuracy, total),
              line("macro avg", *macro, total), line("weighted avg", *weighted, total)]
    return counts.select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve; tied scores count half."""
    ranked = running_totals(_by_score(df, label, score), "score", ["neg"])
    below = F.col("Upto_neg") - F.col("neg") / 2
    won = F.sum(F.col("pos") * below)
    return ranked.agg(F.try_divide(
        won, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Precision and recall when predicting positive from each distinct score up."""
    scores = _by_score(df, label, score)
    ranked = running_totals(scores, "score", ["pos", "neg"], descending=True)
    positives = scores.agg(F.sum("pos")).first()[0] or 0
    hits = F.col("Upto_pos").cast("double")
    return ranked.select(
        F.col("score").alias("threshold"),
        F.try_divide(hits, hits + F.col("Upto_neg")).alias("precision"),
        F.try_divide(hits, F.lit(float(positives))).alias("recall"))

"""Classification metrics, threshold choice and paired comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ordered import running_totals
from millrace.functions.scalars import log_loss_term

CELLS = ("true_positive", "false_positive", "true_negative", "false_negative")


def confusion(df: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """Counts of the four cells, one scan."""
    cases = {"true_positive": (1, 1), "false_positive": (0, 1), "true_negative": (0, 0), "false_negative": (1, 0)}
    counts = [F.count(F.when((truth == t) & (predicted == p), 1)).alias(name) for name, (t, p) in cases.items()]
    return (df.groupBy(*by) if by else df).agg(*counts)


def metrics(counts: DataFrame) -> DataFrame:
    """Metrics of confusion counts; null where a class is absent, precision 0 without positives predicted."""
    tp, fp, tn, fn = (F.col(c) for c in CELLS)
    recall, specificity = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    f1 = F.when(tp + fn > 0, F.try_divide(2 * tp, 2 * tp + fp + fn))
    return counts.select(
        "*",
        F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        specificity.alias("specificity"),
        f1.alias("f1"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
    )


def tied_counts(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """``threshold, tp, predicted``: cumulated by descending score, ties together."""
    tied = df.groupBy(score.alias("threshold")).agg(F.sum(truth).cast("long").alias("y"), F.count("*").alias("n"))
    return running_totals(tied, [F.col("threshold").desc()], {"tp": "y", "predicted": "n"})


def precision_recall_curve(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """``threshold, precision, recall`` at each distinct score."""
    positives = df.agg(F.sum(truth)).first()[0] or 0
    curve = tied_counts(df, truth, score)
    return curve.select("threshold", (F.col("tp") / F.col("predicted")).alias("precision"), F.try_divide("tp", F.lit(positives)).alias("recall"))


def average_precision(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """Stepwise area: each tie's share of the positives at its precision."""
    step = tied_counts(df, truth, score)
    return step.agg(F.try_divide(F.sum(F.col("y") * F.col("tp") / F.col("predicted")), F.sum("y")).alias("average_precision"))


def best_f1_threshold(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """``threshold, none_positive, f1, accuracy`` of the best choice.

    Predicting nobody competes too. Ties in F1 go to accuracy, then to the
    highest threshold.
    """
    total, positives = df.agg(F.count("*"), F.coalesce(F.sum(truth), F.lit(0))).first()
    steps = tied_counts(df, truth, score).select(F.col("threshold").cast("double"), F.lit(False).alias("none_positive"), "tp", "predicted")
    nobody = df.sparkSession.createDataFrame([(None, True, 0, 0)], "threshold double, none_positive boolean, tp long, predicted long")
    tp, fp = F.col("tp"), F.col("predicted") - F.col("tp")
    f1 = F.coalesce(F.try_divide(2 * tp, tp + fp + F.lit(positives)), F.lit(0.0))
    accuracy = F.try_divide(tp + (F.lit(total - positives) - fp), F.lit(total))
    ranked = steps.unionByName(nobody).select("threshold", "none_positive", f1.alias("f1"), accuracy.alias("accuracy"))
    return ranked.orderBy(F.round("f1", 15).desc(), F.desc("accuracy"), F.desc("none_positive"), F.desc("threshold")).limit(1)


def log_loss(df: DataFrame, truth: Column, probability: Column) -> DataFrame:
    return df.agg(F.avg(log_loss_term(truth, probability)).alias("log_loss"))


def cross_fit_thresholds(df: DataFrame, truth: Column, score: Column, fold: str, folds: int) -> DataFrame:
    """Per fold, the best threshold of all other folds applied to it."""
    parts = []
    for k in range(folds):
        choice = best_f1_threshold(df.where(F.col(fold) != k), truth, score).select(F.col("threshold").alias("chosen"))
        own = df.where(F.col(fold) == k).crossJoin(F.broadcast(choice))  # one row
        predicted = F.coalesce((score >= F.col("chosen")).cast("int"), F.lit(0))
        counted = metrics(confusion(own.withColumn("__p", predicted), truth, F.col("__p"), ["chosen"]))
        parts.append(counted.select(F.lit(k).alias("fold"), F.col("chosen").alias("threshold"), "f1", "accuracy"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_thresholds(df: DataFrame, truth: Column, score: Column, fold: str, folds: int) -> DataFrame:
    """Per fold, its own best threshold: how stable the choice is."""
    parts = [best_f1_threshold(df.where(F.col(fold) == k), truth, score).withColumn("fold", F.lit(k)) for k in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("fold", "threshold", "f1", "accuracy")


def paired(left: DataFrame, right: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    """``key, truth, before, after`` of two studies; both must have the same rows and labels."""
    a = left.select(key, F.col(truth).alias("truth"), F.col(predicted).alias("before"))
    b = right.select(key, F.col(truth).alias("__truth"), F.col(predicted).alias("after"))
    both = a.join(b, key, "full_outer")
    if not both.where(~F.col("truth").eqNullSafe(F.col("__truth")) | F.col("before").isNull() | F.col("after").isNull()).isEmpty():
        raise ValueError("the studies differ in their rows or labels")
    return both.select(key, "truth", "before", "after")


def compare_studies(left: DataFrame, right: DataFrame, key: str, truth: str, predicted: str, draws: int = 20_000) -> DataFrame:
    """One row: change in F1 with its interval, and how many predictions changed in each way."""
    both = paired(left, right, key, truth, predicted)
    columns = (F.col("truth"), F.col("before"), F.col("after"))
    gap, low, high = paired_bootstrap(bootstrap_cells(both, *columns), draws)
    return transitions(both, *columns).select(F.lit(gap).alias("difference"), F.lit(low).alias("low"), F.lit(high).alias("high"), "*")


def transitions(df: DataFrame, truth: Column, before: Column, after: Column) -> DataFrame:
    """How predictions changed: false negatives recovered, positives lost, and so on."""
    cases = {"recovered_fn": (1, 0, 1), "lost_tp": (1, 1, 0), "added_fp": (0, 0, 1), "removed_fp": (0, 1, 0)}
    return df.agg(*[F.count(F.when((truth == y) & (before == a) & (after == b), 1)).alias(n) for n, (y, a, b) in cases.items()])


def bootstrap_cells(df: DataFrame, truth: Column, before: Column, after: Column) -> DataFrame:
    """The eight cells that a paired bootstrap needs."""
    return df.groupBy(truth.alias("truth"), before.alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


def paired_bootstrap(cells: DataFrame, draws: int = 20_000, seed: int = 20260929) -> tuple[float, float, float]:
    """Difference in F1 and its 95 % interval, stratified by class; eight rows are collected."""
    count = np.zeros((2, 2, 2))
    for r in cells.collect():
        count[int(r["truth"]), int(r["before"]), int(r["after"])] = r["n"]
    random = np.random.default_rng(seed)
    drawn = []
    for y in (0, 1):
        cell = count[y].ravel()
        n = int(cell.sum())
        drawn.append(random.multinomial(n, cell / n, size=draws).reshape(draws, 2, 2) if n else np.zeros((draws, 2, 2)))

    def f1(no: np.ndarray, yes: np.ndarray, axis: int) -> np.ndarray:
        tp, fp = yes.sum(axis=-1 - axis)[..., 1], no.sum(axis=-1 - axis)[..., 1]
        return 2 * tp / np.maximum(tp + fp + yes.sum(axis=(-1, -2)), 1)

    def gap(no: np.ndarray, yes: np.ndarray) -> np.ndarray:
        return f1(no, yes, 1) - f1(no, yes, 0)

    low, high = np.quantile(gap(*drawn), [0.025, 0.975])
    return float(gap(count[0], count[1])), float(low), float(high)


def ensemble_mean(scores: DataFrame, key: str = "row_id", score: str = "p") -> DataFrame:
    return scores.groupBy(key).agg(F.avg(score).alias(score))


def score_agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(F.corr(a, b).alias("correlation"), F.avg(F.abs(a - b)).alias("mean_absolute_difference"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def promoted(deltas: DataFrame, candidate: str = "candidate", delta: str = "delta", least_folds: int = 2) -> DataFrame:
    """Candidates whose pooled change is positive and which improve enough folds."""
    return deltas.groupBy(candidate).agg(F.sum(delta).alias("pooled"), F.count(F.when(F.col(delta) > 0, 1)).alias("better")).where((F.col("pooled") > 0) & (F.col("better") >= least_folds))

"""Nested validation, permutation importance and feature ranking.

A fitter takes training rows and returns a scorer: rows in, ``key, stage, p``
out. Everything about it that is learned sees its training rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import sampling_order
from millrace.operators import evaluation
from millrace.operators.sampling import class_ranks, stratified_folds

Scorer = Callable[[DataFrame], DataFrame]
Fitter = Callable[[DataFrame], Scorer]


def partitions(df: DataFrame, label: str, key: str, outer: int, inner: int, seed: int) -> DataFrame:
    """``outer, inner, key, role``: all fits of a nested validation.

    ``inner`` is null for the fit on all training rows of an outer fold. Roles
    are ``train`` and ``validation``.
    """
    folds = stratified_folds(df.select(key, label), label, key, outer, seed).select(key, label, "fold")
    parts = []
    for k in range(outer):
        parts.append(folds.select(F.lit(k).alias("outer"), F.lit(None).cast("int").alias("inner"), key, F.when(F.col("fold") == k, "validation").otherwise("train").alias("role")))
        within = stratified_folds(folds.where(F.col("fold") != k).select(key, label), label, key, inner, seed + k + 1)
        for j in range(inner):
            parts.append(within.select(F.lit(k).alias("outer"), F.lit(j).alias("inner"), key, F.when(F.col("fold") == j, "validation").otherwise("train").alias("role")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def out_of_fold(df: DataFrame, key: str, fold: str, folds: int, fit: Fitter) -> DataFrame:
    """``key, fold, stage, p``: each row scored by the model that did not see it."""
    out = None
    for k in range(folds):
        own = df.where(F.col(fold) == k)
        part = fit(df.where(F.col(fold) != k).drop(fold))(own.drop(fold)).select(key, F.lit(k).alias("fold"), "stage", "p")
        out = part if out is None else out.unionByName(part)
    return out


def oof_faults(scores: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys whose scores are missing, repeated in a stage, or outside [0, 1]."""
    stages = scores.select("stage").distinct()
    want = rows.select(key).crossJoin(F.broadcast(stages))  # a row for each stage
    seen = scores.groupBy(key, "stage").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"), F.count("p").alias("known"))
    wrong = F.col("n").isNull() | (F.col("n") != 1) | (F.col("known") != 1) | (F.col("low") < 0) | (F.col("high") > 1) | F.isnan("low")
    return want.join(seen, [key, "stage"], "full_outer").where(wrong)


def nested_evaluation(df: DataFrame, label: str, key: str, fit: Fitter, outer: int = 3, inner: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Thresholds come from inner out-of-fold scores and are applied to the outer fold.

    Returns ``fold, stage, threshold`` with metrics of each outer fold, and
    pooled metrics by stage with log loss and average precision. ``outer *
    (inner + 1)`` models are fitted, one after the other in the driver.
    """
    folds = stratified_folds(df, label, key, outer, seed).persist()
    y, p, chosen, scored = F.col(label), F.col("p"), [], None
    for k in range(outer):
        train = folds.where(F.col("fold") != k).drop("fold")
        held = folds.where(F.col("fold") == k).drop("fold")
        inside = stratified_folds(train, label, key, inner, seed + k + 1).persist()
        guesses = out_of_fold(inside, key, "fold", inner, fit).join(train.select(key, label), key).persist()
        for stage in sorted(r[0] for r in guesses.select("stage").distinct().collect()):
            best = evaluation.best_f1_threshold(guesses.where(F.col("stage") == stage), y, p).first()
            chosen.append((k, stage, best["threshold"]))
        guesses.unpersist()
        inside.unpersist()
        part = fit(train)(held).select(key, F.lit(k).alias("fold"), "stage", "p").join(held.select(key, label), key)
        scored = part if scored is None else scored.unionByName(part)
    thresholds = df.sparkSession.createDataFrame(chosen, "fold int, stage int, threshold double")
    judged = scored.join(F.broadcast(thresholds), ["fold", "stage"]).withColumn("predicted", F.coalesce((p >= F.col("threshold")).cast("int"), F.lit(0))).persist()
    by_fold = evaluation.metrics(evaluation.confusion(judged, y, F.col("predicted"), ["fold", "stage", "threshold"]))
    pooled = evaluation.metrics(evaluation.confusion(judged, y, F.col("predicted"), ["stage"]))
    quality = None
    for stage in sorted({s for _, s, _ in chosen}):
        own = judged.where(F.col("stage") == stage)
        row = evaluation.log_loss(own, y, p).crossJoin(evaluation.average_precision(own, y, p)).withColumn("stage", F.lit(stage))  # one row each
        quality = row if quality is None else quality.unionByName(row)
    return by_fold, pooled.join(quality, "stage")


def threshold_summary(by_fold: DataFrame) -> DataFrame:
    return by_fold.groupBy("stage").agg(F.min("threshold").alias("minimum"), F.max("threshold").alias("maximum"), F.avg("threshold").alias("mean"), F.stddev_pop("threshold").alias("std"))


def selector_partition(df: DataFrame, label: str, key: str, folds: int, most: int, seed: int) -> DataFrame:
    """Adds ``role``: ``fit``, ``holdout``, or ``sample``, a stratified part of the first fold."""
    placed = stratified_folds(df, label, key, folds, seed)
    held = placed.where("fold = 0").drop("fold")
    n, positives = held.agg(F.count("*"), F.sum(label)).first()
    size = min(most, n)
    ones = round(size * (positives or 0) / max(n, 1))  # half to even
    ranked = class_ranks(held, label, key, f"{seed}-sample")
    inside = F.col("place") <= F.when(F.col(label) == 1, ones).otherwise(size - ones)
    roles = ranked.select(*df.columns, F.when(inside, "sample").otherwise("holdout").alias("role"))
    return placed.where("fold <> 0").select(*df.columns, F.lit("fit").alias("role")).unionByName(roles)


def permuted(df: DataFrame, columns: list[str], key: str, seed: int) -> DataFrame:
    """``df`` with ``columns`` shuffled together over its rows.

    Rows by key meet rows by a seeded hash at the same place in a distributed
    order, so every row's values are used once.
    """
    from millrace.functions.ordered import running_totals

    marked = df.withColumn("__one", F.lit(1))
    place = running_totals(marked, [F.col(key)], {"__place": "__one"}).drop("__one", *columns)
    order = marked.select("__one", F.col(key).alias("__key"), sampling_order(seed, F.col(key)).alias("__order"), *columns)
    shuffled = running_totals(order, [F.col("__order"), F.col("__key")], {"__place": "__one"}).select("__place", *columns)
    return place.join(shuffled, "__place").select(*df.columns)


def permutation_importance(df: DataFrame, groups: dict[str, list[str]], label: str, key: str, score: Scorer, threshold: float, seeds: list[int]) -> DataFrame:
    """``feature, f1_drop, f1_drop_std, ap_drop, log_loss_rise``: means over the permutations."""

    def judge(rows: DataFrame) -> tuple[float, float, float]:
        found = score(rows).select(key, "p").join(rows.select(key, label), key).persist()
        y, p = F.col(label), F.col("p")
        f1 = evaluation.metrics(evaluation.confusion(found, y, (p >= threshold).cast("int"))).first()["f1"]
        ap = evaluation.average_precision(found, y, p).first()[0]
        loss = evaluation.log_loss(found, y, p).first()[0]
        found.unpersist()
        return f1 or 0.0, ap or 0.0, loss

    base = judge(df)
    rows = []
    for feature, columns in groups.items():
        for seed in seeds:
            f1, ap, loss = judge(permuted(df, columns, key, seed))
            rows.append((feature, base[0] - f1, base[1] - ap, loss - base[2]))
    found = df.sparkSession.createDataFrame(rows, "feature string, f1 double, ap double, loss double")
    return found.groupBy("feature").agg(F.avg("f1").alias("f1_drop"), F.stddev_samp("f1").alias("f1_drop_std"), F.avg("ap").alias("ap_drop"), F.avg("loss").alias("log_loss_rise"))


def ranked_features(importance: DataFrame, usage: dict[str, tuple[int, int]], most: int) -> list[str]:
    """The best columns in table order: by F1, average precision, loss, splits, position."""
    rows = {r["feature"]: r for r in importance.collect()}
    order = list(usage)
    if not 1 <= most <= len(rows):
        raise ValueError("wrong number of columns")
    rank = sorted(rows, key=lambda f: (-rows[f]["f1_drop"], -rows[f]["ap_drop"], -rows[f]["log_loss_rise"], -usage[f][0], order.index(f)))
    return sorted(rank[:most], key=order.index)

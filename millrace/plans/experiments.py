"""Controlled studies: candidates that change one thing of a baseline, judged on the same folds.

A candidate wraps a fitter: it draws fewer negatives, weighs positives, or keeps
the columns that a selector ranks first. Whatever it learns or draws, it takes
from the training rows that it is given.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import boosting, evaluation, profile, sampling, validation
from millrace.operators.validation import Fitter, Scorer
from millrace.plans import runners
from millrace.sources import codebook, tables


def undersampled(fit: Fitter, label: str, key: str, ratio: int, seed: int, pilot: Fitter | None = None) -> Fitter:
    """Fitted on all positives and ``ratio`` negatives for each; with a ``pilot``, half of them are those that it scores highest.

    The pilot sees the training rows only; its scores are out of two folds.
    """

    def run(train: DataFrame) -> Scorer:
        if pilot is None:
            return fit(sampling.undersample(train, label, key, ratio, seed))
        placed = sampling.stratified_folds(train, label, key, 2, seed)
        scores = validation.out_of_fold(placed, key, "fold", 2, pilot).select(key, F.col("p").alias("__pilot"))
        return fit(sampling.undersample_hard(train.join(scores, key), label, key, "__pilot", ratio, seed).drop("__pilot"))

    return run


def weighted(study: runners.Study, settings: boosting.Settings, positive_weight: float) -> Fitter:
    """A booster whose positives weigh more."""
    return runners.boosting_fitter(study, replace(settings, positive_weight=positive_weight))


def selected(study: runners.Study, settings: boosting.Settings, most: int, seeds: list[int], folds: int = 3, sample: int = 20_000, threshold: float = 0.5) -> Fitter:
    """A booster on the ``most`` columns that lose most when shuffled.

    The selector is fitted on the training rows outside its first fold and
    judged on a stratified sample of that fold.
    """

    def run(train: DataFrame) -> Scorer:
        parts = validation.selector_partition(train, study.label, study.key, folds, sample, settings.seed)
        fitted, judged = (parts.where(F.col("role") == r).drop("role") for r in ("fit", "sample"))
        shown = study.fit(fitted, study.columns, study.entries, study.plan)
        model = boosting.Booster(shown.names, settings).fit(shown.apply(fitted, study.key, study.label), study.label, key=study.key)
        rows = shown.apply(judged, study.key, study.label)
        found = boosting_importance(model, rows, {c: [c] for c in shown.names}, study.label, study.key, threshold, seeds)
        usage = model.split_usage()
        return runners.boosting_fitter(replace(study, columns=validation.ranked_features(found, usage, most)), settings)(train)

    return run


def boosting_importance(model: boosting.Booster, df: DataFrame, groups: dict[str, list[str]], label: str, key: str, threshold: float, seeds: list[int]) -> DataFrame:
    """``permutation_importance`` of a booster; only trees that use a shuffled column are scored anew."""
    found = None
    for name, columns in groups.items():
        own = {model.columns.index(c) for c in columns}
        touched = [any(n.feature in own for n in tree) for tree in model.trees]
        fixed = replace(model, trees=[t for t, hit in zip(model.trees, touched) if not hit])
        moved = replace(model, trees=[t for t, hit in zip(model.trees, touched) if hit], base=0.0)
        kept = fixed.decision(df, key).select(key, F.col("score").alias("__fixed"))

        def score(rows: DataFrame, moved: boosting.Booster = moved, kept: DataFrame = kept) -> DataFrame:
            both = moved.decision(rows, key).join(kept, key)
            return both.select(key, "stage", (1 / (1 + F.exp(-(F.col("score") + F.col("__fixed"))))).alias("p"))

        part = validation.permutation_importance(df, {name: columns}, label, key, score, threshold, seeds)
        found = part if found is None else found.unionByName(part)
    return found


def timed(fit: Fitter, log: Callable[[str, float], None]) -> Fitter:
    """``fit`` with its seconds by phase: ``log`` gets ``fit`` or ``score`` and the wall time of the call.

    Scores are lazy, so that ``score`` is the time to plan them.
    """

    def run(train: DataFrame) -> Scorer:
        began = time.time()
        scorer = fit(train)
        log("fit", time.time() - began)

        def score(held: DataFrame) -> DataFrame:
            began = time.time()
            out = scorer(held)
            log("score", time.time() - began)
            return out

        return score

    return run


def controlled_study(df: DataFrame, baseline: Fitter, candidates: dict[str, Fitter], label: str, key: str, ledger: str | None = None, outer: int = 3, inner: int = 2, seed: int = 0, least_folds: int = 2) -> DataFrame:
    """``candidate, stage, pooled, better, promoted``: change in F1 against the baseline, pooled over the folds.

    All models are judged on the same folds, with thresholds from inner folds. A
    candidate is promoted if its pooled change is positive and enough folds improve.
    """
    base, _ = validation.nested_evaluation(df, label, key, baseline, outer, inner, seed)
    base = base.select("fold", "stage", F.col("f1").alias("__base"))
    out = None
    for name, fit in candidates.items():
        phases: list[tuple[str, float]] = []
        by_fold, _ = validation.nested_evaluation(df, label, key, timed(fit, lambda *phase, own=phases: own.append(phase)), outer, inner, seed)
        deltas = by_fold.join(base, ["fold", "stage"]).select(F.lit(name).alias("candidate"), "stage", "fold", (F.coalesce("f1", F.lit(0.0)) - F.coalesce("__base", F.lit(0.0))).alias("delta"))
        if ledger:
            rows = [r.asDict() for r in deltas.collect()]
            seconds = {k: round(sum(s for p, s in phases if p == k), 3) for k in ("fit", "score")}
            tables.append_run(df.sparkSession, ledger, name, {"outer": outer, "inner": inner, "seed": seed}, {"deltas": rows, "seconds": seconds})
        out = deltas if out is None else out.unionByName(deltas)
    totals = out.groupBy("candidate", "stage").agg(F.sum("delta").alias("pooled"), F.count(F.when(F.col("delta") > 0, 1)).alias("better"))
    return totals.withColumn("promoted", (F.col("pooled") > 0) & (F.col("better") >= least_folds))


# -- calibration of several candidates, one after the other, resumable --


def pending(spark: SparkSession, ledger: str, names: list[str]) -> DataFrame:
    """``name, done``: which candidates the ledger has."""
    table = spark.createDataFrame([(n,) for n in names], "name string")
    if not tables.exists(spark, ledger):
        return table.withColumn("done", F.lit(False))
    held = spark.read.parquet(ledger).select("name").distinct().withColumn("__done", F.lit(True))
    return table.join(held, "name", "left").select("name", F.coalesce("__done", F.lit(False)).alias("done"))


def calibrate_pending(train: DataFrame, candidates: dict[str, Fitter], label: str, key: str, ledger: str, folds: int = 3, seed: int = 0, most: int | None = None) -> DataFrame:
    """Thresholds of the candidates that the ledger does not have yet, ``most`` of them; then ``pending``.

    Each is logged once it is done, so that a run which was stopped goes on where it was.
    """
    spark = train.sparkSession
    open_ = [r["name"] for r in pending(spark, ledger, list(candidates)).orderBy("name").collect() if not r["done"]]
    for name in open_[:most]:
        threshold = runners.calibrated_threshold(train, candidates[name], label, key, folds, seed)
        tables.append_run(spark, ledger, name, {"folds": folds, "seed": seed}, {"threshold": threshold})
    return pending(spark, ledger, list(candidates))


# -- the registry, from a codebook and both samples --


def build_registry(spark: SparkSession, codebook_path: str, train: DataFrame, test: DataFrame, folder: str) -> DataFrame:
    """Parse, profile, find equal columns, join, and write JSON, CSV and a summary below ``folder``."""
    if sorted(train.columns) != sorted(test.columns):
        raise ValueError("training and test columns differ")
    records = codebook.read_codebook(spark, codebook_path)
    if unknown := sorted(set(train.columns) - set(records)):
        raise ValueError(f"not in the codebook: {unknown}")
    sides = [profile.moments(df, df.columns) for df in (train, test)]
    from millrace.operators.cleaning import distinct_counts

    counts = distinct_counts(train, {c: F.col(c) for c in train.columns})
    found = [e for e in codebook.entries(records, counts) if e["name"] in train.columns]
    table = codebook.registry(spark, found, *sides, profile.duplicate_columns(train, train.columns))
    codebook.write_registry(table, folder)
    spark.createDataFrame([(codebook.summary(table),)], "value string").coalesce(1).write.text(f"{folder}/summary")
    return table

"""Whole studies as functions of tables: train and predict, nested validation, profiles.

A study is a fitter (``millrace.operators.validation``) with its settings; the
same nested evaluation serves boosting, logistic, ridge and network models.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import sigmoid
from millrace.operators import boosting, linear, perceptron, preprocessing, profile, validation
from millrace.operators.validation import Fitter, Scorer
from millrace.sources import tables

Fit = Callable[[DataFrame, list[str], list[dict], preprocessing.Plan], preprocessing.Representation]


@dataclass(frozen=True)
class Study:
    """Columns, their metadata, the plan of the representation, and the names of label and key."""

    columns: list[str]
    entries: list[dict]
    label: str
    key: str
    plan: preprocessing.Plan = preprocessing.Plan()
    fit: Fit = preprocessing.fit_tree


def _score(x: list[str], w: np.ndarray) -> Column:
    return sum((F.col(c) * F.lit(float(v)) for c, v in zip(x, w)), F.lit(0.0))


def named_plan(suite: dict, name: str) -> preprocessing.Plan:
    """The plan of a suite's variant; unknown names and settings are errors."""
    found = [v for v in suite["variants"] if v["name"] == name]
    if len(found) != 1:
        raise ValueError(f"the suite has {len(found)} variants named {name}")
    settings = {k: tuple(v) if isinstance(v, list) else v for k, v in found[0].items() if k != "name"}
    return preprocessing.Plan(**settings)


def boosting_fitter(study: Study, settings: boosting.Settings, stages: list[int] | None = None) -> Fitter:
    """Scores after each of ``stages`` trees. Names of settings refer to output columns; a prefix ending in ``__`` stands for a block."""

    def fit(train: DataFrame) -> Scorer:
        shown = study.fit(train, study.columns, study.entries, study.plan)
        named = lambda wanted: tuple(c for c in shown.names if c in wanted or any(w.endswith("__") and c.startswith(w) for w in wanted))
        own = replace(settings, exact=named(settings.exact), categorical=named(settings.categorical))
        rows = shown.apply(train, study.key, study.label)
        model = boosting.Booster(shown.names, own).fit(rows, study.label, key=study.key if dict(train.dtypes)[study.key] in ("int", "bigint") else None)
        return lambda held: model.probabilities(shown.apply(held, study.key), study.key, stages)

    return fit


def logistic_fitter(study: Study, steps: list[int], rate: float, lambda_: float = 0.0, products: tuple[tuple[str, str], ...] = ()) -> Fitter:
    """Gradient descent with scores at each of ``steps``, continued from one to the next."""
    study = replace(study, fit=preprocessing.fit_linear)

    def fit(train: DataFrame) -> Scorer:
        shown = study.fit(train, study.columns, study.entries, study.plan)
        if products:
            from millrace.operators.cleaning import interactions

            ready = shown.apply(train, study.key, study.label)
            found = interactions(ready, list(products))
            widen = lambda df: df.select("*", *[x.alias(n) for n, x in found.items()])
        else:
            found, widen = {}, lambda df: df
        x = [*shown.names, *found]
        rows = widen(shown.apply(train, study.key, study.label)).withColumn(study.label, F.col(study.label).cast("double"))
        w, done, weights = np.zeros(len(x)), 0, {}
        for stage in sorted(steps):
            w, _ = linear.logistic(rows, study.label, x, list(w), stage - done, rate, lambda_)
            done, weights[stage] = stage, w

        def score(held: DataFrame) -> DataFrame:
            ready = widen(shown.apply(held, study.key))
            parts = [F.struct(F.lit(s).alias("stage"), sigmoid(_score(x, v)).alias("p")) for s, v in weights.items()]
            return ready.select(study.key, F.inline(F.array(*parts)))

        return score

    return fit


def ridge_fitter(study: Study, lambdas: list[float], calibration_steps: int = 200) -> Fitter:
    """Ridge on labels -1 and 1, its scores calibrated on the training rows; stage is the place of the penalty."""
    study = replace(study, fit=preprocessing.fit_linear)

    def fit(train: DataFrame) -> Scorer:
        shown = study.fit(train, study.columns, study.entries, study.plan)
        y = F.col(study.label).cast("double")
        rows = shown.apply(train, study.key, study.label).select(*shown.names, y.alias("__y"), (2 * y - 1).alias("__signed"))
        g, b, yy, n = linear.gram(rows, "__signed", shown.names)  # one read for all penalties
        found = []
        for stage, lambda_ in enumerate(lambdas):
            w = np.linalg.solve(g + 2 * n * lambda_ * np.eye(len(b)), b)
            found.append((stage, w, linear.platt(rows.withColumn("__s", _score(shown.names, w)), "__y", "__s", calibration_steps)))
        parts = [F.struct(F.lit(s).alias("stage"), linear.calibrated(_score(shown.names, w), c).alias("p")) for s, w, c in found]
        return lambda held: shown.apply(held, study.key).select(study.key, F.inline(F.array(*parts)))

    return fit


def network_fitter(study: Study, max_rows: int = 200_000, **settings) -> Fitter:
    """A small network on at most ``max_rows`` training rows."""
    study = replace(study, fit=preprocessing.fit_network)

    def fit(train: DataFrame) -> Scorer:
        shown = study.fit(train, study.columns, study.entries, study.plan)
        model = perceptron.fit_on(shown.apply(train, study.key, study.label), shown.names, study.label, study.key, max_rows, **settings)
        return lambda held: perceptron.predict(shown.apply(held, study.key), model, shown.names, study.key).select(study.key, F.lit(1).alias("stage"), "p")

    return fit


def constant_fitter(study: Study, p: float = 0.0) -> Fitter:
    """Nobody is positive: the baseline of all others."""
    return lambda train: lambda held: held.select(study.key, F.lit(1).alias("stage"), F.lit(float(p)).alias("p"))


def ensemble_fitter(fitters: list[Fitter]) -> Fitter:
    """Mean of the probabilities of several models, by stage."""

    def fit(train: DataFrame) -> Scorer:
        scorers = [f(train) for f in fitters]

        def score(held: DataFrame) -> DataFrame:
            parts = [s(held) for s in scorers]
            key, out = parts[0].columns[0], parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            return out.groupBy(key, "stage").agg(F.avg("p").alias("p"))

        return score

    return fit


def train_and_predict(train: DataFrame, test: DataFrame, fit: Fitter, key: str, threshold: float) -> DataFrame:
    """``key, Prediction``: -1 or 1 for every test row, from all training rows."""
    return fit(train)(test).select(key, tables.signed(F.col("p"), threshold).alias("Prediction"))


def calibrated_threshold(train: DataFrame, fit: Fitter, label: str, key: str, folds: int = 3, seed: int = 0) -> float:
    """The best threshold of out-of-fold scores of one stage on all training rows.

    If nobody should be positive it is the next number above the highest score.
    """
    from millrace.operators.evaluation import best_f1_threshold
    from millrace.operators.sampling import stratified_folds

    placed = stratified_folds(train, label, key, folds, seed)
    scores = validation.out_of_fold(placed, key, "fold", folds, fit).join(train.select(key, label), key)
    best = best_f1_threshold(scores, F.col(label), F.col("p")).first()["threshold"]
    return float(np.nextafter(scores.agg(F.max("p")).first()[0], np.inf)) if best is None else best


def run_suite(df: DataFrame, fitters: dict[str, Fitter], label: str, key: str, ledger: str | None = None, outer: int = 3, inner: int = 2, seed: int = 0) -> DataFrame:
    """Nested evaluation of each model; ``model, stage`` and pooled metrics, logged with wall time."""
    out = None
    for name, fit in fitters.items():
        began = time.time()
        by_fold, pooled = validation.nested_evaluation(df, label, key, fit, outer, inner, seed)
        pooled = pooled.withColumn("model", F.lit(name))
        if ledger:
            rows = [r.asDict() for r in pooled.collect()]
            folds = [r.asDict() for r in by_fold.collect()]
            tables.append_run(df.sparkSession, ledger, name, {"outer": outer, "inner": inner, "seed": seed}, {"pooled": rows, "folds": folds, "seconds": round(time.time() - began, 3)})
        out = pooled if out is None else out.unionByName(pooled)
    return out


def audit(train: DataFrame, test: DataFrame, columns: list[str], label: Column) -> dict[str, DataFrame]:
    """The tables of an exploratory report."""
    return {
        "train": profile.moments(train, columns),
        "test": profile.moments(test, columns),
        "missing": profile.missing_cells(train, columns),
        "association": profile.standardised_difference(train, columns, label),
        "duplicates": profile.duplicate_summary(train, test, columns, label),
        "equal_columns": profile.duplicate_columns(train, columns),
    }

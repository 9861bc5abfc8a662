"""Linear and logistic models from distributed sums.

The Gram matrix of the features is one aggregate: each task adds up its own
rows with a matrix product, and what comes to the driver has the square of the
number of columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import sigmoid, softplus


def _summed(df: DataFrame, columns: list[str], partial) -> np.ndarray:
    """Sum of ``partial(matrix)`` over all batches of ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            matrix = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])
            own = partial(matrix)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(total.size), "v": total.ravel()})

    parts = df.select(*columns).mapInArrow(run, "i long, v double")
    rows = parts.groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def gram(df: DataFrame, y: str, x: list[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """XᵀX, Xᵀy, yᵀy and the number of rows."""
    columns = [*x, y]
    flat = _summed(df, columns, lambda m: np.concatenate([(m.T @ m).ravel(), [float(len(m))]]))
    full = flat[:-1].reshape(len(columns), len(columns))
    return full[:-1, :-1], full[:-1, -1], float(full[-1, -1]), int(flat[-1])


def half_mse(g: np.ndarray, b: np.ndarray, yy: float, n: int, w: np.ndarray) -> float:
    return float(yy - 2 * w @ b + w @ g @ w) / (2 * n)


def least_squares(df: DataFrame, y: str, x: list[str]) -> tuple[np.ndarray, float]:
    """Normal equations; a singular system is an error."""
    g, b, yy, n = gram(df, y, x)
    w = np.linalg.solve(g, b)
    return w, half_mse(g, b, yy, n, w)


def ridge(df: DataFrame, y: str, x: list[str], lambda_: float) -> tuple[np.ndarray, float]:
    """Every weight is penalised by ``2 n lambda``; the loss leaves the penalty out."""
    g, b, yy, n = gram(df, y, x)
    w = np.linalg.solve(g + 2 * n * lambda_ * np.eye(len(x)), b)
    return w, half_mse(g, b, yy, n, w)


def gradient_descent(df: DataFrame, y: str, x: list[str], initial: list[float], steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Full-batch descent on the half mean square; the data are read once."""
    g, b, yy, n = gram(df, y, x)
    w = np.array(initial, float)
    for _ in range(steps):
        w = w - rate * (g @ w - b) / n
    return w, half_mse(g, b, yy, n, w)


def stochastic_gradient(df: DataFrame, y: str, x: list[str], initial: list[float], steps: int, rate: float, seed: int, key: str) -> tuple[np.ndarray, float]:
    """One row a step, drawn with replacement; only the drawn rows are collected."""
    g, b, yy, n = gram(df, y, x)
    drawn = np.random.default_rng(seed).integers(0, n, steps)
    from millrace.functions.ordered import running_totals

    placed = running_totals(df.withColumn("__one", F.lit(1)), [F.col(key)], {"__place": "__one"})
    wanted = df.sparkSession.createDataFrame([(int(i) + 1,) for i in set(drawn.tolist())], "__place long")
    rows = {r["__place"] - 1: r for r in placed.join(F.broadcast(wanted), "__place").select("__place", y, *x).collect()}
    w = np.array(initial, float)
    for i in drawn.tolist():
        features = np.array([rows[i][c] for c in x], float)
        w = w + rate * (rows[i][y] - features @ w) * features
    return w, half_mse(g, b, yy, n, w)


def logistic(df: DataFrame, y: str, x: list[str], initial: list[float], steps: int, rate: float, lambda_: float = 0.0) -> tuple[np.ndarray, float]:
    """Full-batch descent on the mean logistic loss, an aggregate a step.

    The gradient has ``2 lambda w`` on all weights, the loss no penalty.
    """
    df = df.select(y, *x).persist()
    w = np.array(initial, float)
    try:
        for _ in range(steps):

            def slope(m: np.ndarray, w: np.ndarray = w) -> np.ndarray:
                score = m[:, :-1] @ w
                p = 0.5 * (1 + np.tanh(0.5 * score))
                return np.concatenate([m[:, :-1].T @ (p - m[:, -1]), [float(len(m))]])

            total = _summed(df, [*x, y], slope)
            w = w - rate * (total[:-1] / total[-1] + 2 * lambda_ * w)
        score = sum((F.col(c) * float(v) for c, v in zip(x, w)), F.lit(0.0))
        loss = df.agg(F.avg(softplus(score) - F.col(y) * score)).first()[0]
    finally:
        df.unpersist()
    return w, float(loss)


def gradient_norm(df: DataFrame, y: str, x: list[str], w: np.ndarray, lambda_: float = 0.0) -> float:
    """Length of the gradient of the penalised mean logistic loss."""

    def slope(m: np.ndarray) -> np.ndarray:
        p = 0.5 * (1 + np.tanh(0.5 * (m[:, :-1] @ w)))
        return np.concatenate([m[:, :-1].T @ (p - m[:, -1]), [float(len(m))]])

    total = _summed(df, [*x, y], slope)
    return float(np.linalg.norm(total[:-1] / total[-1] + 2 * lambda_ * w))


def platt(df: DataFrame, y: str, score: str, steps: int = 200, rate: float = 1.0) -> dict[str, float]:
    """Calibration: standardise the score, then two logistic weights."""
    mean, scale = df.agg(F.avg(score), F.stddev_pop(score)).first()
    ready = df.select(F.col(y), F.lit(1.0).alias("__one"), ((F.col(score) - mean) / (scale or 1.0)).alias("__z"))
    w, _ = logistic(ready, y, ["__one", "__z"], [0.0, 0.0], steps, rate)
    return {"mean": mean, "scale": scale or 1.0, "intercept": float(w[0]), "slope": float(w[1])}


def calibrated(score, state: dict[str, float]):
    return sigmoid(state["intercept"] + state["slope"] * (score - state["mean"]) / state["scale"])

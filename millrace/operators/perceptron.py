"""A small ReLU network with Adam, fitted on a bounded sample, applied in Arrow."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import sampling_order


class Perceptron:
    """Hidden ReLU layers, one sigmoid output, cross-entropy plus half l2 on weights."""

    def __init__(self, hidden: tuple[int, ...] = (64, 32), rate: float = 1e-3, l2: float = 1e-4, batch: int = 256, epochs: int = 30, patience: int = 5, seed: int = 0, min_delta: float = 0.0):
        self.hidden, self.rate, self.l2, self.batch = hidden, rate, l2, batch
        self.epochs, self.patience, self.seed, self.min_delta = epochs, patience, seed, min_delta
        self.weights: list[np.ndarray] = []
        self.biases: list[np.ndarray] = []

    def start(self, x: np.ndarray, y: np.ndarray) -> None:
        """He weights, the last layer by 1/width; the output starts at the prevalence."""
        random = np.random.default_rng(self.seed)
        sizes = [x.shape[1], *self.hidden, 1]
        scales = [np.sqrt(2 / n) for n in sizes[:-2]] + [np.sqrt(1 / sizes[-2])]
        self.weights = [random.normal(0, s, (a, b)) for s, a, b in zip(scales, sizes, sizes[1:])]
        self.weights[0][~x.any(axis=0)] = 0
        self.biases = [np.zeros(b) for b in sizes[1:]]
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.biases[-1][:] = np.log(share / (1 - share))

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for w, b in zip(self.weights[:-1], self.biases[:-1]):
            out.append(np.maximum(out[-1] @ w + b, 0))
        out.append(out[-1] @ self.weights[-1] + self.biases[-1])
        return out

    def loss(self, x: np.ndarray, y: np.ndarray, penalty: bool = True) -> float:
        s = self.layers(x)[-1][:, 0]
        return float(np.mean(np.logaddexp(0, s) - y * s) + (0.5 * self.l2 * sum((w**2).sum() for w in self.weights) if penalty else 0))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of all weights, then all biases."""
        out = self.layers(x)
        back = (0.5 * (1 + np.tanh(0.5 * out[-1])) - y[:, None]) / len(y)
        weights, biases = [], []
        for i in range(len(self.weights) - 1, -1, -1):
            weights.insert(0, out[i].T @ back + self.l2 * self.weights[i])
            biases.insert(0, back.sum(axis=0))
            back = (back @ self.weights[i].T) * (out[i] > 0) if i else back
        return weights + biases

    def fit(self, x: np.ndarray, y: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None, progress: Callable[[dict], None] | None = None) -> "Perceptron":
        """Stops early on held rows and goes back to the best weights; ``progress`` gets the losses of each epoch.

        An epoch counts as better for stopping if it gains more than ``min_delta``.
        A loss that is not finite is an error.
        """
        self.start(x, y)
        random = np.random.default_rng(self.seed + 1)
        first, second, step, best, waited, mark = None, None, 0, None, 0, np.inf
        for epoch in range(self.epochs):
            order = random.permutation(len(x))
            for i in range(0, len(x), self.batch):
                grads = self.gradients(x[order[i : i + self.batch]], y[order[i : i + self.batch]])
                step += 1
                first = [0.9 * a + 0.1 * g for a, g in zip(first or [0.0] * len(grads), grads)]
                second = [0.999 * a + 0.001 * g * g for a, g in zip(second or [0.0] * len(grads), grads)]
                for p, a, b in zip([*self.weights, *self.biases], first, second):
                    p -= self.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            now = self.loss(*held, penalty=False) if held else None
            own = self.loss(x, y)
            if not np.isfinite(own) or (held and not np.isfinite(now)):
                raise FloatingPointError("the loss is not finite")
            if progress:
                progress({"epoch": epoch + 1, "training_loss": own, "held_loss": now})
            if held:
                if best is None or now < best[0]:
                    best = (now, [p.copy() for p in (*self.weights, *self.biases)])
                if now < mark - self.min_delta:
                    mark, waited = now, 0
                elif (waited := waited + 1) >= self.patience:
                    break
        if best:
            n = len(self.weights)
            self.weights, self.biases = best[1][:n], best[1][n:]
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        """The layers as one JSON document; nothing is overwritten."""
        doc = {"hidden": list(self.hidden), "weights": [w.tolist() for w in self.weights], "biases": [b.tolist() for b in self.biases]}
        spark.createDataFrame([(json.dumps(doc, allow_nan=False),)], "value string").coalesce(1).write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Perceptron":
        doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
        model = cls(tuple(doc["hidden"]))
        model.weights, model.biases = ([np.array(v) for v in doc[k]] for k in ("weights", "biases"))
        return model

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * self.layers(x)[-1][:, 0]))


def fit_on(df: DataFrame, columns: list[str], label: str, key: str, max_rows: int = 200_000, **settings) -> Perceptron:
    """Fitted on at most ``max_rows`` rows in seeded order, collected to the driver."""
    rows = df.orderBy(sampling_order("perceptron", F.col(key)), key).limit(max_rows).select(label, *columns).toPandas()
    return Perceptron(**settings).fit(rows[columns].to_numpy(float), rows[label].to_numpy(float))


def predict(df: DataFrame, model: Perceptron, columns: list[str], key: str) -> DataFrame:
    """``key, p`` of every row, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probabilities(x))], [key, "p"])

    rows = df.select(key, *columns)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, p double")

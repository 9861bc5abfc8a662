"""Histogram Newton boosting.

Rows are binned once. For each level of a tree every task counts its own rows
into histograms by node, feature and bin, which are added up in Spark; the
driver sees only the sums and picks the splits. Scores are kept with the rows,
and written anew every few trees.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import scratch
from millrace.functions.quantiles import quantiles
from millrace.functions.scalars import sigmoid
from millrace.operators.cleaning import distinct_counts

MISSING = 255
#: bins that a categorical column can have, as 255 is for missing
MOST_LEVELS = 254


@dataclass
class Node:
    value: float
    feature: int | None = None
    split_bin: int = 0
    missing_left: bool = False
    left: int = -1
    right: int = -1
    depth: int = 0
    count: int = 0
    #: bins that go left, where the split is by membership
    categories: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Settings:
    trees: int = 100
    depth: int = 3
    rate: float = 0.05
    min_leaf: int = 200
    l2: float = 1.0
    min_gain: float = 0.0
    max_features: int | None = None
    bins: int = 64
    exact: tuple[str, ...] = ()
    exact_low: bool = False
    #: columns split by sets of their values; not for levelwise growth
    categorical: tuple[str, ...] = ()
    seed: int = 0
    #: ``levelwise``, ``recursive``, or ``leafwise`` (best leaf first, up to ``max_leaves``)
    strategy: str = "levelwise"
    max_leaves: int = 31
    #: share of the rows that each tree sees, by class
    subsample: float = 1.0
    sample_seed: int = 0
    positive_weight: float = 1.0
    #: False: the search that leaves out the last boundary where values are missing
    missing_boundary: bool = True
    write_every: int = 10

    def __post_init__(self) -> None:
        if self.strategy not in ("levelwise", "recursive", "leafwise"):
            raise ValueError(f"unknown strategy {self.strategy}")
        if self.categorical and self.strategy == "levelwise":
            raise ValueError("categorical splits need recursive or leafwise growth")
        if set(self.categorical) & set(self.exact):
            raise ValueError("a column is either exact or categorical")
        if not 0 < self.subsample <= 1:
            raise ValueError("subsample must be in (0, 1]")


def fit_edges(df: DataFrame, columns: list[str], settings: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """Edges of each column from the training rows, and which columns are exact.

    Exact columns have an edge at each value but the least; the others at
    distinct inner quantiles; of categorical columns the values themselves come
    back. Edges are rounded to single precision.
    """
    inner = np.linspace(0, 1, settings.bins + 1)[1:-1]
    sets = [c for c in columns if c in settings.categorical]
    wanted = [c for c in columns if c not in sets and (c in settings.exact or settings.exact_low)]
    distinct = distinct_counts(df, {c: F.col(c) for c in [*wanted, *sets]})
    if too_many := [c for c in sets if distinct[c] > MOST_LEVELS]:
        raise ValueError(f"more than {MOST_LEVELS} levels: {too_many}")
    exact = [c for c in wanted if distinct[c] <= settings.bins]
    if too_many := [c for c in settings.exact if c not in exact]:
        raise ValueError(f"more than {settings.bins} values: {too_many}")
    rest = [c for c in columns if c not in exact and c not in sets]
    aggs = [F.array_sort(F.collect_set(c)).alias(c) for c in [*exact, *sets]]
    row = (df.agg(*aggs).first().asDict() if aggs else {}) | quantiles(df, {c: F.col(c) for c in rest}, [float(q) for q in inner])
    edges = [np.unique(np.array((row[c] or [])[1 if c in exact else 0 :], dtype=np.float32)) for c in columns]
    return edges, np.array([c in exact for c in columns])


def binned(df: DataFrame, columns: list[str], edges: list[np.ndarray], keep: list[str], categorical: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and ``bins``: a byte for each column, 255 where it is null or an unseen category."""
    sets = [c in categorical for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((batch.num_rows, len(columns)), np.uint8)
            for j, e in enumerate(edges):
                values = batch.column(len(keep) + j).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float32)
                place = np.searchsorted(e, values, side="left" if sets[j] else "right")
                known = ~np.isnan(values)
                if sets[j]:
                    known &= np.append(e, np.float32(np.nan))[np.minimum(place, len(e))] == values
                out[:, j] = np.where(known, place, MISSING)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([r.tobytes() for r in out], pa.binary())], [*keep, "bins"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, *columns).mapInArrow(run, f"{fields}, bins binary")


def route(tree: list[Node], bins: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(bins), np.int64)
    for i, node in enumerate(tree):  # children come after their parent
        if node.feature is None:
            continue
        own = np.flatnonzero(at == i)
        values = bins[own, node.feature]
        inside = values <= node.split_bin if node.categories is None else np.isin(values, node.categories)
        left = np.where(values == MISSING, node.missing_left, inside)
        at[own] = np.where(left, node.left, node.right)
    return at


def scores(trees: list[list[Node]], bins: np.ndarray, start: np.ndarray, rate: float) -> np.ndarray:
    out = start.astype(float)
    for tree in trees:
        out = out + rate * np.array([n.value for n in tree])[route(tree, bins)]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` bytes each, straight from the column's buffer."""
    _, offsets, body = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    first = int(np.frombuffer(offsets, kind)[column.offset]) if len(column) else 0
    return np.frombuffer(body or b"", np.uint8)[first : first + len(column) * width].reshape(-1, width)


@dataclass
class Booster:
    """A boosted classifier over ``columns``; labels are 0 and 1."""

    columns: list[str]
    settings: Settings = field(default_factory=Settings)
    edges: list[np.ndarray] = field(default_factory=list)
    exact: np.ndarray | None = None
    base: float = 0.0
    trees: list[list[Node]] = field(default_factory=list)
    #: of the generator of column draws, after the last tree
    state: dict | None = None

    def fit(
        self,
        df: DataFrame,
        label: str,
        folder: str | None = None,
        key: str | None = None,
        checkpoints: tuple[int, ...] = (),
        callback: Callable[[int, "Booster"], None] | None = None,
    ) -> "Booster":
        """Fit all trees; ``callback`` gets the model at each of ``checkpoints``.

        ``folder`` is shared by all executors; unset, the session's checkpoint
        folder or, in local mode, a temporary one. ``key`` (a unique integer) makes
        row samples independent of the layout of the table, and they need it.
        """
        s = self.settings
        self.edges, self.exact = fit_edges(df, self.columns, s)
        n, positives = df.agg(F.count("*"), F.sum(label)).first()
        mass = s.positive_weight * positives
        share = min(max(mass / (mass + n - positives), 1e-12), 1 - 1e-12)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        self.state = np.random.default_rng(s.seed).bit_generator.state
        return self._grow(df, label, s.trees, folder, key, checkpoints, callback)

    def continue_fit(
        self,
        df: DataFrame,
        label: str,
        trees: int,
        folder: str | None = None,
        key: str | None = None,
        checkpoints: tuple[int, ...] = (),
        callback: Callable[[int, "Booster"], None] | None = None,
    ) -> "Booster":
        """More trees on the rows of the first fit: the same model as one longer fit."""
        if self.state is None:
            raise ValueError("the model must be fitted first")
        return self._grow(df, label, trees, folder, key, checkpoints, callback)

    def _grow(self, df: DataFrame, label: str, more: int, folder: str | None, key: str | None, checkpoints: tuple[int, ...], callback: Callable | None) -> "Booster":
        s, spark = self.settings, df.sparkSession
        if s.subsample < 1 and key is None:
            raise ValueError("row samples need a key, so that they do not depend on the layout of the table")
        folder = f"{folder.rstrip('/')}/boosting-{uuid.uuid4().hex}" if folder else scratch(spark, "boosting")
        random = np.random.default_rng()
        random.bit_generator.state = self.state
        marked = df.select(F.col(label).alias("y"), (F.col(key).cast("long") if key else F.monotonically_increasing_id()).alias("rid"), *self.columns)
        rows = binned(marked, self.columns, self.edges, ["y", "rid"], s.categorical).withColumn("score", F.lit(self.base))
        if self.trees:
            rows = self._advanced(rows, self.trees)
        rows, written, first = self._write(rows, f"{folder}/rows-0"), len(self.trees), len(self.trees)
        quotas = class_quotas({r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}, s.subsample) if s.subsample < 1 else None
        for t in range(first, first + more):
            seen = rows.where(sampled(rows, quotas, s.sample_seed, t)) if quotas else rows
            self.trees.append(self._tree(seen, self.trees[written:], random))
            self.state = random.bit_generator.state
            if len(self.trees) in checkpoints and callback:
                callback(len(self.trees), self)
            if (t + 1 - first) % s.write_every == 0 and t + 1 < first + more:
                rows = self._write(self._advanced(rows, self.trees[written:]), f"{folder}/rows-{t + 1}")
                written = len(self.trees)
        return self

    @staticmethod
    def _write(rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _advanced(self, rows: DataFrame, trees: list[list[Node]]) -> DataFrame:
        width, rate = len(self.columns), self.settings.rate

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                start = batch.column("score").to_numpy(zero_copy_only=False)
                found = scores(trees, _matrix(batch.column("bins"), width), start, rate) if batch.num_rows else start
                yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("rid"), batch.column("bins"), pa.array(found)], ["y", "rid", "bins", "score"])

        own = rows.select("y", "rid", "bins", "score")
        return own.mapInArrow(run, own.schema)

    def _histograms(self, rows: DataFrame, done: list[list[Node]], tree: list[Node], active: list[int], features: np.ndarray) -> np.ndarray:
        """(active, feature, 256, 3): count, gradient and hessian of each bin."""
        s, width = self.settings, len(self.columns)
        shape = (len(active), len(features), 256, 3)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, y = _matrix(batch.column("bins"), width), batch.column("y").to_numpy(zero_copy_only=False)
                score = scores(done, bins, batch.column("score").to_numpy(zero_copy_only=False), s.rate)
                p = 0.5 * (1 + np.tanh(0.5 * score))
                weight = np.where(y == 1, s.positive_weight, 1.0)
                at = route(tree, bins)
                place = np.full(len(tree), -1)
                place[active] = np.arange(len(active))
                node = place[at]
                own = node >= 0
                g, h = (weight * (p - y))[own], (weight * np.maximum(p * (1 - p), 1e-12))[own]
                for j, f in enumerate(features):
                    key = node[own] * 256 + bins[own, f]
                    for k, w in enumerate((None, g, h)):
                        total[:, j, :, k] += np.bincount(key, w, 256 * len(active)).reshape(-1, 256)
            flat = np.flatnonzero(total.reshape(-1, 3).any(axis=1))
            yield pa.RecordBatch.from_pydict({"i": flat, "c": total.reshape(-1, 3)[flat, 0], "g": total.reshape(-1, 3)[flat, 1], "h": total.reshape(-1, 3)[flat, 2]})

        parts = rows.select("y", "bins", "score").mapInArrow(run, "i long, c double, g double, h double")
        out = np.zeros((int(np.prod(shape[:3])), 3))
        # a row for each bin that is not empty, in one job
        found = parts.groupBy("i").agg(F.sum("c").alias("c"), F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        out[found.column("i").to_numpy()] = np.column_stack([found.column(c).to_numpy() for c in "cgh"])
        return out.reshape(shape)

    def _draw(self, random: np.random.Generator) -> np.ndarray:
        width, most = len(self.columns), self.settings.max_features
        if most is None or most >= width:
            return np.arange(width)
        return np.sort(random.choice(width, size=most, replace=False))

    def _bins(self, f: int) -> int:
        return max(1, len(self.edges[f])) if self.columns[f] in self.settings.categorical else len(self.edges[f]) + 1

    def _order(self, f: int, sums: np.ndarray) -> np.ndarray | None:
        """The bins of a categorical column that a node has, by gradient over hessian; else None."""
        if self.columns[f] not in self.settings.categorical:
            return None
        seen = np.flatnonzero(sums[:MISSING, 0])
        return seen[np.argsort(sums[seen, 1] / sums[seen, 2], kind="stable")]

    def best_split(self, sums: np.ndarray, features: np.ndarray) -> tuple[float, int, int, bool] | None:
        """Gain, feature, bin and side of missing of one node; the first best wins."""
        s = self.settings
        best = None
        count, grad, hess = sums[0, :, :].sum(axis=0)
        score = lambda g, h: g * g / (h + s.l2)
        for j, f in enumerate(features):
            bins = self._bins(f)
            lost = sums[j, MISSING]
            if bins < 2 and lost[0] == 0:
                continue
            order = self._order(f, sums[j])
            if order is not None:
                if not len(order):
                    continue
                bins = len(order)
            ahead = np.cumsum(sums[j, :bins] if order is None else sums[j, order], axis=0)
            last = bins if order is not None or self.exact[f] or (lost[0] > 0 and s.missing_boundary) else max(bins - 1, 1)
            # bins ascending, missing right before missing left
            left = np.stack([ahead[:last], ahead[:last] + lost], axis=1).reshape(-1, 3)
            right = np.array([count, grad, hess]) - left
            fits = (left[:, 0] >= s.min_leaf) & (right[:, 0] >= s.min_leaf)
            if not fits.any():
                continue
            gain = 0.5 * (score(left[:, 1], left[:, 2]) + score(right[:, 1], right[:, 2]) - score(grad, hess))
            i = int(np.argmax(np.where(fits, gain, -np.inf)))
            if best is None or gain[i] > best[0]:
                best = (float(gain[i]), int(f), i // 2, bool(i % 2))
        return best if best and best[0] > s.min_gain else None

    def _split(self, tree: list[Node], i: int, sums: np.ndarray, features: np.ndarray, found: tuple) -> None:
        _, f, split_bin, missing_left = found
        j = int(np.flatnonzero(features == f)[0])
        order, node = self._order(f, sums[j]), tree[i]
        if order is not None:
            node.categories = tuple(int(b) for b in order[: split_bin + 1])
        inside = sums[j, : split_bin + 1] if order is None else sums[j, list(node.categories)]
        left = inside.sum(axis=0) + (sums[j, MISSING] if missing_left else 0)
        right = sums[j].sum(axis=0) - left
        node.feature, node.split_bin, node.missing_left = f, split_bin, missing_left
        node.left, node.right = len(tree), len(tree) + 1
        for part in (left, right):
            tree.append(Node(-part[1] / (part[2] + self.settings.l2), depth=node.depth + 1, count=int(part[0])))

    def _grows(self, node: Node) -> bool:
        return node.depth < self.settings.depth and node.count >= 2 * self.settings.min_leaf

    def _tree(self, rows: DataFrame, done: list[list[Node]], random: np.random.Generator) -> list[Node]:
        tree = [Node(0.0)]
        levelwise = self.settings.strategy == "levelwise"
        if self.settings.strategy == "leafwise":
            return self._leafwise(rows, done, random)
        features = self._draw(random) if levelwise else np.arange(len(self.columns))
        sums = self._histograms(rows, done, tree, [0], features)
        count, grad, hess = sums[0, 0].sum(axis=0)
        tree[0].value, tree[0].count = -grad / (hess + self.settings.l2), int(count)
        if levelwise:
            active = [0]
            while active := [i for i in active if self._grows(tree[i])]:
                if active != [0]:
                    sums = self._histograms(rows, done, tree, active, features)
                before = len(tree)
                for k, i in enumerate(active):
                    if found := self.best_split(sums[k], features):
                        self._split(tree, i, sums[k], features, found)
                active = list(range(before, len(tree)))
            return tree
        # depth first, left before right, a draw for each node that may split
        waiting, known = [0], {0: sums[0]}
        while waiting:
            i = waiting.pop()
            if not self._grows(tree[i]):
                continue
            drawn = self._draw(random)
            own = known.pop(i) if i in known else self._histograms(rows, done, tree, [i], features)[0]
            if found := self.best_split(own[drawn], drawn):
                self._split(tree, i, own[drawn], drawn, found)
                waiting += [tree[i].right, tree[i].left]
        return tree

    def _leafwise(self, rows: DataFrame, done: list[list[Node]], random: np.random.Generator) -> list[Node]:
        """The leaf with the greatest gain is split next; ties go to the older leaf.

        A leaf is searched once, when it is made, and keeps its best split. Both
        children of a split are counted in one pass.
        """
        s, every = self.settings, np.arange(len(self.columns))
        tree, queue = [Node(0.0)], []

        def search(i: int, sums: np.ndarray) -> None:
            if self._grows(tree[i]):
                drawn = self._draw(random)
                if found := self.best_split(sums[drawn], drawn):
                    heapq.heappush(queue, (-found[0], i, found, sums[found[1]]))

        sums = self._histograms(rows, done, tree, [0], every)[0]
        count, grad, hess = sums[0].sum(axis=0)
        tree[0].value, tree[0].count = -grad / (hess + s.l2), int(count)
        if s.max_leaves > 1:
            search(0, sums)
        leaves = 1
        while queue and leaves < s.max_leaves:
            _, i, found, own = heapq.heappop(queue)
            self._split(tree, i, own[None], np.array([found[1]]), found)
            leaves += 1
            made = [k for k in (tree[i].left, tree[i].right) if self._grows(tree[k])]
            if leaves < s.max_leaves and made:
                for k, part in zip(made, self._histograms(rows, done, tree, made, every)):
                    search(k, part)
        return tree

    def decision(self, df: DataFrame, key: str, stages: list[int] | None = None) -> DataFrame:
        """``key, stage, score``: after all trees, or after each of ``stages``."""
        stages = sorted(stages or [len(self.trees)])
        width, rate, trees, base = len(self.columns), self.settings.rate, self.trees, self.base
        rows = binned(df, self.columns, self.edges, [key], self.settings.categorical)
        kind = rows.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, score, at = _matrix(batch.column("bins"), width), np.full(batch.num_rows, base), 0
                for stage in stages:
                    score, at = scores(trees[at:stage], bins, score, rate), stage
                    yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.full(batch.num_rows, stage, np.int32)), pa.array(score)], [key, "stage", "score"])

        return rows.mapInArrow(run, f"`{key}` {kind}, stage int, score double")

    def probabilities(self, df: DataFrame, key: str, stages: list[int] | None = None) -> DataFrame:
        """``key, stage, p``."""
        return self.decision(df, key, stages).select(key, "stage", sigmoid(F.col("score")).alias("p"))

    def predict(self, df: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
        """``key, predicted``: 1 from the threshold on."""
        return self.probabilities(df, key).select(key, (F.col("p") >= threshold).cast("int").alias("predicted"))

    def split_usage(self) -> dict[str, tuple[int, int]]:
        """Splits of each column, and those of them at depth 0 or 1."""
        splits = [n for tree in self.trees for n in tree if n.feature is not None]
        return {c: (sum(n.feature == j for n in splits), sum(n.feature == j and n.depth <= 1 for n in splits)) for j, c in enumerate(self.columns)}

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON document with everything that scoring and resuming need; nothing is overwritten."""
        doc = {
            "version": 1,
            "columns": self.columns,
            "settings": asdict(self.settings),
            "edges": [[float(e) for e in own] for own in self.edges],
            "exact": [bool(e) for e in self.exact],
            "base": self.base,
            "state": self.state,
            "trees": [[asdict(n) for n in tree] for tree in self.trees],
        }
        spark.createDataFrame([(json.dumps(doc, allow_nan=False),)], "value string").coalesce(1).write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Booster":
        doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
        if doc["version"] != 1:
            raise ValueError(f"unknown version {doc['version']}")
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in doc["settings"].items()}
        trees = [[Node(**{**n, "categories": None if n["categories"] is None else tuple(n["categories"])}) for n in tree] for tree in doc["trees"]]
        return cls(doc["columns"], Settings(**own), [np.array(e, np.float32) for e in doc["edges"]], np.array(doc["exact"]), doc["base"], trees, doc["state"])


def class_quotas(sizes: dict[int, int], share: float) -> dict[int, int]:
    """Rows of each class in a sample of ``floor(n * share)``, by largest remainders.

    A class that would get none takes a place of another.
    """
    n = sum(sizes.values())
    total = int(np.floor(n * share))
    if total < len(sizes):
        raise ValueError("the sample is too small to keep every class")
    fair = {y: total * size / n for y, size in sorted(sizes.items())}
    quota = {y: int(f) for y, f in fair.items()}
    for y in sorted(fair, key=lambda y: quota[y] - fair[y])[: total - sum(quota.values())]:
        quota[y] += 1
    for y in [y for y in quota if not quota[y]]:
        giver = max(quota, key=lambda o: quota[o] - fair[o] if quota[o] > 1 else -np.inf)
        quota[giver], quota[y] = quota[giver] - 1, 1
    return quota


def sampled(rows: DataFrame, quotas: dict[int, int], seed: int, tree: int) -> Column:
    """Whether a row is in the sample of a tree: the rows of a class with the least hashes.

    The limit of each class is found 16 bits at a time, from at most 65,536
    counts a class and pass, so no sort is needed. Hashes of different row ids
    differ, so the quota is met exactly.
    """
    mixed = F.xxhash64(F.lit(seed), F.lit(tree), F.col("rid"))
    digit = [F.shiftrightunsigned(mixed, 48 - 16 * d).bitwiseAND(0xFFFF) for d in range(4)]
    inside = F.lit(False)
    for y, quota in quotas.items():
        prefix, left = F.col("y") == y, quota
        for d in range(4):
            counts = sorted((r["v"], r["n"]) for r in rows.where(prefix).groupBy(digit[d].alias("v")).agg(F.count("*").alias("n")).toLocalIterator())
            ahead, at = 0, 0
            while at < len(counts) and ahead + counts[at][1] <= left:
                ahead += counts[at][1]
                at += 1
            below = counts[at][0] if at < len(counts) else 1 << 16
            inside = inside | (prefix & (digit[d] < below))
            left -= ahead
            if not left or at == len(counts):
                break
            prefix = prefix & (digit[d] == below)
    return inside

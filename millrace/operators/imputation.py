"""Conditional imputation: a column is predicted from binned anchor columns.

Models are fitted on training rows only, from counts and sums; a fitted model
is an expression, so that filling a table is one ``select``. Anchors are binned
from cleaned values before any filling, and filled values never feed another
model.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordered import running_totals
from millrace.functions.quantiles import quantiles
from millrace.functions.scalars import round_half_even
from millrace.operators import linear
from millrace.operators.cleaning import distinct_counts


@dataclass(frozen=True)
class Target:
    """What is filled in one column: codes by reason, and blanks of a continuous one."""

    name: str
    kind: str
    codes: dict[str, tuple[float, ...]] = field(default_factory=dict)
    blank: bool = False

    def masks(self) -> dict[str, Column]:
        """Where the raw column has each reason."""
        raw = F.col(self.name)
        found = {r: F.coalesce(raw.isin(*c), F.lit(False)) for r, c in self.codes.items() if c}
        return found | ({"blank": raw.isNull()} if self.blank else {})


@dataclass(frozen=True)
class Settings:
    anchors: tuple[str, ...]
    targets: tuple[Target, ...]
    least_observed: int = 100
    bins: int = 12
    smoothing: float = 1.0
    ridge: float = 0.01
    fill: bool = True
    #: height, weight and the index that follows from them
    index: tuple[str, str, str] | None = None

    def __post_init__(self) -> None:
        if not self.anchors or len(set(self.anchors)) < len(self.anchors):
            raise ValueError("anchors must be unique")
        if min(self.least_observed, self.bins) < 1 or self.bins > 254 or self.smoothing <= 0 or self.ridge <= 0:
            raise ValueError("wrong settings of the models")
        if self.index and any(t.name == self.index[2] and t.blank for t in self.targets):
            raise ValueError("the index is either predicted or derived")


def response_codes(missing: dict[float, str], special: list[dict]) -> dict[str, tuple[float, ...]]:
    """Unknown and refused codes; labels that leave open whether the question was asked do not count."""
    from millrace.operators.preprocessing import finite_code, plain_label

    open_ = {finite_code(v["code"]) for v in special if any(p in plain_label(v["label"]) for p in ("missing", "not asked"))}
    return {reason: tuple(c for c, r in missing.items() if r == reason and c not in open_) for reason in ("unknown", "refused")}


def fit_anchor_bins(df: DataFrame, columns: dict[str, Column], most: int) -> dict[str, Column]:
    """Bins of each column: 0 for null or unseen; each value if few, else quantiles."""
    counts = distinct_counts(df, columns)
    few = [F.array_sort(F.collect_set(x)).alias(n) for n, x in columns.items() if counts[n] <= most]
    row = df.agg(*few).first().asDict() if few else {}
    inner = [float(q) for q in np.linspace(0, 1, most + 1)[1:-1]]
    row |= {n: sorted(set(v)) for n, v in quantiles(df, {n: x for n, x in columns.items() if counts[n] > most}, inner).items()}
    out = {}
    for n, x in columns.items():
        marks = F.array(*[F.lit(float(v)) for v in row[n]]) if row[n] else F.lit(None).cast("array<double>")
        exact = F.array_position(marks, x.cast("double"))
        place = exact if counts[n] <= most else F.when(x.isNotNull(), _below(marks, x) + 1)
        out[n] = F.coalesce(place.cast("int"), F.lit(0))
    return out


def _below(marks: Column, x: Column) -> Column:
    return F.size(F.filter(marks, lambda e: e < x))


def naive_bayes(df: DataFrame, value: Column, bins: dict[str, Column], widths: dict[str, int], smoothing: float) -> Column:
    """The likeliest class, ties to the least; counts of (anchor, bin, class) come to the driver."""
    cells = df.select(value.alias("y"), F.explode(F.array(*[F.struct(F.lit(j).alias("j"), b.alias("b")) for j, b in enumerate([F.lit(0), *bins.values()])])).alias("a"))
    counts = cells.groupBy("y", "a.j", "a.b").agg(F.count("*").alias("n")).collect()
    classes = sorted({r["y"] for r in counts})
    at = {y: i for i, y in enumerate(classes)}
    prior = np.zeros(len(classes))
    tables = [np.zeros((widths[n], len(classes))) for n in bins]
    for r in counts:
        if r["j"]:
            tables[r["j"] - 1][r["b"], at[r["y"]]] = r["n"]
        else:
            prior[at[r["y"]]] = r["n"]
    score = _vector(np.log((prior + smoothing) / (prior.sum() + smoothing * len(classes))))
    for table, b in zip(tables, bins.values()):
        logs = np.log((table + smoothing) / (prior + smoothing * len(table)))
        score = F.zip_with(score, F.element_at(F.array(*map(_vector, logs)), b + 1), lambda a, c: a + c)
    return F.element_at(_vector(np.array(classes, float)), F.array_position(score, F.array_max(score)).cast("int"))


def _vector(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def ridge_on_bins(df: DataFrame, value: Column, bins: dict[str, Column], ridge: float) -> Column:
    """Ridge on standardised bins, the intercept free, clipped to the 0.1 % and 99.9 % quantiles.

    All rows count: the sums are one aggregate, so none are thinned out.
    """
    names = [f"x{j}" for j in range(len(bins))]
    rows = df.select(F.lit(1.0).alias("one"), *[b.cast("double").alias(n) for n, b in zip(names, bins.values())], value.cast("double").alias("y"))
    g, b, _, n = linear.gram(rows, "y", ["one", *names])
    means = g[0, 1:] / n
    scales = np.sqrt(np.maximum(np.diag(g)[1:] / n - means**2, 0))
    scales[scales < 1e-12] = 1.0
    # columns of the raw design to standardised ones
    turn = np.diag([1.0, *(1 / scales)])
    turn[0, 1:] = -means / scales
    penalty = ridge * n * np.diag([0.0] + [1.0] * len(names))
    w = turn @ np.linalg.solve(turn.T @ g @ turn + penalty, turn.T @ b)
    low, high = quantiles(df, {"y": value}, [0.001, 0.999])["y"]
    score = sum((x * F.lit(float(v)) for x, v in zip(bins.values(), w[1:])), F.lit(float(w[0])))
    return F.greatest(F.lit(low), F.least(F.lit(high), score))


@dataclass
class Imputer:
    """Filled columns and flags, by name, as expressions over raw rows."""

    columns: dict[str, Column]
    flags: dict[str, Column]

    def apply(self, df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, *[x.alias(n) for n, x in (self.columns | self.flags).items()])


def fit_imputer(train: DataFrame, others: list[DataFrame], clean: dict[str, Column], settings: Settings) -> Imputer:
    """Fit on ``train``; ``clean`` are the cleaned columns as expressions over raw rows.

    ``others`` are rows to be filled later: only their anchor bins are read, as
    the smoothing counts every bin that occurs. A target with too few observed
    values, or nothing to fill, stays as it is, but has its flags.
    """
    bins = fit_anchor_bins(train, {a: clean[a] for a in settings.anchors}, settings.bins)
    columns, flags = dict(clean), {}
    for t in settings.targets:
        masks = t.masks()
        if not masks:
            continue
        flags |= {f"{t.name}__was_{r}": m.cast("int") for r, m in masks.items()}
        missing = reduce(lambda a, b: a | b, masks.values())
        used = {n: b for n, b in bins.items() if n != t.name}
        sizes = [F.count(F.when(missing, 1)).alias("missing"), F.count(F.when(~missing, clean[t.name])).alias("observed")]
        stats = train.agg(*sizes, *[F.max(b).alias(f"w{j}") for j, b in enumerate(used.values())]).first()
        ahead = [o.where(missing).agg(F.count("*").alias("missing"), *[F.max(b).alias(f"w{j}") for j, b in enumerate(used.values())]).first() for o in others]
        if not settings.fill or stats["observed"] < settings.least_observed or not stats["missing"] + sum(a["missing"] for a in ahead):
            continue
        rows = train.where(~missing & clean[t.name].isNotNull())
        if t.kind == "continuous":
            predicted = ridge_on_bins(rows, clean[t.name], used, settings.ridge)
        else:
            widths = {n: 1 + max(s[f"w{j}"] or 0 for s in (stats, *ahead)) for j, n in enumerate(used)}
            predicted = naive_bayes(rows, clean[t.name].cast("double"), used, widths, settings.smoothing)
        columns[t.name] = F.when(missing, predicted).otherwise(clean[t.name])
    if settings.index:
        height, weight, index = settings.index
        flags[f"{index}__was_blank"] = clean[index].isNull().cast("int")
        if settings.fill:
            low, high = train.agg(F.min(clean[index]), F.max(clean[index])).first()
            h, w = columns[height], columns[weight]
            derived = F.when((h > 0) & (w > 0), round_half_even(F.try_divide(w, h * h), 2))
            columns[index] = F.coalesce(clean[index], F.when(derived.between(low, high), derived))
    return Imputer(columns, flags)


def thinned(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows at even steps of the order by ``key``, first and last included."""
    n = df.count()
    if n <= most:
        return df
    if most < 2:
        return df.orderBy(key).limit(most)
    place = F.col("__place") - 1
    step = F.ceil(place * (most - 1) / (n - 1))
    placed = running_totals(df.withColumn("__one", F.lit(1)), [F.col(key)], {"__place": "__one"})
    return placed.where(F.floor(step * (n - 1) / (most - 1)) == place).select(*df.columns)

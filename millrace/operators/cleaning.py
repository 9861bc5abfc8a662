"""Codebook-aware cleaning: which codes are missing, zero, valid or binary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.quantiles import medians, quantiles


@dataclass(frozen=True)
class Codes:
    """Documented codes of one column: reason by missing code, codes of zero."""

    missing: dict[float, str] = field(default_factory=dict)
    zero: tuple[float, ...] = ()


def cleaned(column: Column, codes: Codes) -> Column:
    """Missing codes to null, then zero codes to 0."""
    out = F.when(column.isin(list(codes.missing)), None).otherwise(column) if codes.missing else column
    return F.when(out.isin(list(codes.zero)), 0).otherwise(out) if codes.zero else out


def reason_flag(column: Column, codes: Codes, reason: str) -> Column:
    """1 where a value is missing for this reason; blank includes null."""
    own = [c for c, r in codes.missing.items() if r == reason]
    found = column.isin(own) if own else F.lit(False)
    found = F.coalesce(found, F.lit(False))
    return (found | column.isNull() if reason == "blank" else found).cast("int")


def retained(columns: list[str], excluded: set[str], kinds: dict[str, str], modelled: set[str]) -> list[str]:
    """Columns to keep, in order; unknown exclusions are an error."""
    if unknown := excluded - set(columns):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return [c for c in columns if c not in excluded and kinds.get(c, "continuous") in modelled]


def binary_mapping(labels: dict[float, str], observed: list[float]) -> dict[float, float]:
    """Two observed values: yes and no by their labels, else in order; one: 0; more: none."""
    named = {c: {"yes": 1.0, "no": 0.0}.get(t.strip().lower()) for c, t in labels.items()}
    if len(observed) == 2 and all(named.get(v) is not None for v in observed):
        return {v: named[v] for v in observed}
    return {v: float(i) for i, v in enumerate(sorted(observed))} if len(observed) <= 2 else {}


def mapped(column: Column, mapping: dict[float, float]) -> Column:
    """All codes at once, so that a swap of two codes does not collapse."""
    out = column
    for code, value in mapping.items():
        out = F.when(column == code, value).otherwise(out)
    return out


@dataclass(frozen=True)
class Filled:
    """Fitted state of one numeric column."""

    name: str
    fill: float
    mean: float
    scale: float
    missing_share: float


def fit_fills(df: DataFrame, rules: dict[str, str]) -> list[Filled]:
    """Fill by ``median`` or ``mode`` (ties to the lowest), then moments of the filled column.

    A few aggregations over all columns together; a row comes back for each.
    """
    coded = [F.mode(F.col(c), True).cast("double").alias(c) for c, rule in rules.items() if rule != "median"]
    fills = (df.agg(*coded).first().asDict() if coded else {}) | medians(df, {c: F.col(c) for c, rule in rules.items() if rule == "median"})
    value = {c: float(fills[c]) if fills[c] is not None else 0.0 for c in rules}
    filled = {c: F.coalesce(F.col(c), F.lit(value[c])) for c in rules}
    row = df.agg(
        *[F.avg(x).alias(f"m_{c}") for c, x in filled.items()],
        *[F.stddev_pop(x).alias(f"s_{c}") for c, x in filled.items()],
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"n_{c}") for c in rules],
    ).first()
    return [Filled(c, value[c], row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0, row[f"n_{c}"] or 0.0) for c in rules]


def scaled(state: Filled) -> Column:
    return (F.coalesce(F.col(state.name), F.lit(state.fill)) - F.lit(state.mean)) / F.lit(state.scale)


def missing_flags(df: DataFrame, states: list[Filled], least_share: float) -> dict[str, Column]:
    """An indicator for each column that training rows miss often enough."""
    return {f"{s.name}__missing": F.col(s.name).isNull().cast("int") for s in states if s.missing_share >= least_share and s.missing_share > 0}


def distinct_counts(df: DataFrame, columns: dict[str, Column]) -> dict[str, int]:
    """Distinct values of each column, without null; cells are reduced before any shuffle.

    One aggregation over (column, value), so that wide tables are not repeated
    once a column.
    """
    if not columns:
        return {}
    names = list(columns)
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), columns[n].cast("string").alias("v")) for i, n in enumerate(names)]))).where("v is not null")
    found = {r["i"]: r["n"] for r in cells.distinct().groupBy("i").agg(F.count("*").alias("n")).collect()}
    return {n: found.get(i, 0) for i, n in enumerate(names)}


def vocabularies(df: DataFrame, columns: dict[str, Column], most: int = 10_000) -> dict[str, list]:
    """The values of each column, sorted, in one row; more than ``most`` are an error."""
    counts = distinct_counts(df, columns)
    if too_many := [n for n, k in counts.items() if k > most]:
        raise ValueError(f"more than {most} values: {too_many}")
    if not columns:
        return {}
    row = df.agg(*[F.array_sort(F.collect_set(x)).alias(f"v{i}") for i, x in enumerate(columns.values())]).first()
    return {n: list(row[i]) for i, n in enumerate(columns)}


def categories(df: DataFrame, column: str) -> list:
    """The training vocabulary, sorted."""
    return vocabularies(df, {column: F.col(column)})[column]


def one_hot(column: str, values: list, mode: str, own: Column | None = None) -> dict[str, Column]:
    """Indicators of a category, by three rules.

    ``linear``: without the lowest value, with ``__missing``; unseen is all 0.
    ``tree``: every value and ``__unknown``, null where the value is null.
    ``mlp``: every value, ``__missing`` and ``__unseen``.

    A number gives ``__is_<number>``, text ``__<text>``.
    """
    own = F.col(column) if own is None else own
    named = lambda v: f"{column}__{v}" if isinstance(v, str) else f"{column}__is_{v:g}"
    hit = lambda v: F.coalesce((own == v), F.lit(False)).cast("int")
    unseen = own.isNotNull() & ~own.isin(list(values))
    if mode == "linear":
        return {named(v): hit(v) for v in values[1:]} | {f"{column}__missing": own.isNull().cast("int")}
    if mode == "tree":
        found = {named(v): (own == v).cast("int") for v in values}
        return found | {f"{column}__unknown": F.when(own.isNotNull(), unseen.cast("int"))}
    return {named(v): hit(v) for v in values} | {f"{column}__missing": own.isNull().cast("int"), f"{column}__unseen": F.coalesce(unseen, F.lit(False)).cast("int")}


def hinge(column: Column, fill: float, knot: float) -> Column:
    return F.greatest(F.coalesce(column, F.lit(fill)) - knot, F.lit(0.0))


def hinge_terms(df: DataFrame, column: str, shares: list[float]) -> dict[str, Column]:
    """Standardised hinges at training quantiles, ``<column>__hinge_q<q>``."""
    fill, *knots = quantiles(df, {column: F.col(column)}, [0.5, *shares])[column]
    terms = {f"{column}__hinge_q{q:g}": hinge(F.col(column), fill, k) for q, k in zip(shares, knots)}
    row = df.agg(*[f(x).alias(f"{f.__name__}_{n}") for n, x in terms.items() for f in (F.avg, F.stddev_pop)]).first()
    return {n: (x - row[f"avg_{n}"]) / (row[f"stddev_pop_{n}"] or 1.0) for n, x in terms.items()}


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[str, Column]:
    """Products, centred and scaled on the training rows, ``A__times__B``."""
    terms = {f"{a}__times__{b}": F.col(a) * F.col(b) for a, b in pairs}
    row = df.agg(*[f(x).alias(f"{f.__name__}_{n}") for n, x in terms.items() for f in (F.avg, F.stddev_pop)]).first()
    return {n: (x - row[f"avg_{n}"]) / (row[f"stddev_pop_{n}"] or 1.0) for n, x in terms.items()}


#: Frequency codes by kind: per day, week and month from these hundreds, and what means never.
FREQUENCIES = {"food": ({"per_day": 100, "per_week": 200, "per_month": 300}, (0.0, 555.0)), "week_month": ({"per_week": 100, "per_month": 200}, (0.0,))}
_DAYS = {"per_day": 1.0, "per_week": 7.0, "per_month": 30.0}


def daily_rate(code: Column, kind: str = "food") -> Column:
    """Frequency codes as a daily rate; 300 (less than monthly) is 0, other codes are an error."""
    units, never = FREQUENCIES[kind]
    rate = F.when(code.isNull(), None).when(code.isin(*never, *([300.0] if kind == "food" else [])), 0.0)
    for unit, base in units.items():
        rate = rate.when(code.between(base + 1, base + 99), (code - float(base)) / _DAYS[unit])
    return rate.otherwise(F.raise_error(F.concat(F.lit("unexpected frequency code "), code.cast("string"))).cast("double"))


def frequency_flags(code: Column, kind: str = "food") -> dict[str, Column]:
    """The unit of a code, and ``less_than_monthly``; 0 where the code is null."""
    flags = {unit: code.between(base + 1, base + 99) for unit, base in FREQUENCIES[kind][0].items()}
    if kind == "food":
        flags["less_than_monthly"] = code == 300
    return {name: F.coalesce(flag, F.lit(False)).cast("int") for name, flag in flags.items()}


def group_counts(columns: list[str], yes: float = 1, no: float = 2) -> tuple[Column, Column]:
    """Yes answers (null if nothing was answered) and answers of a group."""
    answered = sum((F.coalesce(F.col(c).isin(yes, no), F.lit(False)).cast("int") for c in columns), F.lit(0))
    said = sum((F.coalesce(F.col(c) == yes, F.lit(False)).cast("int") for c in columns), F.lit(0))
    return F.when(answered > 0, said), answered

"""Scalar expressions: labels, codes, stable logistic mathematics, hashes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise_label(label: Column) -> Column:
    """Trimmed, lower-cased, straight quotes, single spaces."""
    return F.regexp_replace(F.translate(F.lower(F.trim(label)), "’´", "''"), r"\s+", " ")


def finite_code(code: Column) -> Column:
    """A code as a number; null for blank and for what is no number."""
    return F.trim(code).try_cast("double")


# How labels begin that stand for an answer, and what marks each reason, the first of which holds.
SUBSTANTIVE_STARTS = ("no missing", "not missing", "included", "has ")
REASON_MARKS = {"unknown": ("don't know", "dont know", "not sure"), "refused": ("refused",), "blank": ("not asked",)}
BLANK_WORD = "missing"


def missing_reason(label: Column) -> Column:
    """``unknown``, ``refused`` or ``blank``; null for a substantive label. Unknown wins, then refused."""
    text = normalise_label(label)
    any_of = lambda parts: reduce(lambda x, y: x | y, parts)
    out = F.when((text == "") | any_of(text.startswith(p) for p in SUBSTANTIVE_STARTS), None)
    for reason, marks in REASON_MARKS.items():
        holds = any_of(text.contains(m) for m in marks)
        out = out.when(holds | (text == BLANK_WORD) | text.startswith(BLANK_WORD + " ") if reason == "blank" else holds, reason)
    return out


@F.pandas_udf(T.StringType())
def fifteen_digits(value: pd.Series) -> pd.Series:
    """15 significant digits of the exact value, no zeros at the end, scientific below 1e-4 and from 1e15 on.

    Built-in functions round the shortest decimal form, and so a few ties wrongly.
    """
    return value.map(lambda x: None if pd.isna(x) else format(x, ".15g"))


def canonical_number(value: Column) -> Column:
    """Whole numbers without a point, others with 15 digits, ``<MISSING>`` for null and NaN.

    For distinct values: all of them pass through Arrow.
    """
    number = value.cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    known = number.isNotNull() & ~F.isnan(number)
    return F.when(~known, "<MISSING>").when(whole, number.cast("bigint").cast("string")).otherwise(fifteen_digits(number))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def sigmoid(x: Column) -> Column:
    """Stable on both sides: the exponent is never positive."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def log_loss_term(y: Column, p: Column, epsilon: float = 1e-15) -> Column:
    clipped = F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), p))
    return -(y * F.ln(clipped) + (1 - y) * F.log1p(-clipped))


def round_half_even(x: Column, digits: int) -> Column:
    return F.rint(x * 10.0**digits) / 10.0**digits


def in_intervals(value: Column, intervals: list[tuple[float, float]]) -> Column:
    """Inside a documented interval, with a relative tolerance at its bounds."""
    found = F.lit(False)
    for low, high in intervals:
        below, above = (max(1e-9, 1e-10 * abs(b)) for b in (low, high))
        found = found | value.between(low - below, high + above)
    return found


def row_digest(*columns: Column) -> Column:
    """SHA-256 of a row; null and empty differ from each other and from text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]), 256)


def sampling_order(seed: int | str, *key: Column) -> Column:
    """A seeded order of rows that does not depend on their layout."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))

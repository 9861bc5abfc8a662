"""Checks of written results: manifests of files, reports against recomputed tables, strict JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size, sha256`` of every file below ``folder``; hashed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", r"^.*/", "").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_faults(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``path, fault``: files that are ``missing``, ``changed`` or ``unexpected``."""
    both = expected.select("path", F.col("sha256").alias("__want")).join(found.select("path", "sha256"), "path", "full_outer")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("__want").isNull(), "unexpected").when(F.col("sha256") != F.col("__want"), "changed")
    return both.select("path", fault.alias("fault")).where("fault is not null")


def report_faults(report: DataFrame, recomputed: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """``key, column, reported, recomputed``: cells of a report that a new computation does not give.

    Numbers are compared after rounding; a row on one side only differs in every column.
    Of two numbers on either side of a rounding edge, which sums over rows in another order
    give, those agree that are within a thousandth of the last digit or 1e-12 of the larger.
    """
    columns = [c for c in recomputed.columns if c != key]
    kinds = dict(recomputed.dtypes)

    def cell(c: str) -> Column:
        if kinds[c] not in ("double", "float"):
            return F.struct(F.col(c).cast("string").alias("shown"), F.lit(None).cast("double").alias("number"))
        number = F.col(c).cast("double")
        rounded = F.round(number, digits)
        return F.struct(F.when(rounded == 0, 0.0).otherwise(rounded).cast("string").alias("shown"), number.alias("number"))

    sides = [df.select(F.col(key).cast("string").alias("key"), *[cell(c).alias(c) for c in columns]).unpivot("key", columns, "column", value) for df, value in ((report, "reported"), (recomputed, "recomputed"))]
    x, y = F.col("reported.number"), F.col("recomputed.number")
    apart, slack = F.abs(x - y), F.greatest(F.lit(10.0 ** -(digits + 3)), 1e-12 * F.greatest(F.abs(x), F.abs(y)))
    close = F.coalesce((apart <= slack) & (apart < float("inf")), F.lit(False))
    differs = ~F.col("reported.shown").eqNullSafe(F.col("recomputed.shown")) & ~close
    shown = [F.col(f"{side}.shown").alias(side) for side in ("reported", "recomputed")]
    return sides[0].join(sides[1], ["key", "column"], "full_outer").where(differs).select("key", "column", *shown)


def dumped(document: object) -> str:
    """JSON without NaN or infinity, with sorted keys."""
    return json.dumps(document, allow_nan=False, sort_keys=True)


def loaded(text: str) -> object:
    """JSON in which NaN and infinity are errors."""

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, parse_constant=refuse)


def strings_in(document: object, wanted: Callable[[str], bool], path: str = "") -> Iterator[tuple[str, str]]:
    """Path and value of every string value that is ``wanted``, however deep."""
    waiting = [(path, document)]
    while waiting:
        at, own = waiting.pop()
        if isinstance(own, str):
            if wanted(own):
                yield at, own
        elif isinstance(own, dict):
            waiting += [(f"{at}.{k}" if at else k, v) for k, v in reversed(own.items())]
        elif isinstance(own, list):
            waiting += [(f"{at}[{i}]", v) for i, v in reversed(list(enumerate(own)))]


def chunks(df: DataFrame, key: str, columns: list[str], rows: int = 2048) -> Iterator[tuple[int, list, np.ndarray]]:
    """First place, keys and a matrix of ``rows`` rows at a time, in the order of ``df``; null is NaN.

    For consumers on the driver: one partition is held at a time.
    """
    start, keys, values = 0, [], []
    for r in df.select(key, *columns).toLocalIterator():
        keys.append(r[0])
        values.append([np.nan if x is None else float(x) for x in r[1:]])
        if len(keys) == rows:
            yield start, keys, np.array(values)
            start, keys, values = start + rows, [], []
    if keys:
        yield start, keys, np.array(values)


def write_matrix(df: DataFrame, key: str, columns: list[str], path: str, rows: int = 2048) -> np.ndarray:
    """The cells in a memory-mapped ``.npy`` file on the driver, filled while ``df`` is scanned."""
    out = np.lib.format.open_memmap(path, "w+", np.float64, (df.count(), len(columns)))
    for start, keys, part in chunks(df, key, columns, rows):
        out[start : start + len(keys)] = part
    out.flush()
    return out

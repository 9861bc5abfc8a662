"""One-pass column profiles, drift between samples, duplicate rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.quantiles import quantiles
from millrace.functions.scalars import canonical_number, row_digest


def long_form(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep, feature, value``: a row for each cell, values as doubles."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keep, columns, "feature", "value")


def moments(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows, missing, mean, population deviation, least and greatest of each column."""
    cells = long_form(df, columns, by or [])
    value = F.col("value")
    return cells.groupBy("feature", *(by or [])).agg(
        F.count("*").alias("rows"),
        F.count(F.when(value.isNull(), 1)).alias("missing"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def standardised_difference(df: DataFrame, columns: list[str], target: Column) -> DataFrame:
    """``feature, smd``: difference of class means over the pooled deviation."""
    aggs = []
    for c in columns:
        for y in (0, 1):
            own = F.when(target == y, F.col(c).cast("double"))
            aggs += [F.avg(own).alias(f"m{y}_{c}"), F.var_pop(own).alias(f"v{y}_{c}")]
    wide = df.agg(*aggs)
    parts = [
        F.struct(F.lit(c).alias("feature"), F.try_divide(F.col(f"m1_{c}") - F.col(f"m0_{c}"), F.sqrt((F.col(f"v1_{c}") + F.col(f"v0_{c}")) / 2)).alias("smd"))
        for c in columns
    ]
    return wide.select(F.inline(F.array(*parts)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    # named once a distinct value; two that share 15 digits are one
    counts = df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    return counts.select(canonical_number(F.col("v")).alias("value"), "n").groupBy("value").agg(F.sum("n").alias("n"))


def bounded_value_counts(df: DataFrame, column: str, cap: int) -> DataFrame:
    """Counts of the ``cap`` smallest values; the others together as ``<OTHER>``."""
    counts = df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    kept = counts.where("v is not null").orderBy("v").limit(cap).select("v", F.lit(True).alias("kept"))
    joined = counts.join(kept, "v", "left")
    name = F.when(F.col("v").isNull() | F.col("kept"), canonical_number(F.col("v"))).otherwise("<OTHER>")
    return joined.groupBy(name.alias("value")).agg(F.sum("n").alias("n"))


def total_variation(left: DataFrame, right: DataFrame, value: str = "value", n: str = "n") -> DataFrame:
    """Half the sum of differences of two distributions; 0 if a side is empty."""
    l, r = left.select(value, F.col(n).alias("a")), right.select(value, F.col(n).alias("b"))
    both = l.join(r, value, "full_outer").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    sums = both.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb")).first()
    if not sums["sa"] or not sums["sb"]:
        return both.agg(F.lit(0.0).alias("total_variation"))
    return both.agg((0.5 * F.sum(F.abs(F.col("a") / sums["sa"] - F.col("b") / sums["sb"]))).alias("total_variation"))


def target_rates(df: DataFrame, value: Column, target: Column, least: int = 100, share: float = 0.001) -> DataFrame:
    """``value, n, positives, rate, lift`` of values with enough support."""
    total, positives = df.agg(F.count("*"), F.sum(target)).first()
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.sum(target).alias("positives"))
    rate = F.col("positives") / F.col("n")
    return counts.where(F.col("n") >= max(least, share * total)).select("value", "n", "positives", rate.alias("rate"), F.try_divide(rate, F.lit((positives or 0) / max(total, 1))).alias("lift"))


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct inner quantiles, interpolated."""
    inner = [i / bins for i in range(1, bins)]
    found = quantiles(df, {column: F.col(column)}, inner)[column]
    return sorted(set(found or []))


def bin_of(column: Column, edges: list[float]) -> Column:
    """Number of edges at or below the value; null for null."""
    return F.when(column.isNull(), None).otherwise(sum(((column >= e).cast("int") for e in edges), F.lit(0)))


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    return df.groupBy(bin_of(F.col(column), edges).alias("bin")).agg(F.count("*").alias("n"))


def duplicate_rows(df: DataFrame, columns: list[str], label: Column) -> DataFrame:
    """``digest, n, labels``: rows that occur more than once; 3 if their labels conflict."""
    grouped = df.groupBy(row_digest(*[F.col(c) for c in columns]).alias("digest"))
    return grouped.agg(F.count("*").alias("n"), F.bit_or(F.when(label == 1, 2).otherwise(1)).alias("labels")).where("n > 1")


def row_overlap(df: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``df`` that also occur in ``other``."""
    digests = other.select(row_digest(*[F.col(c) for c in columns]).alias("__digest"))
    return df.withColumn("__digest", row_digest(*[F.col(c) for c in columns])).join(digests, "__digest", "left_semi").drop("__digest")


def duplicate_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``left, right`` pairs of equal columns.

    Columns with the same profile are candidates, and only these are compared,
    cell by cell, in one more scan. The profile has no sum of floats, which would
    depend on the order of the rows.
    """
    value = F.col("value")
    found = long_form(df, columns, []).groupBy("feature").agg(
        F.count(value).alias("known"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(F.xxhash64(value).cast("decimal(38,0)")).alias("mark")
    )
    stats: dict[tuple, list[str]] = {}
    for r in found.collect():
        stats.setdefault((r["known"], r["min"], r["max"], r["mark"]), []).append(r["feature"])
    pairs = [(a, b) for group in stats.values() for i, a in enumerate(sorted(group)) for b in sorted(group)[i + 1 :]]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "left string, right string")
    equal = df.agg(*[F.count(F.when(~F.col(a).eqNullSafe(F.col(b)), 1)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return spark.createDataFrame([p for i, p in enumerate(pairs) if equal[i] == 0], "left string, right string")


def cardinality_band(n: Column) -> Column:
    return F.when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 50, "11-50").when(n <= 256, "51-256").otherwise(">256")


def missing_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``rows, cells, missing, rows_with_missing, most_in_a_row``, one scan."""
    lost = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.agg(F.count("*").alias("rows"), (F.count("*") * len(columns)).alias("cells"), F.sum(lost).alias("missing"), F.count(F.when(lost > 0, 1)).alias("rows_with_missing"), F.max(lost).alias("most_in_a_row"))


def duplicate_summary(train: DataFrame, test: DataFrame, columns: list[str], label: Column) -> DataFrame:
    """Groups of equal training rows, how many conflict in their label, and training rows found in the test rows."""
    groups = duplicate_rows(train, columns, label)
    conflict = F.count(F.when(F.col("labels") == 3, 1))
    counts = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), conflict.alias("conflicting_groups"))
    shared = row_overlap(train, test, columns).agg(F.count("*").alias("rows_in_test"))
    return counts.crossJoin(shared)  # one row each


def largest_groups(groups: DataFrame, most: int = 20) -> DataFrame:
    return groups.orderBy(F.desc("n"), "digest").limit(most)


def category_order(values: DataFrame, value: str = "value") -> DataFrame:
    """Numbers ascending, then text, missing last; adds ``place``. A row for each value."""
    number = F.col(value).try_cast("double")
    listed = values.agg(F.array_sort(F.collect_list(F.struct((F.col(value) == "<MISSING>").alias("m"), number.isNull().alias("t"), number.alias("n"), F.struct(*values.columns).alias("row")))).alias("all"))
    return listed.select(F.posexplode("all")).select((F.col("pos") + 1).alias("place"), "col.row.*")


def top_values(left: DataFrame, right: DataFrame, most: int = 10) -> DataFrame:
    """The commonest values of two counted samples (``value, n``) with their shares."""
    both = left.select("value", F.col("n").alias("a")).join(right.select("value", F.col("n").alias("b")), "value", "full_outer")
    both = both.select("value", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    totals = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    shares = both.join(F.broadcast(totals)).select("value", F.try_divide("a", "ta").alias("left_share"), F.try_divide("b", "tb").alias("right_share"), (F.col("a") + F.col("b")).alias("n"))  # totals: one row
    return shares.orderBy(F.desc("n"), "value").limit(most)

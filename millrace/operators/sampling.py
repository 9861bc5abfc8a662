"""Stratified splits, folds and undersampling by a seeded hash order.

Ranks within a class come from a distributed running count, so that no class
has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordered import running_totals
from millrace.functions.scalars import sampling_order


def class_ranks(df: DataFrame, label: str, key: str, seed: int | str, order: list[Column] | None = None) -> DataFrame:
    """Adds ``place`` (from 1, within the class) and ``class_size``."""
    marked = df.withColumn("__one", F.lit(1)).withColumn("__order", sampling_order(seed, F.col(key)))
    by = [F.col(label), *(order or []), F.col("__order"), F.col(key)]
    ranked = running_totals(marked, by, {"__place": "__one"})
    sizes = df.groupBy(label).agg(F.count("*").alias("class_size"))
    before = sizes.select(F.col(label).alias("__other"), F.col("class_size").alias("__n"))
    ahead = sizes.join(before, F.col("__other") < F.col(label), "left").groupBy(label, "class_size").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__ahead"))
    joined = ranked.join(F.broadcast(ahead), label)  # a row for each class
    return joined.select(*df.columns, "class_size", (F.col("__place") - F.col("__ahead")).alias("place"))


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int | str) -> DataFrame:
    """Adds ``fold``: each class in equal runs, the first ones one row longer."""
    ranked = class_ranks(df, label, key, seed)
    base, extra = F.floor(F.col("class_size") / folds), F.col("class_size") % folds
    place = F.col("place") - 1
    long_rows = extra * (base + 1)
    fold = F.when(place < long_rows, F.floor(place / (base + 1))).otherwise(extra + F.floor((place - long_rows) / F.greatest(base, F.lit(1))))
    return ranked.withColumn("fold", fold.cast("int")).drop("place", "class_size")


def stratified_split(df: DataFrame, label: str, key: str, fraction: float, seed: int | str, keep_both: bool = False) -> DataFrame:
    """Adds ``validation``: a share of each class, rounded half to even.

    ``keep_both``: at least one row of each class on either side.
    """
    ranked = class_ranks(df, label, key, seed)
    size = F.bround(F.col("class_size") * F.lit(fraction), 0)
    if keep_both:
        size = F.greatest(F.lit(1), F.least(F.col("class_size") - 1, size))
    return ranked.withColumn("validation", F.col("place") <= size).drop("place", "class_size")


def undersample(df: DataFrame, label: str, key: str, ratio: int, seed: int | str) -> DataFrame:
    """All positives, and ``ratio`` negatives for each; larger ratios contain smaller ones."""
    positives = df.where(F.col(label) == 1).count()
    return class_ranks(df, label, key, seed).where((F.col(label) == 1) | (F.col("place") <= ratio * positives)).drop("place", "class_size")


def undersample_hard(df: DataFrame, label: str, key: str, score: str, ratio: int, seed: int | str) -> DataFrame:
    """Half the negatives at random, the other half those with the highest pilot score."""
    positives = df.where(F.col(label) == 1).count()
    wanted = ratio * positives
    random = undersample(df, label, key, ratio, seed) if wanted == 0 else class_ranks(df, label, key, seed).where((F.col(label) == 1) | (F.col("place") <= wanted // 2)).drop("place", "class_size")
    rest = df.join(random.select(key), key, "left_anti").where(F.col(label) == 0)
    hard = first_rows(rest, [F.desc(score), F.col(key)], wanted - wanted // 2)
    return random.select(*df.columns).unionByName(hard.select(*df.columns))


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in order; no task sees more than its range, however large ``n``."""
    return running_totals(df.withColumn("__one", F.lit(1)), order, {"__place": "__one"}).where(F.col("__place") <= n).select(*df.columns)


def uniform_sample(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    return first_rows(df, [sampling_order(seed, F.col(key)), F.col(key)], n)


def coverage_faults(df: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """Rows that are not in exactly one fold; empty if the folds cover ``df``."""
    seen = folds.groupBy(key).agg(F.count("*").alias("n"))
    return df.select(key).join(seen, key, "full_outer").where(F.col("n").isNull() | (F.col("n") != 1))

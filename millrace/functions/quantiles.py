"""Exact interpolated quantiles of many columns, in bounded memory.

The built-in ``percentile`` keeps every distinct value of a column in memory.
That is the fast way for coded and rounded columns; columns with more values
are counted by value, put into a distributed order, and only the rows at the
wanted places come to the driver. Both ways give the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordered import running_totals

#: distinct values of all columns together that one aggregation may hold
IN_MEMORY = 2_000_000


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], in_memory: int = IN_MEMORY) -> dict[str, list[float] | None]:
    """Linear interpolation between neighbours; None for a column without values."""
    if not columns:
        return {}
    own = {n: x.cast("double") for n, x in columns.items()}
    sizes = df.agg(*[F.approx_count_distinct(x, 0.02).alias(n) for n, x in own.items()]).first()
    small, held = [], 0
    for n in sorted(own, key=lambda n: sizes[n]):
        held += sizes[n]
        if held > in_memory:
            break
        small.append(n)
    wanted = F.array(*[F.lit(float(q)) for q in shares])
    row = df.agg(*[F.percentile(own[n], wanted).alias(n) for n in small]).first() if small else {}
    found = {n: None if row[n] is None else list(row[n]) for n in small}
    return found | _by_order(df, {n: x for n, x in own.items() if n not in found}, shares)


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    return {n: v[0] if v else None for n, v in quantiles(df, columns, [0.5]).items()}


def _by_order(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float] | None]:
    if not columns:
        return {}
    names = list(columns)
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), columns[n].alias("v")) for i, n in enumerate(names)]))).where("v is not null")
    counts = cells.groupBy("i", "v").agg(F.count("*").alias("n"))
    placed = running_totals(counts, [F.col("i"), F.col("v")], {"upto": "n"}).persist()
    totals = {r["i"]: r["n"] for r in placed.groupBy("i").agg(F.sum("n").alias("n")).collect()}
    ahead, places = 0, {}
    for i in sorted(totals):
        spots = [q * (totals[i] - 1) for q in shares]
        places[i] = (ahead, spots)
        ahead += totals[i]
    spans = [(a + p, i) for i, (a, spots) in places.items() for p in sorted({f(s) for s in spots for f in (math.floor, math.ceil)})]
    value = {}
    if spans:
        # a few places a column, so they fit beside every partition
        asked = F.broadcast(df.sparkSession.createDataFrame(spans, "place long, i int").groupBy("i").agg(F.collect_list("place").alias("places")))
        hits = placed.join(asked, "i").select("v", F.explode(F.filter("places", lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))).alias("place"))
        value = {r["place"]: r["v"] for r in hits.collect()}
    placed.unpersist()

    def between(start: int, spot: float) -> float:
        low, high = math.floor(spot), math.ceil(spot)
        a, b = value[start + low], value[start + high]
        return a if a == b else (high - spot) * a + (spot - low) * b

    return {n: [between(places[i][0], s) for s in places[i][1]] if i in places else None for i, n in enumerate(names)}

"""Mixing sources to target weights by capped water-filling.

Each source is clamped at a number of epochs, the excess weight goes to the
others in proportion until no target is above its cap, and documents are drawn
in a seeded order as whole repetitions plus one fractional repetition: of each
source the documents whose rank is below a cut are taken once more. The cut is
found from the sizes of 4096 ranges of ranks, and then inside one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import settle

#: Hexadecimal digits of a document's rank that name its bucket: 4096 a source.
_BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to ``source_key, weight, source_size``.

    The level is raised until no source is above ``max_epochs`` times its size:
    each round clamps those that are and shares what is left by weight among
    the others. Only two sums come to the driver. A budget above all caps
    together clamps every source.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    level: float | None = None
    clamped = -1
    while True:
        over = F.lit(False) if level is None else (cap < F.col("weight") * F.lit(level))
        held, weight, count = sources.agg(
            F.sum(F.when(over, cap)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count(F.when(over, 1)).alias("count")
        ).first()
        if count == clamped or weight is None:
            break
        clamped, level = count, (budget - (held or 0.0)) / float(weight)
    return sources.withColumn("target", F.when(over, cap).otherwise(F.col("weight") * F.lit(0.0 if level is None else level)).cast("double"))


def _sized(df: DataFrame, id: Column, text: Column, source: Column, seed: str) -> DataFrame:
    """``df`` with ``source_key``, ``size``, and the seeded ``rank`` of id and text."""
    rank = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return df.select("*", F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("source_key"), word_count(text).alias("size"), rank.alias("rank"))


def mixing_plan(rows: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """What each source's documents need to know, one row a source.

    ``rows`` has ``source_key, size, rank``. ``whole`` repetitions of every
    document; one more of those whose rank is below ``cut``; of the ``copies`` rows
    of rank ``cut``, all alike, ``rest`` words together.
    """
    bucket = F.substring("rank", 1, _BUCKET_DIGITS)
    buckets = settle(rows.groupBy("source_key", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "mix-buckets")
    # one row a source: its place gives the weight, null last
    order = Window.orderBy(F.col("source_key") == "n", "source_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    sources = settle(buckets.groupBy("source_key").agg(F.sum("words").alias("source_size")).withColumn("weight", weight), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    plan = water_fill(sources, share * total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("missing", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = settle(plan.drop("weight"), "mix-targets")

    def reached(groups: DataFrame, by: str) -> DataFrame:
        """The one group of each source in which its missing words end."""
        own = Window.partitionBy("source_key").orderBy(by)
        ahead = F.coalesce(F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = groups.join(plan.select("source_key", "missing"), "source_key").withColumn("ahead", ahead)
        return placed.where("ahead <= missing and missing < ahead + words").drop("words")

    ends = reached(buckets, "bucket").select("source_key", "bucket", F.col("ahead").alias("before"))
    inside = rows.withColumn("bucket", bucket).join(ends, ["source_key", "bucket"]).where("size > 0")
    alike = inside.groupBy("source_key", "rank").agg(F.first("before").alias("before"), F.count("*").alias("copies"), F.sum("size").alias("words"))
    first = Window.partitionBy("source_key").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.join(plan.select("source_key", "missing"), "source_key").withColumn("ahead", F.col("before") + F.coalesce(F.sum("words").over(first), F.lit(0)))
    cuts = alike.where("ahead <= missing and missing < ahead + words").select("source_key", F.col("rank").alias("cut"), "copies", (F.col("missing") - F.col("ahead")).alias("rest"))
    # without a cut the missing words are none or all
    none = F.when(F.col("missing") >= F.col("source_size"), F.lit("g")).otherwise(F.lit(""))
    out = plan.join(cuts, "source_key", "left").withColumn("cut", F.coalesce("cut", none))
    return settle(out.select("source_key", "source_size", "target", "whole", "cut", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("rest", F.lit(0)).alias("rest")), "mix-plan")


def mix(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row.

    Sources in code-point order, null last, take ``weights`` in turn. Every
    document is repeated as often as its whole source fits into the target; the
    words still missing come from the documents in seeded order, the last of
    them in part, so that each source meets its target to the word. Rows that
    repeat id and text are alike: where the missing words end among them, each
    gives the same part, rounded down. A null text has no words; a source
    without words has target 0; rows without an id are ordered by their text.
    Very long texts count whole. Other columns are not read. An empty table
    gives an empty result. Reruns agree: the order is a hash of seed, id and text.
    """
    rows = df.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = settle(_sized(rows, F.col("doc_id"), F.col("text"), F.col("source"), seed).drop("text"), "mix-rows")
    joined = rows.join(mixing_plan(rows, weights, share, max_epochs), "source_key")
    part = F.when(F.col("rank") < F.col("cut"), F.col("size")).when(F.col("rank") == F.col("cut"), F.floor(F.col("rest") / F.col("copies"))).otherwise(0)
    taken = (F.col("whole") * F.col("size") + part).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1",
) -> DataFrame:
    """The documents that ``mix`` takes, whole, once for each repetition; same columns.

    Columns may have any names. The document in which a source's missing words
    end is taken or left, whichever comes nearer to the target; of rows that
    repeat its id and text, as many as come near, chosen by where they lie. A
    text without words is in no repetition, so a null or empty text goes, as do
    documents that are not taken. An empty table gives an empty one. The plan, a
    row for each source, is joined to the texts, which are shuffled only where it
    is too large to broadcast.
    """
    columns = df.columns
    marked = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    at = [F.col(f"c{columns.index(c)}") for c in (id, text, source)]
    rows = _sized(marked, *at, seed)
    plan = mixing_plan(settle(rows.select("source_key", "size", "rank"), "mix-rows"), weights, share, max_epochs)
    rows = rows.withColumn("chance", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / (1 << 20)).join(plan, "source_key")
    shared = F.col("rest") / (F.col("size") * F.col("copies"))
    more = F.col("rank") < F.col("cut")
    more = more | ((F.col("rank") == F.col("cut")) & F.when(F.col("copies") == 1, shared >= 0.5).otherwise(F.col("chance") < shared))
    times = F.col("whole").cast("int") + more.cast("int")
    rows = rows.where("size > 0").withColumn("turn", F.explode(F.array_repeat(F.lit(1), times)))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])

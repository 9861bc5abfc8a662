"""Running confusion counts of a stream of labelled scores, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.evaluation import CELLS


def windowed_confusion(events: DataFrame, time: str, truth: str, score: str, threshold: float, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start`` and the four cells of each window; works on streams and tables alike."""
    predicted = (F.col(score) >= threshold).cast("int")
    cases = dict(zip(CELLS, ((1, 1), (0, 1), (0, 0), (1, 0))))
    counts = [F.count(F.when((F.col(truth) == t) & (predicted == p), 1)).alias(n) for n, (t, p) in cases.items()]
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w")).agg(*counts).select(F.col("w.start").alias("start"), *CELLS)

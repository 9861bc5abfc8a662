"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes, Spark's external sort
places equal texts side by side, and full comparisons of neighbours find the
groups. A splitter is the shortest prefix that tells it from the text before it
in the sample. Where the sample holds a text several times, splitters are that
text, an id and a number, so that a group with a large share of all rows is spread
over as many partitions as it needs; such groups are few, and are put together
by their text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import settle, shuffle_partitions, tidy

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
_LAST = float("inf")


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _bytes(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each text ends, and the bytes of all; null counts as empty."""
    held = pc.fill_null(column, "").cast(pa.large_string())
    if not len(held):
        return np.zeros(1, np.int64), memoryview(b"")
    _, offsets, body = held.buffers()
    return np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1], memoryview(body or b"")


class Splitters:
    """Splitters in order: (bytes, rank of an id, number of a row); rank and number null for a mere prefix."""

    def __init__(self, rows: list[tuple[bytes, float | None, int | None]]):
        self.order = sorted((body, -_LAST if rank is None else rank, tie or 0) for body, rank, tie in rows)
        hot = dict.fromkeys(body for body, rank, _ in self.order if rank > -_LAST)
        #: texts that splitters cut, by their number
        self.hot = {body: i for i, body in enumerate(hot)}
        # no more of a text is needed to place it
        self.reach = max((len(body) for body, *_ in self.order), default=0) + 1

    def place(self, body: bytes, rank: float, tie: int) -> int:
        return bisect_right(self.order, (body, rank, tie))


def _ranks(ids: pa.Array, keep: str) -> list[float]:
    """Ids as sort keys: the one that stays comes first, nulls last."""
    sign = -1 if keep == "largest" else 1
    return [_LAST if i is None else sign * i for i in ids.to_pylist()]


def sample_splitters(rows: DataFrame, keep: str, order: Column, parts: int, each: int = 20) -> Splitters:
    """About ``parts - 1`` splitters from ``each`` sampled rows a partition.

    The sample, ``each * parts`` rows of ``doc_id, text, tie``, is sorted by one task, with
    spilling; only splitters come to the driver.
    """
    fraction = min(1.0, each * parts / max(1, rows.count()))
    sample = rows.sample(fraction, 17).select("doc_id", "tie", normalised(F.col("text")).alias("body"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = b"", 0
        for batch in batches:
            ends, flat = _bytes(batch.column("body"))
            out: list[tuple[bytes, float | None, int | None]] = []
            for i, (rank, tie) in enumerate(zip(_ranks(batch.column("doc_id"), keep), batch.column("tie").to_pylist())):
                body = bytes(flat[ends[i] : ends[i + 1]])
                seen += 1
                if seen % each == 0:
                    if body == before:
                        out.append((body, rank, tie))
                    else:
                        short = min(len(body), len(before))
                        a, b = np.frombuffer(body, np.uint8, short), np.frombuffer(before, np.uint8, short)
                        differs = np.flatnonzero(a != b)
                        out.append((body[: (differs[0] if len(differs) else short) + 1], None, None))
                before = body
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["body", "rank", "tie"])

    found = sample.repartition(1).sortWithinPartitions("body", order, "tie").mapInArrow(pick, "body binary, rank double, tie long").collect()
    return Splitters([(bytes(r["body"]), r["rank"], r["tie"]) for r in found])


def _sorted_by_content(df: DataFrame, keep: str) -> tuple[DataFrame, Splitters]:
    """``df`` (``doc_id, text`` and others) range-partitioned and sorted by normalised text, then id.

    One shuffle; ``body`` is added behind it.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    # rows that repeat id and text are told apart by where they lie
    df = df.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    splitters = sample_splitters(df.select("doc_id", "text", "tie"), keep, order, shuffle_partitions(df.sparkSession))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = _bytes(batch.column("text"))
            heads = (bytes(flat[a : min(b, a + splitters.reach)]).translate(_FOLD) for a, b in zip(ends[:-1], ends[1:]))
            parts = list(map(splitters.place, heads, _ranks(batch.column("doc_id"), keep), batch.column("tie").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], [*batch.schema.names, "part"])

    dealt = df.mapInArrow(tidy(place), T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType())]))
    dealt = dealt.repartitionById(len(splitters.order) + 1, F.col("part")).drop("part", "tie")
    return dealt.withColumn("body", normalised(F.col("text"))).sortWithinPartitions("body", order), splitters


def _openings(body: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Whether each row's body differs from that of the row before it; compared in full."""
    fresh = np.ones(len(body), bool)
    if len(body):
        fresh[1:] = pc.not_equal(body[1:], body[:-1]).to_numpy(zero_copy_only=False)
        fresh[0] = last is None or body[0] != last
    return fresh


def exact_groups(df: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``df``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the
    row with the largest id stays (``keep="smallest"``: the smallest). A null
    text counts as empty. Rows without an id stay only if their whole group has
    none; of repeated rows one stays. Very long texts are compared in full.
    Other columns are not read. An empty table gives an empty result.
    """
    rows, splitters = _sorted_by_content(df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), keep)
    kinds = {"doc_id": pa.int64(), "text_sha256": pa.string(), "run_keep": pa.int64(), "run_rows": pa.int64(), "first": pa.bool_(), "hot": pa.int32(), "part": pa.int32()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the current run only ids are held, never texts
        ids: list[int | None] = []
        digest, hot, last = "", None, None
        pending: list[tuple] = []
        part = TaskContext.get().partitionId()

        def close() -> None:
            # the first row of a run has the id that stays
            pending.extend((i, digest, ids[0], len(ids), k == 0, hot, part) for k, i in enumerate(ids))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pending), kinds.values())], list(kinds))
            pending.clear()
            return out

        for batch in batches:
            fresh, names = _openings(batch.column("body"), last), batch.column("doc_id").to_pylist()
            ends, flat = _bytes(batch.column("body"))
            for i, opens in enumerate(fresh):
                if opens:
                    close()
                    ids, body = [], flat[ends[i] : ends[i + 1]]
                    digest = hashlib.sha256(body).hexdigest()
                    hot = splitters.hot.get(bytes(body)) if len(body) < splitters.reach else None
                ids.append(names[i])
            last = batch.column("body")[-1] if batch.num_rows else last
            if len(pending) > 50_000:
                yield flush()
        close()
        if pending:
            yield flush()

    found = rows.select("doc_id", "body").mapInArrow(tidy(find), "doc_id long, text_sha256 string, run_keep long, run_rows long, first boolean, hot int, part int")
    found = settle(found, "exact-dedup")
    # texts that splitters cut, no more than there are splitters: the first partition has the row that stays
    cut = found.where("first and hot is not null").groupBy("hot").agg(F.min("part").alias("front"), F.min_by("run_keep", "part").alias("all_keep"), F.sum("run_rows").alias("all_rows"))
    joined = found.join(F.broadcast(cut), "hot", "left")
    whole = F.col("all_rows").isNotNull()
    return joined.select(
        "doc_id",
        F.when(whole, F.col("all_keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.coalesce("all_rows", "run_rows").alias("group_size"),
        (F.col("first") & F.coalesce(F.col("part") == F.col("front"), F.lit(True))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(df: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """``df`` without the rows whose text another row's equals; same columns.

    Columns may have any names. Null counts as empty. Repeated rows with one id
    and text leave one row. Rows without an id are compared like the others and
    stay where their group has no other. An empty table gives an empty one.
    Texts are shuffled once.
    """
    columns = df.columns
    marked = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns) if c != text])
    rows, splitters = _sorted_by_content(marked, keep)
    kinds = [f for f in marked.schema.fields if f.name != "body"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            # folded again here, so that texts come to the worker once
            body = pc.ascii_lower(pc.fill_null(batch.column("text"), ""))
            fresh = _openings(body, last)
            last = body[-1] if batch.num_rows else last
            ends, flat = _bytes(body)
            hot = [splitters.hot.get(bytes(flat[a:b])) if b - a < splitters.reach and o else None for a, b, o in zip(ends[:-1], ends[1:], fresh)]
            own = [batch.column(f.name) for f in kinds]
            yield pa.RecordBatch.from_arrays([*own, pa.array(hot, pa.int32())], [*[f.name for f in kinds], "hot"]).filter(pa.array(fresh))

    kept = settle(rows.drop("body").mapInArrow(tidy(first), T.StructType([*kinds, T.StructField("hot", T.IntegerType())])), "exact-kept")
    # of a text that splitters cut, each partition has one row: no more than there are splitters
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    one = kept.where("hot is not null").withColumn("place", F.row_number().over(Window.partitionBy("hot").orderBy(order))).where("place = 1")
    names = [F.col("text" if c == text else f"c{i}").alias(c) for i, c in enumerate(columns)]
    return kept.where("hot is null").select(*names).unionByName(one.select(*names))

"""Token ids in binary shards with Elias-Fano document boundaries.

A shard holds the concatenated ids of its documents and, behind them, where
each document ends as an Elias-Fano sequence: the low bits of every end packed
side by side, the high bits in unary, and the place of every 256th unary one so
that ``select`` reads a few words instead of a table of 64-bit offsets.

Layout, little-endian: ids | doc_ids int64 | low bits | high words | samples
uint32 | footer. The footer has the counts and a mark, so ids are written as
they come and only lengths stay in memory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, shared_folder, shuffle_partitions

_MARK = b"MRTOKEF1"
#: documents, ids, documents without id, bytes an id, low bits, high words, samples, mark
_FOOTER = struct.Struct("<QQQIIQQ8s")
_SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of ``n`` numbers up to ``total``."""

    def __init__(self, n: int, total: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.total, self.low_bits = n, total, low_bits
        self.low, self.high, self.samples = low, high, samples

    @staticmethod
    def widths(n: int, total: int) -> tuple[int, int, int]:
        """Low bits a number, words of the unary part, samples."""
        low_bits = max(0, (max(1, total) // max(1, n)).bit_length() - 1)
        ones_and_zeros = n + (total >> low_bits) + 1
        return low_bits, -(-ones_and_zeros // 64), -(-n // _SAMPLE)

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n, total = len(values), int(values[-1]) if len(values) else 0
        low_bits, words, _ = cls.widths(n, total)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(64 * words, dtype=np.uint8)
        bits[places.astype(np.int64)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        return cls(n, total, low_bits, low, high, places[::_SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The ``i``-th number."""
        at = int(self.samples[i // _SAMPLE])
        left, word = i % _SAMPLE, at >> 6
        bits = int(self.high[word]) >> (at & 63) << (at & 63)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = 64 * word + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        start, size = i * self.low_bits, self.low_bits
        first, last = start >> 3, (start + size + 7) >> 3
        return int.from_bytes(self.low[first:last].tobytes(), "little") >> (start & 7) & ((1 << size) - 1)

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document ``i`` starts and ends."""
        return (self.select(i - 1) if i else 0), self.select(i)


class ShardWriter:
    """Writes one shard to an open binary stream."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes = out, id_bytes
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.id_bytes}").tobytes())
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))

    def close(self) -> int:
        """Writes what follows the ids; gives their number."""
        ends = EliasFano.build(np.cumsum(np.array(self.lengths, dtype=np.uint64)))
        nulls = sum(i is None for i in self.doc_ids)
        # rows without id come first, so their number tells which they are
        self.out.write(np.array([i or 0 for i in self.doc_ids], dtype="<i8").tobytes())
        for part in (ends.low, ends.high, ends.samples):
            self.out.write(part.tobytes())
        self.out.write(_FOOTER.pack(ends.n, ends.total, nulls, self.id_bytes, ends.low_bits, len(ends.high), len(ends.samples), _MARK))
        return ends.total


class ShardReader:
    """Reads documents of one shard by position."""

    def __init__(self, file):
        size = file.size()
        file.seek(size - _FOOTER.size)
        n, total, self.nulls, self.id_bytes, low_bits, words, samples, mark = _FOOTER.unpack(file.read(_FOOTER.size))
        if mark != _MARK:
            raise ValueError("not a token shard")
        self.file, self.n, self.total = file, n, total
        file.seek(total * self.id_bytes)
        self.doc_ids = np.frombuffer(file.read(8 * n), dtype="<i8")
        low = np.frombuffer(file.read(-(-n * low_bits // 8)), dtype=np.uint8)
        high = np.frombuffer(file.read(8 * words), dtype="<u8")
        self.ends = EliasFano(n, total, low_bits, low, high, np.frombuffer(file.read(4 * samples), dtype="<u4"))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else int(self.doc_ids[i])

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(start * self.id_bytes)
        return np.frombuffer(self.file.read((end - start) * self.id_bytes), dtype=f"<u{self.id_bytes}")


def write_shards(
    df: DataFrame,
    model_path: str,
    folder: str,
    id: str = "doc_id",
    text: str | Column = "text",
    end_id: int | None = 0,
    batch_bytes: int = 512 << 10,
    memo_entries: int = 500_000,
) -> list[tuple[str, int, int]]:
    """Encode ``df`` into shards below ``folder``; (path, documents, ids) of each, in order.

    Shards follow one another in ascending id, rows without id first, ties by
    the text's hash. ``end_id`` is appended to each document. A null text
    counts as empty. Ids take two bytes where the vocabulary allows. The
    number of shards is the session's number of shuffle partitions. A shard
    gets its name once it is whole, so that a task that runs again replaces it.
    """
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    rows = df.select(F.col(id).cast("long").alias("doc_id"), body.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from millrace.llm.bpe import encoder

        coder = encoder(model_path, memo_entries)
        id_bytes = 2 if max(coder.tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
        context = TaskContext.get()
        name = f"{folder}/shard-{context.partitionId():06d}.tok"
        store, path = pafs.FileSystem.from_uri(name)
        draft = f"{path}.{context.taskAttemptId()}.part"
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        tail = [] if end_id is None else [end_id]
        with store.open_output_stream(draft) as out:
            shard = ShardWriter(out, id_bytes)
            for batch in batches:
                for part in byte_slices(batch, "text", batch_bytes):
                    for i, ids in zip(part.column("doc_id").to_pylist(), coder.encode_many(part.column("text").to_pylist())):
                        shard.add(i, np.append(ids, tail))
            total = shard.close()
        store.move(draft, path)
        yield pa.RecordBatch.from_pydict(
            {"shard": [context.partitionId()], "path": [name], "documents": [len(shard.lengths)], "ids": [total]},
            pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]),
        )

    # a row for each shard
    done = placed.mapInArrow(write, "shard int, path string, documents long, ids long").collect()
    # drafts of attempts that were lost
    store, root = pafs.FileSystem.from_uri(folder)
    for file in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if file.path.endswith(".part"):
            store.delete_file(file.path)
    return [(r.path, r.documents, r.ids) for r in sorted(done) if r.documents]


def read_shards(spark, shards: list[tuple[str, int, int]], group_ids: int = 1 << 20) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the shards.

    ``start`` counts the ids of all documents before it, over all shards. Ids
    are read in groups of about ``group_ids``.
    """
    places, first = [], 0
    for path, _, total in shards:
        places.append((path, first))
        first += total
    table = spark.createDataFrame(places, "path string, first long").repartition(max(1, len(places)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                store, path = pafs.FileSystem.from_uri(name)
                with store.open_input_file(path) as file:
                    yield from _digests(ShardReader(file), start, group_ids)

    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digests(shard: ShardReader, first: int, group_ids: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held, begin, b = np.empty(0, "<u4"), 0, 0
    for i in range(shard.n):
        a, b = b, shard.ends.select(i)
        if b > begin + len(held):
            # read on from this document, as far as the last that still fits
            held, begin = shard.ids(a, min(shard.total, max(b, a + group_ids))).astype("<u4"), a
        rows.append((shard.doc_id(i), first + a, b - a, zlib.crc32(held[a - begin : b - begin].tobytes())))
        if len(rows) == 10_000 or i == shard.n - 1:
            kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))
            rows = []


def token_table(df: DataFrame, model_path: str, id: str = "doc_id", text: str = "text", end_id: int | None = 0) -> DataFrame:
    """Write ``df`` as shards in the shared folder and read them back.

    ``doc_id, start, n_tokens, ids_crc32`` for every row; see ``write_shards``
    for nulls and ties. Repeated rows are documents of their own. Other columns
    are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    return read_shards(spark, write_shards(df, model_path, shared_folder(spark, "tokens"), id, text, end_id))

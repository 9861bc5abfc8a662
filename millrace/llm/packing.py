"""Packing of documents into windows by best-fit decreasing.

Overlong documents are first cut into full windows. What is left of each
document goes, longest first, to the open window with the tightest room, found
in a segment tree that is indexed by remaining capacity. Documents are packed
in pools of a bounded number of ids, so tasks stream their input and no shuffle
is needed; the few windows that a pool leaves with room are cut anew, and their
last ids go to windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, tidy


class RoomTree:
    """Open windows by remaining capacity, with the tightest fit in O(log size)."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, and its room."""
        node = self.leaves + need
        if not self.count[node]:
            # climb to the nearest right sibling that holds a window, then go down
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.windows[room].pop(), room


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """The window of each length, and how full each window is."""
    tree, used = RoomTree(size), []
    place = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[i])
        window, room = found if found else (len(used), size)
        if not found:
            used.append(0)
        place[i] = window
        used[window] += lengths[i]
        if room > lengths[i]:
            tree.put(window, room - lengths[i])
    return place, used


def pack_pool(lengths: list[int], size: int, slack: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of every piece of a pool.

    Windows with more than ``slack`` ids of room are cut anew, end to end.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    window = 0
    rests: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - size + 1, size):
            pieces.append((doc, start, size, window, 0))
            window += 1
        if n % size:
            rests.append((doc, n - n % size, n % size))
    place, used = best_fit_decreasing([n for *_, n in rests], size)
    members: list[list[int]] = [[] for _ in used]
    for i, w in enumerate(place):
        members[w].append(i)
    loose: list[tuple[int, int, int]] = []
    for w, own in enumerate(members):
        if size - used[w] > slack and used[w] & (used[w] - 1):
            loose.extend(rests[i] for i in own)
            continue
        offset = 0
        for i in own:
            doc, start, n = rests[i]
            pieces.append((doc, start, n, window, offset))
            offset += n
        window += 1
    left, room, offset = sum(n for *_, n in loose), 0, 0
    for doc, start, n in loose:
        while n:
            if not room:
                # a full window, or the largest power of two that the rest fills
                room, offset = min(size, 1 << (left.bit_length() - 1)) if left < size else size, 0
                left -= room
                window += 1
            part = min(n, room)
            pieces.append((doc, start, part, window - 1, offset))
            start, n, room, offset = start + part, n - part, room - part, offset + part
    return pieces


def pack(
    df: DataFrame,
    model_path: str,
    id: str = "doc_id",
    text: str | Column = "text",
    size: int = 2048,
    end_id: int | None = 1,
    slack: int = 16,
    pool_ids: int = 1 << 21,
    batch_bytes: int = 512 << 10,
    memo_entries: int = 200_000,
) -> DataFrame:
    """Pieces of every row's ids in sequences of at most ``size``.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``; each
    id of each row lies in exactly one piece. ``end_id`` is appended to each
    document, so that a null or empty text is one id; without it such a row has
    no piece. Rows without an id and repeated rows are documents of their own.
    Other columns are not read. An empty table gives an empty result.

    A task packs pools of about ``pool_ids`` ids. ``sequence_id`` has the task's
    partition above bit 32 and counts from there.
    """
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    rows = df.select(F.col(id).cast("long").alias("doc_id"), body.alias("text"))
    kinds = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from millrace.llm.bpe import encoder

        coder = encoder(model_path, memo_entries)
        tail = [] if end_id is None else [end_id]
        names: list[int | None] = []
        pool: list[np.ndarray] = []
        held, first = 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, first
            pieces = pack_pool([len(x) for x in pool], size, slack)
            out = [
                (names[d], start, n, zlib.crc32(pool[d][start : start + n].tobytes()), len(pool[d]), first + w, offset)
                for d, start, n, w, offset in pieces
            ]
            first += 1 + max((p[3] for p in pieces), default=-1)
            names.clear(), pool.clear()
            held = 0
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[i : i + 20_000])], kinds)

        for batch in batches:
            for part in byte_slices(batch, "text", batch_bytes):
                for i, ids in zip(part.column("doc_id").to_pylist(), coder.encode_many(part.column("text").to_pylist())):
                    names.append(i)
                    pool.append(np.append(ids, tail).astype("<u4"))
                    held += len(pool[-1])
                if held >= pool_ids:
                    yield from flush()
        if pool:
            yield from flush()

    return rows.mapInArrow(tidy(run), ", ".join(f"{k} long" for k in kinds))

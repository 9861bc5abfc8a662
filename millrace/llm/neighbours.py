"""Approximate nearest neighbours: a hierarchical small-world graph per shard.

Distinct rows are dealt to shards of bounded size by a hash. Each shard has
nested levels, each with one point in ``thin`` of the level below. Points are
inserted in batches: a batch is searched for in the graph of the points before
it, descending from the top level, links to diverse ones of what it found, and
is linked back. A point that no link leads to from the level above is inserted
there as well. Levels are flat arrays of neighbours. Queries go to the shards,
descend with a beam, and the shards' results are merged. Inner product is turned
into a distance by one more coordinate that gives all vectors the same length.
Equal vectors of a shard are one node with a list of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import settle


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


# -- the graph of one shard --


def _diverse(points: np.ndarray, own: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to it than to any chosen one.

    ``own`` are the rows' places; free places go to the nearest that were left out.
    """
    rows, width = near.shape
    chosen = np.zeros((rows, width), bool)
    vectors = points[np.maximum(near, 0)]
    between = np.einsum("nid,njd->nij", vectors, vectors)
    count = np.zeros(rows, int)
    for i in range(width):
        closer = (between[:, i] > sims[:, i, None]) & chosen
        good = (near[:, i] >= 0) & (near[:, i] != own) & ~closer.any(axis=1) & (count < most)
        chosen[:, i] = good
        count += good
    rank = np.where(chosen, 0, 1) + np.where((near < 0) | (near == own[:, None]), 2, 0)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    picked = np.take_along_axis(near, order, axis=1)
    return np.where(np.take_along_axis(rank, order, axis=1) < 2, picked, -1)


def _sorted(near: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` best candidates of each row, best first; -1 is none, twice counts once."""
    order = np.argsort(near, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
    twice = np.zeros_like(near, bool)
    twice[:, 1:] = near[:, 1:] == near[:, :-1]
    sims = np.where(twice | (near < 0), -np.inf, sims)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
    return np.where(sims > -np.inf, near, -1), sims


class Graph:
    """Levels from the bottom. ``members[l]`` are a level's points in the order in
    which they were inserted, ``links[l]`` their neighbours' places in that order,
    -1 where free. The top level has no links and is searched exactly.
    """

    def __init__(self, points: np.ndarray, members: list[np.ndarray], links: list[np.ndarray]):
        self.points, self.members, self.links = points, members, links
        self.vectors = [points[m] for m in members]
        self.place = []
        for m in members:
            place = np.full(len(points), -1, np.int32)
            place[m] = np.arange(len(m))
            self.place.append(place)

    @classmethod
    def build(cls, points: np.ndarray, most: int = 48, ef: int = 64, thin: int = 16, top: int = 64, seed: int = 3) -> "Graph":
        """``most`` places a point on the bottom, half of them above it; ``ef`` candidates an insertion."""
        order = np.random.default_rng(seed).permutation(len(points)).astype(np.int32)
        sizes = [len(points)]
        while sizes[-1] > top:
            sizes.append(-(-sizes[-1] // thin))
        none = [np.empty(0, np.int32) for _ in sizes]
        links = [np.empty((0, most if level == 0 else most // 2), np.int32) for level in range(len(sizes))]
        graph = cls(points, none, links)
        for level in reversed(range(len(sizes))):
            graph._insert(level, order[: sizes[level]], ef)
            graph._lift(level, ef)
        return graph

    def _insert(self, level: int, ids: np.ndarray, ef: int) -> None:
        """Insert points into a level whose upper levels are whole, in growing batches."""
        if level == len(self.members) - 1:
            ids, begin = ids[self.place[level][ids] < 0], len(self.members[level])
            self._append(level, ids, np.full((len(ids), self.links[level].shape[1]), -1, np.int32))
            self.place[level][ids] = begin + np.arange(len(ids))
            return
        done = 0
        while done < len(ids):
            size = min(max(len(self.members[level]) // 2, 1), 512)
            self._insert_batch(level, ids[done : done + size], ef)
            done += size

    def _append(self, level: int, ids: np.ndarray, links: np.ndarray) -> None:
        self.members[level] = np.concatenate([self.members[level], ids])
        self.links[level] = np.concatenate([self.links[level], links])
        self.vectors[level] = np.concatenate([self.vectors[level], self.points[ids]])

    def _insert_batch(self, level: int, ids: np.ndarray, ef: int) -> None:
        queries, begin, cap = self.points[ids], len(self.members[level]), self.links[level].shape[1]
        places = np.arange(begin, begin + len(ids))
        near, sims = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0), np.float32)
        if begin:
            found, sims = self._beam(level, queries, self._entries(queries, level, 16), ef, ef, 4)
            near = np.where(found >= 0, self.place[level][found], -1)
        # those of one batch see each other without a search
        mates = queries @ queries.T
        np.fill_diagonal(mates, -np.inf)
        wide = min(len(ids), ef // 2)
        best = np.argpartition(-mates, wide - 1, axis=1)[:, :wide]
        mates = np.take_along_axis(mates, best, axis=1)
        near = np.concatenate([near, np.where(mates > -np.inf, begin + best, -1)], axis=1)
        near, sims = _sorted(near, np.concatenate([sims, mates], axis=1), ef)
        self._append(level, ids, np.full((len(ids), cap), -1, np.int32))
        self.place[level][ids] = places
        picked = _diverse(self.vectors[level], places, near, sims, cap // 2)
        self.links[level][begin:, : picked.shape[1]] = picked
        self._link_back(level, np.repeat(places, picked.shape[1])[picked.ravel() >= 0], picked.ravel()[picked.ravel() >= 0])

    def _link_back(self, level: int, source: np.ndarray, target: np.ndarray, block: int = 1024) -> None:
        """Add ``source`` to the neighbours of ``target``; a full list is chosen anew from old and new."""
        links, vectors = self.links[level], self.vectors[level]
        order = np.lexsort((source, -np.einsum("nd,nd->n", vectors[source], vectors[target]), target))
        source, target = source[order], target[order]
        names, first, count = np.unique(target, return_index=True, return_counts=True)
        for i in range(0, len(names), block):
            some, begin, n = names[i : i + block], first[i : i + block], np.minimum(count[i : i + block], links.shape[1])
            at = np.arange(n.max())
            fresh = np.where(at < n[:, None], source[np.minimum(begin[:, None] + at, len(source) - 1)], -1)
            near = np.concatenate([links[some], fresh], axis=1)
            full = (near >= 0).sum(axis=1) > links.shape[1]
            free = np.take_along_axis(near, np.argsort(near < 0, axis=1, kind="stable"), axis=1)[:, : links.shape[1]]
            links[some[~full]] = free[~full]
            if full.any():
                own, near = some[full], near[full]
                sims = np.where(near >= 0, np.einsum("nd,nid->ni", vectors[own], vectors[np.maximum(near, 0)]), -np.inf)
                near, sims = _sorted(near, sims, near.shape[1])
                links[own] = _diverse(vectors, own, near, sims, links.shape[1])

    def _lift(self, level: int, ef: int) -> None:
        """Insert into the levels above what no link leads to from there."""
        if level == len(self.members) - 1:
            return
        links = self.links[level]
        seen = np.zeros(len(links) + 1, bool)
        seen[-1] = True  # free places

        def spread(fresh: np.ndarray) -> None:
            seen[fresh] = True
            while len(fresh):
                near = np.unique(links[fresh])
                fresh = near[~seen[near]]
                seen[fresh] = True

        spread(self.place[level][self.members[level + 1]])
        lifted = []
        for i in np.flatnonzero(~seen):
            if not seen[i]:
                lifted.append(self.members[level][i])
                spread(np.array([i]))
        if lifted:
            self._insert(level + 1, np.array(lifted, np.int32), ef)
            self._lift(level + 1, ef)

    def _entries(self, queries: np.ndarray, level: int, count: int, width: int = 4) -> np.ndarray:
        """Where to enter ``level``: the best points found on the level above, -1 where free."""
        top = self.members[-1]
        found = top[np.argsort(-(queries @ self.vectors[-1].T), axis=1, kind="stable")[:, :count]].astype(np.int64)
        for above in range(len(self.members) - 2, level, -1):
            found, _ = self._beam(above, queries, found, count, count, width)
        # not all of them need to be inserted yet; the first point always is
        found = np.where((found >= 0) & (self.place[level][found] >= 0), found, -1)
        found[(found < 0).all(axis=1), 0] = self.members[level][0]
        return found

    def search(self, queries: np.ndarray, k: int, beam: int, width: int = 4, entries: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Places and products of the ``k`` best points found, -1 where there are fewer."""
        beam = max(beam, k)
        if len(self.members) == 1:
            sims = queries @ self.vectors[0].T
            order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            return self.members[0][order], np.take_along_axis(sims, order, axis=1)
        return self._beam(0, queries, self._entries(queries, 0, min(max(entries, k), beam)), k, beam, width)

    def _beam(self, level: int, queries: np.ndarray, at: np.ndarray, k: int, beam: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best points of a level, searched from the points ``at`` of each query, -1 where free."""
        q, members, links, points = len(queries), self.members[level], self.links[level], self.vectors[level]
        rows = np.arange(q)[:, None]
        start = np.where(at >= 0, self.place[level][at], -1)
        seen = np.zeros((q, len(points) + 1), bool)
        seen[rows, start] = True
        seen[:, -1] = True
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -np.inf, np.float32)
        done = np.ones((q, beam), bool)
        first = slice(0, start.shape[1])
        ids[:, first], done[:, first] = start, start < 0
        sims[:, first] = np.where(start >= 0, np.einsum("qd,qnd->qn", queries, points[np.maximum(start, 0)]), -np.inf)
        live = np.arange(q)
        while len(live):
            # the best entries not yet expanded
            open_ = np.where(done[live], -np.inf, sims[live])
            pick = np.argpartition(-open_, min(width, beam) - 1, axis=1)[:, :width]
            fine = np.take_along_axis(open_, pick, axis=1) > -np.inf
            some = fine.any(axis=1)
            live, pick, fine = live[some], pick[some], fine[some]
            if not len(live):
                break
            done[live[:, None], pick] = True
            near = np.where(fine[:, :, None], links[np.maximum(ids[live[:, None], pick], 0)], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            twice = np.zeros_like(near, bool)
            twice[:, 1:] = near[:, 1:] == near[:, :-1]
            near = np.where(twice | seen[live[:, None], near], -1, near)
            seen[live[:, None], near] = True
            fresh = np.einsum("qd,qnd->qn", queries[live], points[np.maximum(near, 0)])
            fresh[near < 0] = -np.inf
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sims = np.concatenate([sims[live], fresh], axis=1)
            all_done = np.concatenate([done[live], near < 0], axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, keep, axis=1), np.take_along_axis(all_sims, keep, axis=1)
            done[live] = np.take_along_axis(all_done, keep, axis=1) | (sims[live] == -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        sims = np.take_along_axis(sims, order, axis=1)
        return np.where(sims > -np.inf, members[np.take_along_axis(ids, order, axis=1)], -1), sims


# -- shards in Spark --

_GRAPH = "shard int, names binary, copies binary, starts binary, vectors binary, levels array<binary>, links array<binary>"


def _matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Rows of ``dimension`` components; shorter vectors end in zeros."""
    lists = column.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy()
    out = np.zeros((len(lengths), dimension))
    out[np.arange(dimension) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors whose nearness goes with the inner product."""
    short = vectors / longest
    rest = np.sqrt(np.maximum(1 - (short**2).sum(axis=1), 0))
    return np.concatenate([short, rest[:, None]], axis=1).astype(np.float32)


def build_shards(rows: DataFrame, dimension: int, longest: float, shards: int, most: int) -> DataFrame:
    """A row for each shard: its vectors, ids and graph as flat arrays.

    ``rows`` has ``vec_id, vector, copies``. The ids of a node ascend; only
    those of its first ``most`` rows are kept, which no query needs to exceed.
    """
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        points, inverse = np.unique(_matrix(table.column("vector"), dimension), axis=0, return_inverse=True)
        names, copies = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
        order = np.lexsort((names, inverse.ravel()))
        names, copies, node = names[order], copies[order], inverse.ravel()[order]
        before = np.cumsum(copies) - copies
        kept = before - before[np.searchsorted(node, node)] < most
        names, copies, node = names[kept], copies[kept], node[kept]
        graph = Graph.build(_lifted(points, longest))
        row = {
            "shard": [key[0].as_py()],
            "names": [names.astype("<i8").tobytes()],
            "copies": [copies.astype("<i8").tobytes()],
            "starts": [np.searchsorted(node, np.arange(len(points) + 1)).astype("<i8").tobytes()],
            "vectors": [points.astype("<f8").tobytes()],
            "levels": [[m.astype("<i4").tobytes() for m in graph.members]],
            "links": [[x.astype("<i4").tobytes() for x in graph.links]],
        }
        kinds = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.table(row, schema=pa.schema(list(zip(row, kinds))))

    return settle(placed.groupBy("shard").applyInArrow(build, _GRAPH), "graphs")


class _Shard:
    """A shard read back, and its answers to blocks of queries."""

    def __init__(self, row: dict, dimension: int, longest: float):
        self.longest = longest
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, dimension)
        self.names, self.copies, self.starts = (np.frombuffer(row[c], "<i8") for c in ("names", "copies", "starts"))
        levels = [np.frombuffer(x, "<i4") for x in row["levels"]]
        links = [np.frombuffer(x, "<i4").reshape(len(m), -1) for x, m in zip(row["links"], levels)]
        self.graph = Graph(_lifted(self.vectors, longest), levels, links)

    def answer(self, query_names: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[list, list, list]:
        """Place of the query, id and exact product of what was found, best first."""
        flat = np.concatenate([queries / self.longest, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        found, _ = self.graph.search(flat, k + 1, beam)
        out: tuple[list, list, list] = ([], [], [])
        for i, (name, vector, places) in enumerate(zip(query_names, queries, found)):
            places = places[places >= 0]
            scores = (self.vectors[places] * vector).sum(axis=1)
            own = [np.arange(self.starts[p], self.starts[p + 1]) for p in places]
            at, each = np.concatenate(own), np.repeat(scores, [len(x) for x in own])
            same = np.repeat((self.vectors[places] == vector).all(axis=1), [len(x) for x in own])
            times = np.minimum(self.copies[at] - (same & (self.names[at] == name)), k)
            names, each = np.repeat(self.names[at], times), np.repeat(each, times)
            best = np.lexsort((names, -each))[:k]
            for column, values in zip(out, (np.full(len(best), i), names[best], each[best])):
                column.append(values)
        return out


def nearest(
    df: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    every: int = 20,
    k: int = 20,
    beam: int = 128,
    shard_rows: int = 16_384,
    block_rows: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score, query_copy``: the ``k`` nearest found of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own. Nearness is the inner product in double
    precision, ties go to the smaller id. Null and zero vectors, those with null or
    non-finite components, and rows without an id take no part. A shorter vector
    counts as ending in zeros.

    Rows that repeat an id are all candidates. Those of one id whose vectors
    differ are queries of their own, told apart by ``query_copy``, a hash of the
    vector; rows that repeat id and vector ask once, and find each other. Other
    columns are not read. Without usable rows the result is empty.

    All rows are indexed. A shard has about ``shard_rows`` rows, whatever the
    size of the table, and each query meets each shard once: queries travel in
    blocks of ``block_rows``, graphs stay where they are.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    facts = rows.agg(
        F.count("*").alias("n"),
        F.max(F.size("vector")).alias("size"),
        F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).alias("longest"),
        F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries"),
    ).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_copy long")
    dimension, longest = facts["size"], facts["longest"] * (1 + 1e-9)
    distinct = settle(rows.groupBy("vec_id", "vector").agg(F.count("*").alias("copies")), "vectors")
    shards = max(1, -(-facts["n"] // shard_rows))
    graphs = build_shards(distinct, dimension, longest, shards, k + 1)

    blocks = max(1, -(-facts["queries"] // block_rows))
    asked = distinct.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", "vector", F.lit(7)), F.lit(blocks)).cast("int"))
    asked = asked.select("block", "vec_id", "vector", F.xxhash64("vector").alias("tag"))

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        own = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "tag")]
        flat = _matrix(table.column("vector"), dimension).astype("<f8").tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "names": pa.array([own[0]], pa.binary()), "copies": pa.array([own[1]], pa.binary()), "vectors": pa.array([flat], pa.binary())})

    packed = asked.groupBy("block").applyInArrow(gather, "block int, names binary, copies binary, vectors binary")
    packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # each shard's graph goes ahead of the blocks that it answers
    both = graphs.withColumn("block", F.lit(-1)).unionByName(packed, allowMissingColumns=True)
    parts = min(shards, 20_000)
    placed = both.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["block"] < 0:
                    shard = _Shard(row, dimension, longest)
                    continue
                names, tags = (np.frombuffer(row[c], "<i8") for c in ("names", "copies"))
                at, ids, scores = map(np.concatenate, shard.answer(names, np.frombuffer(row["vectors"], "<f8").reshape(-1, dimension), k, beam))
                yield pa.RecordBatch.from_pydict({"query_id": names[at], "query_copy": tags[at], "vec_id": ids, "score": scores})

    found = placed.mapInArrow(search, "query_id long, query_copy long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "query_copy")

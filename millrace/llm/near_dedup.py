"""MinHash near-dedup with DartMinHash signatures.

1. Documents become weighted sets of word shingles; equal ones have one
   representative.
2. Signatures are cut into bands, and representatives that agree on a band
   share a bucket.
3. Representatives whose signatures are alike form families: first through the
   hubs of their buckets, then, in buckets that still hold several families,
   through every pair that touches a family other than the bucket's largest.
4. Within a family, similarities are counted exactly, in blocks: each block
   with itself and with the family's first block, then whatever is still apart
   with every block. Links join classes; no list of all pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, settle, shuffle_partitions, tidy
from millrace.llm.components import components
from millrace.llm.darts import mix, signatures

#: Documents whose darts are thrown at once.
_TOGETHER = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_sets(texts: list[str], words: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text: hashes, counts and owners, in owner order.

    Words are runs of characters without white space, lower-cased. A text with
    fewer words than a shingle has is one shingle; one without words has none.
    """
    known = _WordHashes() if known is None else known
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    flat = np.fromiter((known[w] for s in split for w in s), np.uint64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    count = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    owners = np.repeat(np.arange(len(texts)), count)
    at = starts[owners] + np.arange(len(owners)) - np.repeat(np.cumsum(count) - count, count)
    ends = (starts + sizes)[owners]
    hashes = np.zeros(len(owners), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):
            inside = at + i < ends
            term = flat[np.minimum(at + i, max(len(flat) - 1, 0))] if len(flat) else hashes
            hashes = np.where(inside, (hashes + term) * _BASE, hashes)
        hashes = mix(hashes)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    place = np.flatnonzero(first)
    return hashes[place], np.diff(np.append(place, len(hashes))), owners[place]


def repeated(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """An element for each time that a shingle occurs, told apart by their number.

    The similarity of such sets is that of the weighted ones.
    """
    nth = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    every = np.repeat(hashes, counts)
    with np.errstate(over="ignore"):
        return np.where(nth == 0, every, mix(every + nth * _BASE))


def sketch(rows: DataFrame, words: int, bands: int, band_rows: int, weighted: bool, batch_bytes: int = 1 << 20) -> DataFrame:
    """``row, doc_id, set_hash, shingles, signature, buckets`` of ``doc_id, text``.

    ``row`` numbers the rows. ``set_hash`` names the shingle set, null if it is
    empty; ``weighted`` sets hold a shingle as often as it occurs. ``shingles`` has
    its hashes in four bytes each, ``signature`` two bytes a coordinate.
    """
    import xxhash

    k = bands * band_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = _WordHashes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in byte_slices(batch, "text", batch_bytes):
                if len(known) > 250_000:
                    known.clear()
                hashes, counts, owners = shingle_sets(part.column("text").to_pylist(), words, known)
                n = part.num_rows
                weights = counts.astype(float) if weighted else np.ones(len(hashes))
                cuts = np.searchsorted(owners, np.arange(n + 1))
                names = np.empty((n, k), np.uint64)
                for i in range(0, n, _TOGETHER):
                    # short texts need as many darts as long ones
                    j = min(n, i + _TOGETHER)
                    own = slice(cuts[i], cuts[j])
                    names[i:j] = signatures(hashes[own], weights[own], owners[own] - i, j - i, k)
                with np.errstate(over="ignore"):
                    keys = np.zeros((n, bands), np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64) * _BASE)
                    for i in range(band_rows):
                        keys = mix(keys * _BASE + names.reshape(n, bands, band_rows)[:, :, i])
                short = (mix(names) >> np.uint64(48)).astype("<u2")
                if weighted:
                    cuts = np.concatenate([[0], np.cumsum(counts)])[cuts]
                    hashes = repeated(hashes, counts)
                sets = [hashes[a:b] for a, b in zip(cuts, cuts[1:])]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        part.column("doc_id"),
                        pa.array(digests, pa.binary()),
                        pa.array([(s >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary()),
                        pa.array([short[i].tobytes() for i in range(n)], pa.binary()),
                        pa.array([keys[i].view(np.int64) if len(s) else None for i, s in enumerate(sets)], pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "set_hash", "shingles", "signature", "buckets"],
                )
                row += n

    return rows.mapInArrow(tidy(run), "row long, doc_id long, set_hash binary, shingles binary, signature binary, buckets array<long>")


# -- links inside groups of bounded size --


class _Forest:
    """Union-find over the members of one group; remembers the joining edges."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int, real: tuple[int, int]) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append(real)


def agreement(left: list[bytes], right: list[bytes], least: float) -> np.ndarray:
    """Pairs of signatures that agree on a share of ``least`` coordinates."""
    a, b = (np.frombuffer(b"".join(x), "<u2").reshape(len(x), -1) for x in (left, right))
    return np.array([(row == b).mean(axis=1) >= least for row in a])


def resemblance(left: list[bytes], right: list[bytes], least: float) -> np.ndarray:
    """Pairs of shingle sets with a Jaccard similarity of ``least``, counted exactly."""
    a, b = ([np.frombuffer(s, "<u4") for s in x] for x in (left, right))
    sizes = [np.array([len(s) for s in x]) for x in (a, b)]
    flat = np.concatenate([*a, *b])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(a) + len(b)), np.concatenate(sizes))
    shared = times[column] > 1
    place = np.cumsum(times > 1) - 1  # elements that only one set holds add nothing
    column, owner = place[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        i, j = np.searchsorted(column, (begin, begin + 8192))
        held = np.zeros((len(a) + len(b), 8192), np.float32)
        held[owner[i:j], column[i:j] - begin] = 1
        common += held[: len(a)] @ held[len(a) :].T
    union = sizes[0][:, None] + sizes[1][None] - common
    return common >= least * union - 1e-6


def _linked(rows: DataFrame, keys: list[str], alike: Callable, least: float) -> DataFrame:
    """Edges that join what is alike within each group of ``rows``.

    ``rows`` has ``keys``, ``slot`` (the group's number among those with the same
    first key, so that the groups of a large family go to different tasks), ``node``, ``part`` (the node's component so far),
    ``asks`` (1: compared with all that answer, 0: answers, 2: both) and
    ``payload``. Groups are bounded by those who make them.
    """
    parts = shuffle_partitions(rows.sparkSession)
    placed = rows.repartitionById(parts, F.pmod(F.xxhash64(keys[0]) + F.col("slot"), F.lit(parts)).cast("int")).sortWithinPartitions(*keys, "node")

    def edges(names: list[int], parts: list[int], asks: list[int], payloads: list[bytes]) -> list[tuple[int, int]]:
        left = [i for i, x in enumerate(asks) if x]
        right = [i for i, x in enumerate(asks) if x != 1]
        forest = _Forest()
        if left and right:
            hits = alike([payloads[i] for i in left], [payloads[i] for i in right], least)
            for x, y in np.argwhere(hits):
                i, j = left[x], right[y]
                if names[i] != names[j]:
                    forest.join(parts[i], parts[j], (names[i], names[j]))
        return forest.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "node", "part", "asks", "payload")]
            for row in zip(*columns):
                if row[: len(keys)] != key:
                    if held:
                        out += edges(*map(list, zip(*held)))
                    key, held = row[: len(keys)], []
                held.append(row[len(keys) :])
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])
                out = []
        if held:
            out += edges(*map(list, zip(*held)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])

    return placed.select(*keys, "node", "part", "asks", "payload").mapInArrow(tidy(run), "u long, v long")


def _block(count: Column, size: int, salt: int) -> Column:
    """A block for ``node``, of about ``size`` of the group's ``count`` nodes."""
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.greatest(F.lit(1), F.ceil(count / size))).cast("int")


def _apart(members: DataFrame, group: str, size: int) -> DataFrame:
    """Rows for ``_linked`` that compare what is apart in each group.

    ``members`` has ``group, node, part``. Every node outside the group's
    largest part asks all nodes of the group, block by block.
    """
    parts = members.groupBy(group, "part").agg(F.count("*").alias("n"))
    facts = parts.groupBy(group).agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("part", F.struct("n", "part")).alias("core"), F.count("*").alias("parts"))
    facts = facts.where("parts > 1").select(group, "all", "core", (F.col("all") - F.col("most")).alias("minor"))
    rows = members.join(facts, group)
    blocks, teams = F.ceil(F.col("all") / size).cast("int"), F.ceil(F.col("minor") / size).cast("int")
    rows = rows.withColumn("teams", teams)
    base = rows.select(
        group, "teams", "node", "part", F.lit(0).alias("asks"), _block(F.col("all"), size, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("teams") - 1)).alias("team")
    )
    asking = rows.where("part <> core").select(
        group, "teams", "node", "part", F.lit(1).alias("asks"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), _block(F.col("minor"), size, 2).alias("team")
    )
    return base.unionByName(asking).withColumn("slot", F.col("block").cast("long") * F.col("teams") + F.col("team")).drop("teams")


def _parts(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` with their component; a node without an edge is its own."""
    joined = nodes.drop("part").join(found.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
    return joined.withColumn("part", F.coalesce("component", "node")).drop("component", "__node")


def near_classes(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    bands: int = 32,
    band_rows: int = 5,
    weighted: bool = True,
    alike: float = 0.55,
    block: int = 256,
) -> DataFrame:
    """``doc_id, class_id, class_size`` for every row of ``df``.

    A document's ``words``-word shingles weigh as often as they occur in it (each
    once, if not ``weighted``). Documents with a weighted Jaccard similarity, sum
    of least over sum of greatest weights, of at least ``similarity`` are linked,
    and linked documents form a class, named by its least id. A pair at 0.8 shares none of 32 bands of 5 with
    probability 3e-6; ``alike`` is the share of agreeing coordinates from which
    a pair may be in one family, 8 standard errors below 0.8.

    A null text counts as empty; documents without words are classes of their
    own, as are rows without an id, whose class is null. Rows with one id are
    one document, so their classes are joined. Repeated rows come back as they
    are. Other columns are not read. An empty table gives an empty result.
    """
    rows = df.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    drawn = settle(sketch(rows, words, bands, band_rows, weighted), "sketches")
    known = drawn.where("doc_id is not null and set_hash is not null")

    # the first row of equal sets stands for all of them
    first = settle(known.groupBy("set_hash").agg(F.min("row").alias("node")), "first")
    reps = settle(known.select(F.col("row").alias("node"), "signature", "buckets").join(first.select("node").hint("merge"), "node"), "representatives")
    # ids with several sets, or with and without words, and the least of their sets
    mark = F.when(F.col("set_hash").isNotNull(), F.xxhash64("set_hash"))
    twins = drawn.where("doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.count("*").alias("n"), F.count("set_hash").alias("full"))
    twins = settle(twins.where("low <> high or (full > 0 and full < n)").select("doc_id"), "twin-ids")
    twins = settle(known.select("doc_id", "set_hash").join(twins, "doc_id").groupBy("doc_id").agg(F.min("set_hash").alias("least")), "twins")
    entries = reps.select("node", F.explode("buckets").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    entries = settle(entries.join(shared, "bucket"), "entries")

    # families through hubs
    stars = entries.select("node", F.explode(F.array("hub", "last")).alias("hub")).where("node <> hub").distinct()
    hubs = reps.select(F.col("node").alias("hub"), F.col("signature").alias("hub_signature"))
    paired = stars.join(reps.select("node", "signature"), "node").join(hubs, "hub")
    families = components(settle(_alike_pairs(paired, alike), "hub-edges"))

    # families through all other pairs of buckets that hold several
    members = _parts(entries.select("bucket", "node"), families)
    crossed = settle(_apart(members, "bucket", block), "crossed").join(reps.select("node", F.col("signature").alias("payload")), "node")
    more = settle(_linked(crossed, ["bucket", "block", "team"], agreement, alike), "bucket-edges")
    families = components(_star_edges(families).unionByName(more))

    # exact links inside families: the sets of their members, moved once to where they are compared
    sizes = families.groupBy("component").agg(F.count("*").alias("n"))
    own = families.join(sizes, "component").select(F.col("component").alias("family"), "node", "n").withColumn("block", _block(F.col("n"), block, 3))
    own = settle(own, "families")
    sets = known.select(F.col("row").alias("node"), F.col("shingles").alias("payload")).join(own.hint("merge"), "node")
    sets = settle(sets, "sets")
    base = sets.select("family", "block", "node", F.col("node").alias("part"), F.lit(2).alias("asks"), "payload")
    later = F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / block).cast("int") - 1))
    spread = sets.where(f"block = 0 and n > {block}").select("family", later.alias("block"), "node", F.col("node").alias("part"), F.lit(1).alias("asks"), "payload")
    classes = components(settle(_linked(base.unionByName(spread).withColumn("slot", F.col("block").cast("long")), ["family", "block"], resemblance, similarity), "links"))

    # what is still apart in families of several blocks
    large = _parts(own.where(f"n > {block}").select("family", "node"), classes)
    apart = settle(_apart(large, "family", block), "apart").join(sets.where(f"n > {block}").select("node", "payload"), "node")
    rest = settle(_linked(apart, ["family", "block", "team"], resemblance, similarity), "late-links")
    # all sets of one id
    nodes = first
    same = known.select("doc_id", "set_hash").join(twins, "doc_id").where("set_hash <> least").select("set_hash", "least").distinct()
    same = same.join(nodes.withColumnRenamed("node", "u"), "set_hash").join(nodes.select(F.col("set_hash").alias("least"), F.col("node").alias("v")), "least")
    classes = components(_star_edges(classes).unionByName(rest).unionByName(same.select("u", "v")))

    named = drawn.where("doc_id is not null").select("doc_id", "set_hash").join(twins, "doc_id", "left")
    named = named.select("doc_id", F.coalesce("set_hash", "least").alias("set_hash"))
    out = _parts(named.join(nodes, "set_hash"), classes).select("doc_id", "part", F.lit(False).alias("alone"))
    # ids without words
    out = out.unionByName(named.where("set_hash is null").select("doc_id", F.col("doc_id").alias("part"), F.lit(True).alias("alone")))
    # settled, so that the join below can split the rows of a large class
    total = settle(out.groupBy("part", "alone").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "class-sizes")
    out = out.join(total, ["part", "alone"]).select("doc_id", "class_id", "class_size")
    unnamed = drawn.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(unnamed)


def _star_edges(found: DataFrame) -> DataFrame:
    return found.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))


def _alike_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs of ``node, signature, hub, hub_signature`` that agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(part.num_rows, -1) for c in ("signature", "hub_signature"))
                hit = pa.array((a == b).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("hub")], ["u", "v"]).filter(hit)

    return pairs.select("node", "hub", "signature", "hub_signature").mapInArrow(tidy(run), "u long, v long")


def drop_near_copies(df: DataFrame, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``df`` with one document of each class, the one with the least id; same columns.

    Columns may have any names. Rows without an id stay, and so do repeated rows
    of a document that stays. Null and empty texts are alike to nothing. An empty
    table gives an empty one.
    """
    columns = df.columns
    classes = near_classes(df, id, text, **settings)
    gone = classes.where("doc_id is not null and doc_id <> class_id").select("doc_id").distinct()
    marked = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    kept = marked.join(gone, F.col(f"c{columns.index(id)}").cast("long") == F.col("doc_id"), "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])

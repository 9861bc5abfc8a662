"""Connected components of an edge table, by alternating large and small stars; of a small one on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import settle


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges, and the least node that it is connected with."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = places[: len(u)], places[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
    return nodes, nodes[root]


def components(edges: DataFrame, on_driver: int = 50_000) -> DataFrame:
    """``node, component`` of every node of ``u, v``; the component is its least node.

    Up to ``on_driver`` edges, 16 bytes each, are joined on the driver: a round over few
    edges writes as many small files as there are partitions. More are joined in
    rounds, each of which writes its edges to the shared folder, so that lineage
    stays short; then only a count and a checksum come to the driver.
    """
    edges = edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    if edges.count() <= on_driver:
        found = edges.toArrow()
        nodes, least = least_nodes(*(found.column(c).to_numpy() for c in ("u", "v")))
        return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "component": least}))
    now = settle(edges.distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not mark[0] or tuple(mark) == before:
            break
        before = tuple(mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # settled, so that the join can split the edges of a node with very many
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

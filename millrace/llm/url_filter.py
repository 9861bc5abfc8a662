"""URL filters: listed rules, and a path-template tree for all other URLs.

Each host has a tree whose levels are path segments. Numbers and digests are
wildcards from the start. From the top down, the branches of a node that holds
both verdicts are compared with one another, and those whose shares of blocked
labels do not differ are merged; a node whose labels agree is a leaf. What tells
branches apart may stand at any depth. Every level has a smoothed purity, drawn
towards that of the level above it, and a template is rejected if its own is too
high.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import settle


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: Fixed values.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def segment_kind(segment: Column) -> Column:
    """A segment with its varying parts replaced: digests, then numbers."""
    plain = F.regexp_replace(segment, r"(?i)(?<![0-9a-z])(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "{x}")
    return F.regexp_replace(plain, r"[0-9]+", "{n}")


def apart(b1: float, n1: float, b2: float, n2: float, z: float) -> bool:
    """Two shares lie more than ``z`` standard errors apart (adjusted Wald)."""
    p1, p2 = (b1 + 1) / (n1 + 2), (b2 + 1) / (n2 + 2)
    error = (p1 * (1 - p1) / (n1 + 2) + p2 * (1 - p2) / (n2 + 2)) ** 0.5
    return abs(p1 - p2) > z * error


def merge_branches(counts: Iterable[tuple[int, int, int]], z: float) -> dict[tuple[int, int], int]:
    """A group for the branches of one node, by their (allowed, blocked) counts.

    ``counts`` has (allowed, blocked, branches) for each distinct pair. From the
    most to the fewest labels, branches join the group whose share is nearest
    to theirs, if one of them does not differ from it, and open a group if it
    does. Branches without labels join the only group, or make one, -1.
    """
    groups: list[list[int]] = []
    out: dict[tuple[int, int], int] = {}
    for a, b, times in sorted(counts, key=lambda x: (-x[0] - x[1], -x[1])):
        if a + b == 0:
            out[a, b] = 0 if len(groups) == 1 else -1
            continue
        share = b / (a + b)
        best = min(range(len(groups)), key=lambda i: abs(groups[i][0] / groups[i][1] - share), default=None)
        if best is None or apart(b, a + b, *groups[best], z):
            best = len(groups)
            groups.append([0, 0])
        groups[best][0] += b * times
        groups[best][1] += (a + b) * times
        out[a, b] = best
    return out


def _merged(nodes: DataFrame, z: float) -> DataFrame:
    """``host, template, a, b, part`` of ``host, template, a, b, times``.

    A node's branches with the same counts are one row, so that a node with very
    many branches has few rows.
    """

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        a, b, times = (table.column(c).to_pylist() for c in ("a", "b", "times"))
        found = merge_branches(zip(a, b, times), z)
        names = {c: pa.array([k.as_py()] * len(a), pa.string()) for c, k in zip(("host", "template"), key)}
        return pa.table({**names, "a": a, "b": b, "part": pa.array([found[x] for x in zip(a, b)], pa.int32())})

    return nodes.groupBy("host", "template").applyInArrow(merge, "host string, template string, a long, b long, part int")


def path_templates(paths: DataFrame, overall: float, z: float, prior: float) -> DataFrame:
    """``host, segments, template, purity`` of ``host, segments, allowed, blocked``.

    A round is one level of all trees, over the distinct paths below nodes that
    hold both verdicts; rounds end when there are none. A template names a
    merged branch by its first members, and ends in ``/**`` at a leaf that has
    something below it.
    """

    def smoothed(a: str, b: str, towards: Column) -> Column:
        return (F.col(b) + prior * towards) / (F.col(a) + F.col(b) + prior)

    hosts = paths.groupBy("host").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    hosts = hosts.select("host", smoothed("a", "b", F.lit(overall)).alias("purity"), ((F.col("a") > 0) & (F.col("b") > 0)).alias("mixed"))
    rows = paths.withColumn("template", F.lit("")).join(hosts, "host")
    done, level = [], 0
    while True:
        level += 1
        rows = rows.withColumn("branch", F.get("segments", F.lit(level - 1)))
        leaf = F.when(F.col("branch").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/**")))
        done.append(rows.where("not mixed").select("host", "segments", leaf.alias("template"), "purity"))
        rows = rows.where("mixed")
        branches = settle(rows.groupBy("host", "template", "branch").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")), f"url-branches-{level}")
        if branches.isEmpty():
            break
        below = branches.where("branch is not null")
        parts = _merged(below.groupBy("host", "template", "a", "b").agg(F.count("*").alias("times")), z)
        below = settle(below.join(parts, ["host", "template", "a", "b"]), f"url-parts-{level}")
        # paths that end here are a branch of their own
        first = F.slice(F.sort_array(F.collect_set("branch")), 1, 3)
        named = below.groupBy("host", "template", "part", F.xxhash64("branch").bitwiseAND(63).alias("salt")).agg(
            first.alias("first"), F.count("*").alias("members"), F.sum("a").alias("a"), F.sum("b").alias("b")
        )
        named = named.groupBy("host", "template", "part").agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("first"))), 1, 3).alias("first"), F.sum("members").alias("members"), F.sum("a").alias("a"), F.sum("b").alias("b")
        )
        more = F.when(F.col("members") > 3, F.concat(F.lit("|+"), (F.col("members") - 3).cast("string"))).otherwise("")
        whole = F.concat(F.array_join("first", "|"), more)
        step = F.concat(F.lit("/"), F.when(F.col("members") == 1, whole).otherwise(F.concat(F.lit("("), whole, F.lit(")"))))
        named = named.select("host", "template", "part", step.alias("step"), "a", "b", ((F.col("a") > 0) & (F.col("b") > 0)).alias("mixed"))
        steps = below.select("host", "template", "branch", "part").join(named, ["host", "template", "part"]).drop("part")
        ends = branches.where("branch is null").select("host", "template", "branch", F.lit("").alias("step"), "a", "b", F.lit(False).alias("mixed"))
        steps = steps.unionByName(ends).withColumn("branch", F.coalesce("branch", F.lit("")))
        rows = rows.drop("mixed").withColumn("branch", F.coalesce("branch", F.lit(""))).join(steps, ["host", "template", "branch"])
        rows = rows.withColumn("purity", smoothed("a", "b", F.col("purity"))).withColumn("template", F.concat("template", "step"))
        rows = settle(rows.drop("branch", "step", "a", "b"), f"url-level-{level}")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def judge_urls(
    df: DataFrame,
    id: str = "page_id",
    url: str = "url",
    rules: tuple[UrlRule, ...] = RULES,
    z: float = 3.0,
    prior: float = 4.0,
    purity: float = 0.5,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row.

    The longest listed rule that fits decides. URLs that a rule decides are the
    labels of the tree, which decides the others: block if the smoothed share of
    blocked labels of the template is above ``purity``. A level's share is
    ``(blocked + prior * share of the level above) / (labels + prior)``; above a
    host stand all hosts together. Paths are read to the end.

    Null URLs, and those without ``://``, have an empty host and path. Repeated
    rows and rows without an id are judged alike, and so are very long URLs.
    Other columns are not read. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    rows = df.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("listed"))
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    kinds = F.transform(parts, segment_kind)
    rows = rows.withColumn("segments", F.when(F.size(parts) > 0, kinds).otherwise(F.array().cast("array<string>")))
    counts = rows.groupBy("host", "segments").agg(F.count(F.when(F.col("listed") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("listed") == "block", 1)).alias("blocked"))
    counts = settle(counts, "url-paths")
    total = counts.agg(F.sum("allowed"), F.sum("blocked")).first()
    overall = (total[1] or 0) / max(1, (total[0] or 0) + (total[1] or 0))
    judged = settle(path_templates(counts, overall, z, prior), "url-templates")
    joined = rows.join(judged, ["host", "segments"], "left")
    own = F.when(F.col("purity") > purity, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("listed", own).alias("verdict"), "template", "purity")

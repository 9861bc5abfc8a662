"""Secret scans through a trigram inverted index; built-in functions only.

Each rule's regular expression gives a Boolean query over trigrams that every
match must hold. An inverted index has, for each block of rows and each of
those trigrams, the keys of the rows whose text holds it. Intersecting and
uniting the postings gives each rule's candidates, and only these are verified
with the regular expression. A rule without a mandatory trigram scans all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:  # the parser's public name ended with Python 3.11
    from re import _constants as _op
    from re import _parser as _sre
except ImportError:  # pragma: no cover
    import sre_constants as _op
    import sre_parse as _sre

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost and do not overlap.

    A match is dropped if its ``group`` has fewer than ``least`` characters.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed values. A run of the same characters is one match, so that the least
#: lengths of ``access`` (18) and ``hex`` (16) are part of their patterns.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)

#: Published formats of keys, which the index finds without reading other texts. Fixed values.
MORE_RULES = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{24,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)

# -- Boolean queries over trigrams: None (anything), a trigram, ("and" | "or", parts) --


def _all_of(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any_of(parts: list) -> object:
    if any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _query(tokens) -> object:
    found: list = []
    run = ""

    def end() -> None:
        nonlocal run
        found.extend(run[i : i + 3] for i in range(len(run) - 2))
        run = ""

    for op, value in tokens:
        if op is _op.LITERAL:
            run += chr(value).translate(str.maketrans(_UPPER, _LOWER))
            continue
        end()
        if op is _op.SUBPATTERN:
            found.append(_query(value[-1]))
        elif op is _op.BRANCH:
            found.append(_any_of([_query(v) for v in value[1]]))
        elif op in (_op.MAX_REPEAT, _op.MIN_REPEAT) and value[0] >= 1:
            found.append(_query(value[2]))
    end()
    return _all_of(found)


def trigram_query(pattern: str) -> object:
    """What every match of ``pattern`` must hold, A-Z lower-cased; None: nothing."""
    return _query(_sre.parse(pattern))


def _trigrams(query: object) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1:]))


def _evaluate(query: object, postings: dict[str, Column]) -> Column:
    """The keys of a block's rows that satisfy ``query``."""
    if isinstance(query, str):
        return postings[query]
    merge = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(merge, (_evaluate(p, postings) for p in query[1:]))


# -- index and search --


def build_index(rows: DataFrame, trigrams: list[str], block_rows: int = 4096) -> DataFrame:
    """``block, trigram, postings`` over ``key, text``.

    Keys spread evenly over blocks of about ``block_rows`` rows, which bounds
    every posting list, however common a trigram or a text is.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    folded = F.translate("text", _UPPER, _LOWER)
    held = rows.select("key", folded.alias("folded")).select(
        "key", F.explode(F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), t) for t in trigrams]))).alias("trigram")
    )
    return held.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("key").alias("postings"))


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """``key, kinds``: the rules that each row may match, from the postings."""
    trigrams = sorted(set().union(*map(_trigrams, queries.values())))
    none = F.array().cast("array<long>")
    merged = index.groupBy("block").agg(
        *[F.coalesce(F.first(F.when(F.col("trigram") == t, F.col("postings")), ignorenulls=True), none).alias(f"p{i}") for i, t in enumerate(trigrams)]
    )
    postings = {t: F.col(f"p{i}") for i, t in enumerate(trigrams)}
    found = [F.struct(F.lit(kind).alias("kind"), _evaluate(q, postings).alias("keys")) for kind, q in queries.items()]
    hits = merged.select(F.explode(F.array(*found)).alias("hit")).select("hit.kind", F.explode("hit.keys").alias("key"))
    return hits.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of the rule's matches, in code points."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    step = F.zip_with(
        F.zip_with(between, whole, lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("size"))),
        kept,
        lambda x, k: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.char_length(k).alias("kept")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["kept"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    # most texts have no match, and need no second pass
    return F.when(F.size(whole) > 0, F.aggregate(step, start, add, lambda acc: acc["out"])).otherwise(start["out"])


def find_secrets(
    df: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE_RULES, base: int = 3, block_rows: int = 4096
) -> DataFrame:
    """``doc_id``, ``n_<kind>`` of each rule, ``base_sha256`` and ``spans`` for every row.

    ``spans`` has kind:start:end of every match by start, then kind, joined by
    commas; ``base_sha256`` is the digest of those of the first ``base`` rules.
    A null text counts as empty, and a text without a match has empty spans.
    Rows without an id and repeated rows come back as they are. Other columns
    are not read. An empty table gives an empty result.
    """
    key = F.xxhash64(F.col(id), F.col(text))
    rows = df.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), key.alias("key"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    if queries:
        trigrams = sorted(set().union(*map(_trigrams, queries.values())))
        found = candidates(build_index(rows, trigrams, block_rows), queries)
        # keys of different rows that collide only add a row to verify
        rows = rows.join(found, "key", "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    for i, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, i)
        if rule.kind in queries:
            spans = F.when(F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)), spans).otherwise(none)
        rows = rows.withColumn(f"s{i}", spans)
    names = F.array(*[F.lit(r.kind) for r in rules])

    def joined(n: int) -> Column:
        spans = F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(n)]))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    return rows.select(
        "doc_id",
        *[F.size(f"s{i}").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(len(rules)).alias("spans"),
    )

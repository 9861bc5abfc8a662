"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import read_table


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to token files and read back.

    Null text: the end id alone; documents without an id come first; repeated rows are documents of
    their own; an empty table gives no rows.
    """
    from millrace.llm.token_file import token_table

    return token_table(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document.

    Null and empty texts have none; repeated rows and rows without an id come back as they are; an
    empty table gives no rows.
    """
    from millrace.llm.secret_scan import BASE_RULES, MORE_RULES, find_secrets

    return find_secrets(read_table(spark, sf_dir, "documents"), rules=(*BASE_RULES, *MORE_RULES), base=len(BASE_RULES))


#: Kind, pattern, group and least length of every rule, in their order.
_OP2_RULES = (
    (
        "assign",
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", "github_pat_[A-Za-z0-9_]{22,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("stripe", "sk_live_[A-Za-z0-9]{24,}", 0, 1),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 1),
)


def _op2_sql() -> str:
    """One scan for each kind: what lies between the matches gives their places."""
    scans = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {i} AS place, {least} AS least, regexp_extract_all(text, '{p}', 0) AS whole, "
        f"regexp_extract_all(text, '{p}', {group}) AS part, regexp_split_to_array(text, '{p}') AS gaps FROM d"
        for i, (kind, p, group, least) in enumerate(_OP2_RULES)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in _OP2_RULES)
    named = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in _OP2_RULES)
    listed = "string_agg(kind || ':' || (stop - width) || ':' || stop, ',' ORDER BY stop - width, place)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({scans}),
u AS (
  SELECT doc_id, kind, place, least, unnest(whole) AS w, unnest(part) AS v, unnest(gaps[1:len(whole)]) AS g, unnest(range(1, len(whole) + 1)) AS i
  FROM m WHERE len(whole) > 0
), s AS (
  SELECT doc_id, kind, place, least, len(v) AS size,
    CAST(sum(len(g) + len(w)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop, len(w) AS width
  FROM u
), k AS (
  SELECT doc_id, {counts}, {listed} FILTER (place < 3) AS base, {listed} AS spans
  FROM s WHERE size >= least GROUP BY doc_id
)
SELECT d.doc_id, {named}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


OP2_SQL = _op2_sql()


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, a row for every document.

    Null counts as empty; of rows that repeat id and text one is kept; a row without an id is kept
    where its group has no other; an empty table gives no rows.
    """
    from millrace.llm.exact_dedup import exact_groups

    return exact_groups(read_table(spark, sf_dir, "documents"), keep="largest")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
), g AS (
  SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document.

    Null and empty texts have none; repeated rows and rows without an id come back as they are; an
    empty table gives no rows.
    """
    from millrace.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page.

    Null URLs have an empty host and path; repeated rows and rows without an id are judged alike; an
    empty table gives no rows.
    """
    from millrace.llm.url_filter import judge_urls

    return judge_urls(read_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every document.

    Null and letterless texts are ``und`` with score 0; repeated rows come back as they are, rows
    without an id are not held out; an empty table gives no rows.
    """
    from millrace.llm.language import identify

    return identify(read_table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth id.

    Null, zero and non-finite vectors take no part; rows that repeat an id are all candidates, and
    queries where their vectors differ; an empty table gives no rows.
    """
    from millrace.llm.neighbours import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for every document.

    Texts without words are classes of their own; rows of one id share a class; a row without an id
    has none; an empty table gives no rows.
    """
    from millrace.llm.near_dedup import near_classes

    return near_classes(read_table(spark, sf_dir, "documents"), words=5, similarity=0.8)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in windows of 2048 ids.

    Null text: the end id alone; repeated rows and rows without an id are documents of their own; an
    empty table gives no rows.
    """
    from millrace.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=1, memo_entries=1_000_000)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document.

    Null text has none; a null source is one of its own; rows that repeat id and text share what is
    taken; an empty table gives no rows.
    """
    from millrace.llm.mixing import mix

    out = mix(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS rank
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM d GROUP BY source
), o AS (
  -- sources in the order in which a rising level reaches their caps
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS caps_before, coalesce(sum(weight) OVER w, 0) AS weights_before,
         1.5 * sum(source_size) OVER () AS budget, count(*) OVER w AS place, sum(weight) OVER () AS weights
  FROM s WINDOW w AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  -- the first source that its level does not lift above its cap
  SELECT arg_min(level, place) AS level
  FROM (SELECT *, CAST(budget - caps_before AS DOUBLE) / CAST(weights - weights_before AS DOUBLE) AS level FROM o)
  WHERE CAST(2 * source_size AS DOUBLE) >= weight * level
), t AS (
  SELECT source, source_size,
         least(CAST(2 * source_size AS DOUBLE), weight * (SELECT level FROM l)) AS target
  FROM s
), r AS (
  -- rows that repeat id and text share a rank
  SELECT source, rank, count(*) AS copies, sum(size) AS words FROM d GROUP BY source, rank
), a AS (
  SELECT *, CAST(coalesce(sum(words) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM r
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, a.copies, a.words,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(round(t.target - whole * t.source_size) AS BIGINT) - a.ahead AS rest
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
  JOIN a ON d.source IS NOT DISTINCT FROM a.source AND d.rank = a.rank
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + CASE WHEN rest >= words THEN size WHEN rest > 0 THEN rest // copies ELSE 0 END AS BIGINT) AS taken
FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_file, op2_secret_scan, op3_exact_dedup, op4_token_counts, op5_url_filter, op6_language_id, op7_neighbours, op8_near_dedup, op9_packing, op10_mixing)
}
ORACLES: dict[str, str] = {"op2_secret_scan": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op10_mixing": OP10_SQL}

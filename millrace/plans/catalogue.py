"""Every query of the core engine, by name, and its SQL.

Each query applies one operator to whole tables. Floats are rounded to six
digits on both sides, as sums over partitions are not stable in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalars as S
from millrace.operators import boosting, cleaning, evaluation, linear, profile, sampling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a label (purchases) and a score in (0, 1)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", (F.col("event_type") == "purchase").cast("int").alias("y"), F.round(F.col("value") / (F.col("value") + 50), 3).alias("p"))


EVENTS_SQL = "(SELECT event_id, user_id, CAST(event_type = 'purchase' AS INTEGER) AS y, round(value / (value + 50), 3) AS p FROM events)"

# -- evaluation --

METRICS_SQL = """
  CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS accuracy, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
  tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall, tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS specificity,
  CASE WHEN tp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1
"""
CELLS_SQL = "count(*) FILTER ({t} = 1 AND {p} = 1) AS tp, count(*) FILTER ({t} = 0 AND {p} = 1) AS fp, count(*) FILTER ({t} = 0 AND {p} = 0) AS tn, count(*) FILTER ({t} = 1 AND {p} = 0) AS fn"


@query(
    f"""SELECT tp AS true_positive, fp AS false_positive, tn AS true_negative, fn AS false_negative, round(accuracy, 6) AS accuracy,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1,
  round((recall + specificity) / 2, 6) AS balanced_accuracy
FROM (SELECT *, {METRICS_SQL} FROM (SELECT {CELLS_SQL.format(t='quality', p='toxic')} FROM labels))"""
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.metrics(evaluation.confusion(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"))))


CURVE_SQL = f"""(SELECT p AS threshold, y, n, sum(y) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS predicted, sum(y) OVER () AS positives, sum(n) OVER () AS total
  FROM (SELECT p, sum(y) AS y, count(*) AS n FROM {EVENTS_SQL} GROUP BY p))"""


@query(f"SELECT threshold, round(tp / predicted, 6) AS precision, round(tp / positives, 6) AS recall FROM {CURVE_SQL}")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.precision_recall_curve(scored_events(spark, sf_dir), F.col("y"), F.col("p")))


@query(f"SELECT round(sum(y * tp / predicted) / sum(y), 6) AS average_precision FROM {CURVE_SQL}")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.average_precision(scored_events(spark, sf_dir), F.col("y"), F.col("p")))


@query(
    f"""SELECT threshold, none_positive, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM (
  SELECT threshold, false AS none_positive, 2 * tp / (predicted + positives) AS f1, (tp + total - positives - (predicted - tp)) / total AS accuracy FROM {CURVE_SQL}
  UNION ALL SELECT NULL, true, 0, 1 - sum(y) / count(*) FROM {EVENTS_SQL})
ORDER BY round(f1, 15) DESC, accuracy DESC, none_positive DESC, threshold DESC LIMIT 1"""
)
def best_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.best_f1_threshold(scored_events(spark, sf_dir), F.col("y"), F.col("p")))


@query(f"SELECT round(avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))), 6) AS log_loss FROM {EVENTS_SQL}")
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.log_loss(scored_events(spark, sf_dir), F.col("y"), F.col("p")))


TRANSITION_SQL = f"(SELECT y, CAST(p >= 0.5 AS INTEGER) AS a, CAST(p >= 0.6 AS INTEGER) AS b, p, CAST(user_id % 7 AS DOUBLE) / 7 AS q FROM {EVENTS_SQL})"


def _two_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scored_events(spark, sf_dir)
    return e.select("y", (F.col("p") >= 0.5).cast("int").alias("a"), (F.col("p") >= 0.6).cast("int").alias("b"), "p", ((F.col("user_id") % 7).cast("double") / 7).alias("q"))


@query(
    f"""SELECT count(*) FILTER (y = 1 AND a = 0 AND b = 1) AS recovered_fn, count(*) FILTER (y = 1 AND a = 1 AND b = 0) AS lost_tp,
  count(*) FILTER (y = 0 AND a = 0 AND b = 1) AS added_fp, count(*) FILTER (y = 0 AND a = 1 AND b = 0) AS removed_fp FROM {TRANSITION_SQL}"""
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.transitions(_two_predictions(spark, sf_dir), F.col("y"), F.col("a"), F.col("b"))


@query(f"SELECT y AS truth, a AS before, b AS after, count(*) AS n FROM {TRANSITION_SQL} GROUP BY ALL")
def bootstrap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap_cells(_two_predictions(spark, sf_dir), F.col("y"), F.col("a"), F.col("b"))


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap, low, high = evaluation.paired_bootstrap(bootstrap_counts(spark, sf_dir))
    return spark.createDataFrame([(gap, low, high)], "difference double, low double, high double")


@query(f"SELECT round(corr(p, q), 6) AS correlation, round(avg(abs(p - q)), 6) AS mean_absolute_difference FROM {TRANSITION_SQL}")
def score_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.score_agreement(_two_predictions(spark, sf_dir), F.col("p"), F.col("q")))


@query("SELECT user_id AS row_id, round(avg(value), 6) AS p FROM events GROUP BY user_id")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.ensemble_mean(table(spark, sf_dir, "events").select(F.col("user_id").alias("row_id"), F.col("value").alias("p"))))


FOLD_SQL = f"(SELECT *, event_id % 3 AS fold FROM {EVENTS_SQL})"


@query(
    f"""WITH c AS (SELECT f.fold AS k, p AS t, sum(y) AS y, count(*) AS n FROM {FOLD_SQL} e JOIN (SELECT unnest([0, 1, 2]) AS fold) f ON e.fold <> f.fold GROUP BY ALL),
r AS (SELECT k, t, sum(y) OVER w AS tp, sum(n) OVER w AS predicted, sum(y) OVER (PARTITION BY k) AS positives, sum(n) OVER (PARTITION BY k) AS total FROM c WINDOW w AS (PARTITION BY k ORDER BY t DESC)),
b AS (SELECT k, t FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(2 * tp / (predicted + positives), 15) DESC, (tp + total - positives - (predicted - tp)) / total DESC, t DESC) = 1),
m AS (SELECT k AS fold, t AS threshold, {CELLS_SQL.format(t='y', p='CAST(p >= t AS INTEGER)')} FROM {FOLD_SQL} e JOIN b ON e.fold = b.k GROUP BY ALL)
SELECT CAST(fold AS INTEGER) AS fold, threshold, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM (SELECT *, {METRICS_SQL} FROM m)"""
)
def cross_fit_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scored_events(spark, sf_dir).withColumn("fold", F.col("event_id") % 3)
    return rounded(evaluation.cross_fit_thresholds(e, F.col("y"), F.col("p"), "fold", 3))


# -- cleaning and encoding --

QUANTITY = cleaning.Codes({7.0: "unknown", 9.0: "refused"})
SIZE = cleaning.Codes({49.0: "refused"}, (50.0,))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IN (7, 9) THEN NULL ELSE l_quantity END AS quantity FROM lineitem")
def recode_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cleaning.cleaned(F.col("l_quantity"), QUANTITY).alias("quantity"))


@query("SELECT p_partkey, CASE WHEN p_size = 49 THEN NULL WHEN p_size = 50 THEN 0 ELSE p_size END AS size FROM part")
def zero_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.cleaned(F.col("p_size"), SIZE).alias("size"))


@query("SELECT l_returnflag, sum(CAST(l_quantity = 7 AS INTEGER)) AS unknown, sum(CAST(l_quantity = 9 AS INTEGER)) AS refused, 0 AS blank FROM lineitem GROUP BY l_returnflag")
def reason_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.sum(cleaning.reason_flag(F.col("l_quantity"), QUANTITY, r)).alias(r) for r in ("unknown", "refused", "blank")]
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*flags)


@query("SELECT p_partkey, p_size BETWEEN 1 AND 20 OR p_size BETWEEN 30 AND 45 AS allowed FROM part")
def interval_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.in_intervals(F.col("p_size"), [(1, 20), (30, 45)]).alias("allowed"))


@query(
    """WITH c AS (SELECT p_partkey, CASE WHEN p_size IN (1, 2) THEN NULL ELSE p_size END AS size, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS price FROM part),
f AS (SELECT median(price) AS price, (SELECT size FROM c WHERE size IS NOT NULL GROUP BY size ORDER BY count(*) DESC, size LIMIT 1) AS size FROM c),
x AS (SELECT p_partkey, coalesce(c.size, f.size) AS size, coalesce(c.price, f.price) AS price FROM c, f)
SELECT p_partkey, round((size - (SELECT avg(size) FROM x)) / (SELECT stddev_pop(size) FROM x), 6) AS size_z, round((price - (SELECT avg(price) FROM x)) / (SELECT stddev_pop(price) FROM x), 6) AS price_z FROM x"""
)
def mode_median_fill_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    c = p.select("p_partkey", cleaning.cleaned(F.col("p_size"), cleaning.Codes({1: "unknown", 2: "unknown"})).alias("size"), F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("price"))
    size, price = cleaning.fit_fills(c, {"size": "mode", "price": "median"})
    return rounded(c.select("p_partkey", cleaning.scaled(size).alias("size_z"), cleaning.scaled(price).alias("price_z")))


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("seg"))
    return c, cleaning.categories(c.where("c_custkey % 3 <> 0 and seg <> 'BUILDING'"), "seg")


SEGMENT_SQL = "(SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS seg FROM customer)"


def _one_hot(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    c, values = _segments(spark, sf_dir)
    return c.select("c_custkey", *[x.alias(n.lower()) for n, x in cleaning.one_hot("seg", values, mode).items()])


@query(
    f"""SELECT c_custkey, coalesce(CAST(seg = 'FURNITURE' AS INTEGER), 0) AS seg__furniture, coalesce(CAST(seg = 'HOUSEHOLD' AS INTEGER), 0) AS seg__household,
  coalesce(CAST(seg = 'MACHINERY' AS INTEGER), 0) AS seg__machinery, CAST(seg IS NULL AS INTEGER) AS seg__missing FROM {SEGMENT_SQL}"""
)
def one_hot_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_hot(spark, sf_dir, "linear")


@query(
    f"""SELECT c_custkey, CAST(seg = 'AUTOMOBILE' AS INTEGER) AS seg__automobile, CAST(seg = 'FURNITURE' AS INTEGER) AS seg__furniture, CAST(seg = 'HOUSEHOLD' AS INTEGER) AS seg__household,
  CAST(seg = 'MACHINERY' AS INTEGER) AS seg__machinery, CASE WHEN seg IS NOT NULL THEN CAST(seg = 'BUILDING' AS INTEGER) END AS seg__unknown FROM {SEGMENT_SQL}"""
)
def one_hot_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_hot(spark, sf_dir, "tree")


@query(
    f"""SELECT c_custkey, coalesce(CAST(seg = 'AUTOMOBILE' AS INTEGER), 0) AS seg__automobile, coalesce(CAST(seg = 'FURNITURE' AS INTEGER), 0) AS seg__furniture,
  coalesce(CAST(seg = 'HOUSEHOLD' AS INTEGER), 0) AS seg__household, coalesce(CAST(seg = 'MACHINERY' AS INTEGER), 0) AS seg__machinery,
  CAST(seg IS NULL AS INTEGER) AS seg__missing, coalesce(CAST(seg = 'BUILDING' AS INTEGER), 0) AS seg__unseen FROM {SEGMENT_SQL}"""
)
def one_hot_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_hot(spark, sf_dir, "mlp").withColumn("seg__unseen", F.coalesce("seg__unseen", F.lit(0)))


@query(
    """WITH k AS (SELECT quantile_cont(l_extendedprice, 0.5) AS knot FROM lineitem), h AS (SELECT l_orderkey, l_linenumber, greatest(l_extendedprice - knot, 0) AS h FROM lineitem, k)
SELECT l_orderkey, l_linenumber, round((h - (SELECT avg(h) FROM h)) / (SELECT stddev_pop(h) FROM h), 6) AS price_hinge FROM h"""
)
def hinge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    (term,) = cleaning.hinge_terms(li, "l_extendedprice", [0.5]).values()
    return rounded(li.select("l_orderkey", "l_linenumber", term.alias("price_hinge")))


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * l_discount AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round((x - (SELECT avg(x) FROM x)) / (SELECT stddev_pop(x) FROM x), 6) AS product FROM x"""
)
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    (term,) = cleaning.interactions(li, [("l_quantity", "l_discount")]).values()
    return rounded(li.select("l_orderkey", "l_linenumber", term.alias("product")))


CODE_SQL = "CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity > 40 THEN 555 WHEN l_quantity > 38 THEN 300 ELSE 100 * (1 + l_linenumber % 3) + l_quantity END"


@query(
    f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN c IN (555, 300) THEN 0 WHEN c BETWEEN 101 AND 199 THEN c - 100 WHEN c BETWEEN 201 AND 299 THEN (c - 200) / 7 ELSE (c - 300) / 30 END, 6) AS rate
FROM (SELECT l_orderkey, l_linenumber, {CODE_SQL} AS c FROM lineitem)"""
)
def frequency_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(CODE_SQL).alias("c"))
    return rounded(li.select("l_orderkey", "l_linenumber", cleaning.daily_rate(F.col("c").cast("double")).alias("rate")))


@query(
    """SELECT o_orderkey, CASE WHEN answered > 0 THEN said END AS yes, answered FROM (
  SELECT o_orderkey, CAST(o_orderkey % 4 IN (1, 2) AS INTEGER) + CAST(o_custkey % 4 IN (1, 2) AS INTEGER) AS answered, CAST(o_orderkey % 4 = 1 AS INTEGER) + CAST(o_custkey % 4 = 1 AS INTEGER) AS said FROM orders)"""
)
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("a"), (F.col("o_custkey") % 4).alias("b"))
    yes, answered = cleaning.group_counts(["a", "b"])
    return o.select("o_orderkey", yes.alias("yes"), answered.alias("answered"))


# -- profiles --

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, l_returnflag, count(*) AS rows, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max FROM (SELECT l_returnflag, {e} AS v FROM lineitem) GROUP BY l_returnflag"
        for c, e in (("l_quantity", "CASE WHEN l_quantity NOT IN (7, 9) THEN l_quantity END"), ("l_extendedprice", "l_extendedprice"), ("l_discount", "l_discount"))
    )
)
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("l_quantity", cleaning.cleaned(F.col("l_quantity"), QUANTITY))
    return rounded(profile.moments(li, NUMERIC, ["l_returnflag"]))


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS feature, round((avg({c}) FILTER (l_returnflag = 'R') - avg({c}) FILTER (l_returnflag <> 'R'))
  / sqrt((var_pop({c}) FILTER (l_returnflag = 'R') + var_pop({c}) FILTER (l_returnflag <> 'R')) / 2), 6) AS smd FROM lineitem"""
        for c in NUMERIC
    )
)
def smd_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.standardised_difference(table(spark, sf_dir, "lineitem"), NUMERIC, (F.col("l_returnflag") == "R").cast("int")))


@query(
    """WITH x AS (SELECT o_orderpriority AS value, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT value, count(*) AS n, sum(y) AS positives, round(avg(y), 6) AS rate, round(avg(y) / (SELECT avg(y) FROM x), 6) AS lift FROM x GROUP BY value HAVING count(*) >= greatest(100, 0.001 * (SELECT count(*) FROM x))"""
)
def value_target_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.select("o_orderpriority", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(profile.target_rates(x, F.col("o_orderpriority"), F.col("y")))


@query(
    """WITH e AS (SELECT event_type AS v, CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) < ((SELECT max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) FROM events) + 1) / 2 AS early FROM events),
a AS (SELECT v, count(*) AS n FROM e WHERE early GROUP BY 1), b AS (SELECT v, count(*) AS n FROM e WHERE NOT early GROUP BY 1)
SELECT round(0.5 * sum(abs(coalesce(a.n, 0) / (SELECT CAST(sum(n) AS DOUBLE) FROM a) - coalesce(b.n, 0) / (SELECT CAST(sum(n) AS DOUBLE) FROM b))), 6) AS total_variation FROM a FULL JOIN b ON a.v = b.v"""
)
def tvd_two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the days against the second."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("value"), F.to_date("ts").alias("day"))
    first, last = e.agg(F.min("day"), F.max("day")).first()
    early = F.datediff("day", F.lit(first)) < ((last - first).days + 1) / 2
    a, b = (e.where(side).groupBy("value").agg(F.count("*").alias("n")) for side in (early, ~early))
    return rounded(profile.total_variation(a, b))


EDGES_SQL = "(SELECT list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM events)"


@query(f"SELECT CAST(len(list_filter(e, lambda x: x <= value)) AS INTEGER) AS bin, count(*) AS n FROM events, {EDGES_SQL} GROUP BY 1")
def decile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return profile.histogram(e, "value", profile.quantile_edges(e, "value", 10))


@query("SELECT CAST(CAST(p_size AS BIGINT) AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY p_size")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "part"), "p_size")


@query("SELECT CASE WHEN p_size <= (SELECT DISTINCT p_size FROM part ORDER BY 1 LIMIT 1 OFFSET 9) THEN CAST(p_size AS VARCHAR) ELSE '<OTHER>' END AS value, count(*) AS n FROM part GROUP BY 1")
def bounded_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.bounded_value_counts(table(spark, sf_dir, "part"), "p_size", 10)


@query(
    """SELECT sha256('v' || text) AS digest, count(*) AS n, bit_or(CASE WHEN lang = 'en' THEN 2 ELSE 1 END) AS labels FROM documents GROUP BY text HAVING count(*) > 1"""
)
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_rows(table(spark, sf_dir, "documents"), ["text"], (F.col("lang") == "en").cast("int"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 1)")
def row_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return profile.row_overlap(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["text"]).select("doc_id")


@query("SELECT 'copy' AS left, 'l_tax' AS right")
def duplicate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(*NUMERIC, "l_tax", F.col("l_tax").alias("copy"), (F.col("l_discount") * 2).alias("other"))
    return profile.duplicate_columns(li, [*NUMERIC, "l_tax", "copy", "other"])


@query(
    """SELECT n_name, r_name, coalesce(suppliers, 0) AS suppliers, round(balance, 6) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers, avg(s_acctbal) AS balance FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey"""
)
def registry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.avg("s_acctbal").alias("balance"))
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(named.join(stats, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", "r_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), "balance"))


# -- sampling --


def _ordered(seed: str) -> str:
    return f"row_number() OVER (PARTITION BY quality ORDER BY md5('{seed}|' || doc_id), doc_id) AS place, count(*) OVER (PARTITION BY quality) AS size"


@query("SELECT doc_id, quality, CAST(ntile(3) OVER (PARTITION BY quality ORDER BY md5('folds|' || doc_id), doc_id) - 1 AS INTEGER) AS fold FROM labels")
def strat_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_folds(table(spark, sf_dir, "labels"), "quality", "doc_id", 3, "folds").select("doc_id", "quality", "fold")


@query(f"SELECT doc_id, place <= round_even(size * 0.2, 0) AS validation FROM (SELECT doc_id, {_ordered('split')} FROM labels)")
def strat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(table(spark, sf_dir, "labels"), "quality", "doc_id", 0.2, "split").select("doc_id", "validation")


@query(f"SELECT doc_id, place <= greatest(1, least(size - 1, round_even(size * 0.001, 0))) AS validation FROM (SELECT doc_id, {_ordered('hold')} FROM labels)")
def strat_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(table(spark, sf_dir, "labels"), "quality", "doc_id", 0.001, "hold", True).select("doc_id", "validation")


TOXIC_SQL = "(SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('under|' || doc_id), doc_id) AS place, sum(toxic) OVER () AS positives FROM labels)"


@query(f"SELECT doc_id, toxic FROM {TOXIC_SQL} WHERE toxic = 1 OR place <= 3 * positives")
def undersample_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.undersample(table(spark, sf_dir, "labels"), "toxic", "doc_id", 3, "under").select("doc_id", "toxic")


@query(
    f"""WITH r AS (SELECT doc_id, toxic, positives FROM {TOXIC_SQL} WHERE toxic = 1 OR place <= (3 * positives) // 2),
h AS (SELECT l.doc_id, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.toxic = 0 AND l.doc_id NOT IN (SELECT doc_id FROM r) ORDER BY n_chars DESC, l.doc_id LIMIT (SELECT CAST(3 * sum(toxic) - (3 * sum(toxic)) // 2 AS BIGINT) FROM labels))
SELECT doc_id, toxic FROM r UNION ALL SELECT doc_id, toxic FROM h"""
)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return sampling.undersample_hard(rows, "toxic", "doc_id", "n_chars", 3, "under").select("doc_id", "toxic")


# -- linear models --


def _regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.lit(1.0).alias("one"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100000).alias("y"))


SUMS_SQL = "(SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem))"


@query(f"SELECT round(n, 4) AS g00, round(sx, 4) AS g01, round(sxx, 4) AS g11, round(sy, 4) AS b0, round(sxy, 4) AS b1 FROM {SUMS_SQL}")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, b, _, _ = linear.gram(_regression(spark, sf_dir), "y", ["one", "x"])
    values = [float(round(v, 4)) for v in (g[0, 0], g[0, 1], g[1, 1], b[0], b[1])]
    return spark.createDataFrame([tuple(values)], "g00 double, g01 double, g11 double, b0 double, b1 double")


def _weights(spark: SparkSession, w, loss: float) -> DataFrame:
    return spark.createDataFrame([(float(round(w[0], 6)), float(round(w[1], 6)), float(round(loss, 6)))], "w0 double, w1 double, loss double")


def _solved(a: str) -> str:
    return f"""WITH s AS (SELECT * FROM {SUMS_SQL}), p AS (SELECT *, n + {a} AS a, sxx + {a} AS d FROM s),
w AS (SELECT *, (d * sy - sx * sxy) / (a * d - sx * sx) AS w0, (a * sxy - sx * sy) / (a * d - sx * sx) AS w1 FROM p)
SELECT round(w0, 6) AS w0, round(w1, 6) AS w1, round((syy - 2 * (w0 * sy + w1 * sxy) + w0 * w0 * n + 2 * w0 * w1 * sx + w1 * w1 * sxx) / (2 * n), 6) AS loss FROM w"""


@query(_solved("0"))
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, *linear.least_squares(_regression(spark, sf_dir), "y", ["one", "x"]))


@query(_solved("2 * n * 0.01"))
def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, *linear.ridge(_regression(spark, sf_dir), "y", ["one", "x"], 0.01))


@query(
    f"""WITH RECURSIVE s AS (SELECT * FROM {SUMS_SQL}), r(i, w0, w1) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL SELECT i + 1, w0 - 0.5 * (n * w0 + sx * w1 - sy) / n, w1 - 0.5 * (sx * w0 + sxx * w1 - sxy) / n FROM r, s WHERE i < 50)
SELECT round(w0, 6) AS w0, round(w1, 6) AS w1, round((syy - 2 * (w0 * sy + w1 * sxy) + w0 * w0 * n + 2 * w0 * w1 * sx + w1 * w1 * sxx) / (2 * n), 6) AS loss FROM r, s WHERE i = 50"""
)
def gd_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, *linear.gradient_descent(_regression(spark, sf_dir), "y", ["one", "x"], [0.0, 0.0], 50, 0.5))


@query(
    """WITH RECURSIVE x AS (SELECT l_quantity / 50 AS x, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
d AS (SELECT x, sum(y) AS y, count(*) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM x) AS total FROM x GROUP BY x),
l AS (SELECT list({'x': x, 'y': y, 'n': n}) AS rows, any_value(total) AS total FROM d), r(i, w0, w1) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL SELECT i + 1, w0 - 1.0 * list_sum(list_transform(rows, lambda e: e.n / (1 + exp(-(w0 + w1 * e.x))) - e.y)) / total,
    w1 - 1.0 * list_sum(list_transform(rows, lambda e: e.x * (e.n / (1 + exp(-(w0 + w1 * e.x))) - e.y))) / total FROM r, l WHERE i < 10)
SELECT round(w0, 6) AS w0, round(w1, 6) AS w1, round(list_sum(list_transform(rows, lambda e: e.n * ln(1 + exp(w0 + w1 * e.x)) - e.y * (w0 + w1 * e.x))) / total, 6) AS loss FROM r, l WHERE i = 10"""
)
def logistic_gd(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.lit(1.0).alias("one"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    return _weights(spark, *linear.logistic(li, "y", ["one", "x"], [0.0, 0.0], 10, 1.0))


@query()
def platt_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scored_events(spark, sf_dir)
    state = linear.platt(e, "y", "p", steps=20)
    return rounded(e.select("event_id", linear.calibrated(F.col("p"), state).alias("probability")))


# -- boosting --


def _boosting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        cleaning.cleaned(F.col("l_quantity"), QUANTITY).alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


@query(
    """WITH x AS (SELECT CASE WHEN l_quantity IN (7, 9) THEN NULL ELSE l_quantity END AS v, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
e AS (SELECT list_distinct(quantile_cont(v, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS e FROM x)
SELECT CASE WHEN v IS NOT NULL THEN CAST(len(list_filter(e, lambda t: t <= v)) AS INTEGER) END AS bin, count(*) AS n, round(sum((SELECT avg(y) FROM x) - y), 6) AS gradient,
  round(count(*) * (SELECT avg(y) * (1 - avg(y)) FROM x), 6) AS hessian FROM x, e GROUP BY 1"""
)
def newton_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boosting_rows(spark, sf_dir)
    share = rows.agg(F.avg("y")).first()[0]
    edges = profile.quantile_edges(rows, "quantity", 8)
    hist = rows.groupBy(profile.bin_of(F.col("quantity"), edges).alias("bin"))
    return rounded(hist.agg(F.count("*").alias("n"), F.sum(F.lit(share) - F.col("y")).alias("gradient"), (F.count("*") * F.lit(share * (1 - share))).alias("hessian")))


@query()
def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boosting_rows(spark, sf_dir)
    settings = boosting.Settings(trees=5, depth=3, bins=32, min_leaf=50, seed=29)
    model = boosting.Booster(["quantity", "discount", "tax"], settings).fit(rows, "y")
    return rounded(model.decision(rows, "row_id", [1, 5]))


@query("SELECT list_sort(list_intersect(a, b)) AS common, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS jaccard FROM (SELECT list(DISTINCT n_name) FILTER (n_nationkey % 2 = 0) AS a, list(DISTINCT n_name) FILTER (n_nationkey % 3 = 0) AS b FROM nation)")
def jaccard_feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").agg(*[F.collect_set(F.when(F.col("n_nationkey") % k == 0, F.col("n_name"))).alias(c) for k, c in ((2, "a"), (3, "b"))])
    return rounded(n.select(F.array_sort(F.array_intersect("a", "b")).alias("common"), evaluation.jaccard(F.col("a"), F.col("b")).alias("jaccard")))


@query("SELECT band, count(*) AS parts FROM (SELECT CASE WHEN p_size <= 2 THEN '1-2' WHEN p_size <= 5 THEN '3-5' WHEN p_size <= 10 THEN '6-10' WHEN p_size <= 50 THEN '11-50' ELSE '51-256' END AS band FROM part) GROUP BY band")
def cardinality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(profile.cardinality_band(F.col("p_size")).alias("band")).agg(F.count("*").alias("parts"))


def labels_from_scores(score: Column, threshold: float) -> Column:
    """Equal to the threshold is positive."""
    return (score >= threshold).cast("int")

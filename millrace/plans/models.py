"""Queries of fitted models, their evaluation and their samples, with their SQL.

The SQL of a boosted model is written out tree by tree and level by level: a
count of each bin, a running sum over the bins, the best gain of each node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import scratch
from millrace.operators import boosting, evaluation, linear, preprocessing, sampling, validation
from millrace.plans import experiments, runners
from millrace.plans.catalogue import EVENTS_SQL, METRICS_SQL, query, rounded, scored_events, table
from millrace.plans.studies import COLUMNS, ENTRIES, RAW_SQL, survey
from millrace.plans.files import PAGE
from millrace.sources import tables

# -- boosting --

PAIR = ["measure", "answer"]
EIGHTHS = ", ".join(str(k / 8) for k in range(1, 8))


def boosted_sql(
    trees: int, depth: int, rate: float = 0.3, least: int = 20, l2: float = 1.0, last_boundary: bool = True, categories: bool = False, leaves: int | None = None
) -> str:
    """CTEs ``s0`` to ``s<trees>`` (event_id, score) and ``best<t>_<d>`` (the splits) over ``measure`` and ``answer``.

    ``categories``: ``answer`` is split by sets of its values. ``leaves``: of the
    nodes of the last level only the best is split, as best-first growth with
    one leaf less than a full tree does.
    """
    sets = "list_sort(list_distinct(list(CAST(answer AS FLOAT))))" if categories else f"list_sort(list_distinct(list_transform(quantile_cont(answer, [{EIGHTHS}]), lambda x: CAST(x AS FLOAT))))"
    first = "<" if categories else "<="
    parts = [
        f"raw AS (SELECT event_id, y, measure, answer FROM {RAW_SQL})",
        f"e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(measure, [{EIGHTHS}]), lambda x: CAST(x AS FLOAT)))) AS e1, {sets} AS e2 FROM raw)",
        f"""x AS (SELECT event_id, y, CASE WHEN measure IS NULL THEN 255 ELSE len(list_filter(e1, lambda t: t <= CAST(measure AS FLOAT))) END AS b1,
  CASE WHEN answer IS NULL THEN 255 ELSE len(list_filter(e2, lambda t: t {first} CAST(answer AS FLOAT))) END AS b2 FROM raw, e)""",
        f"bins AS (SELECT unnest([1, 2]) AS f, unnest([len(e1) + 1, len(e2) + {0 if categories else 1}]) AS bins FROM e)",
        "s0 AS (SELECT x.*, ln(share / (1 - share)) AS score FROM x, (SELECT avg(y) AS share FROM x))",
    ]
    for t in range(1, trees + 1):
        parts.append(f"n{t}_0 AS (SELECT *, p - y AS g, greatest(p * (1 - p), 1e-12) AS h, 1 AS node FROM (SELECT *, 1 / (1 + exp(-score)) AS p FROM s{t - 1}))")
        for d in range(depth):
            at = f"{t}_{d}"
            order = "CASE WHEN f = 2 AND bin < 255 THEN row_number() OVER (PARTITION BY node, f, bin < 255 ORDER BY g / h, bin) - 1 ELSE bin END" if categories else "bin"
            full = "(f = 2 OR lost.c > 0)" if categories else "lost.c > 0"
            bins = "CASE WHEN k.f = 2 THEN (SELECT count(*) FROM u{0} w WHERE w.node = tot.node AND w.f = 2 AND w.bin < 255) ELSE k.bins END".format(at) if categories else "k.bins"
            last = f"CASE WHEN {full.replace('f = 2', 'k.f = 2')} THEN {bins} ELSE greatest({bins} - 1, 1) END" if last_boundary or categories else "greatest(k.bins - 1, 1)"
            only = f" QUALIFY row_number() OVER (ORDER BY gain DESC, node) <= {leaves - 2 ** d}" if leaves and d == depth - 1 else ""
            parts += [
                f"""u{at} AS (SELECT *, {order} AS place FROM (SELECT node, f, bin, count(*) AS c, sum(g) AS g, sum(h) AS h
  FROM (SELECT node, 1 AS f, b1 AS bin, g, h FROM n{at} UNION ALL SELECT node, 2, b2, g, h FROM n{at}) WHERE node >= {2**d} GROUP BY ALL))""",
                f"tot{at} AS (SELECT node, count(*) AS c, sum(g) AS g, sum(h) AS h FROM n{at} WHERE node >= {2**d} GROUP BY node)",
                f"""left{at} AS (SELECT tot.node, k.f, i, side, any_value(tot.c) AS c, any_value(tot.g) AS g, any_value(tot.h) AS h,
  coalesce(sum(u.c), 0) + side * coalesce(any_value(lost.c), 0) AS lc, coalesce(sum(u.g), 0) + side * coalesce(any_value(lost.g), 0) AS lg, coalesce(sum(u.h), 0) + side * coalesce(any_value(lost.h), 0) AS lh,
  any_value({last}) AS stop
  FROM tot{at} tot CROSS JOIN bins k CROSS JOIN (SELECT unnest(range(0, 64)) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS side)
  LEFT JOIN u{at} lost ON lost.node = tot.node AND lost.f = k.f AND lost.bin = 255
  LEFT JOIN u{at} u ON u.node = tot.node AND u.f = k.f AND u.bin < 255 AND u.place <= i GROUP BY tot.node, k.f, i, side)""",
                f"""gain{at} AS (SELECT node, f, i, side, 0.5 * (lg * lg / (lh + {l2}) + (g - lg) * (g - lg) / (h - lh + {l2}) - g * g / (h + {l2})) AS gain
  FROM left{at} WHERE i < stop AND lc >= {least} AND c - lc >= {least} AND c >= {2 * least})""",
                f"first{at} AS (SELECT * FROM gain{at} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, i, side) = 1)",
                f"best{at} AS (SELECT * FROM first{at}{only})",
                f"""n{t}_{d + 1} AS (SELECT n.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN n.node WHEN CASE WHEN u.bin = 255 THEN b.side = 1 ELSE u.place <= b.i END THEN 2 * n.node ELSE 2 * n.node + 1 END AS node
  FROM n{at} n LEFT JOIN best{at} b ON n.node = b.node LEFT JOIN u{at} u ON u.node = b.node AND u.f = b.f AND u.bin = CASE b.f WHEN 1 THEN n.b1 ELSE n.b2 END)""",
            ]
        parts.append(f"v{t} AS (SELECT node, -sum(g) / (sum(h) + {l2}) AS v FROM n{t}_{depth} GROUP BY node)")
        parts.append(f"s{t} AS (SELECT event_id, y, b1, b2, score + {rate} * v AS score FROM n{t}_{depth} JOIN v{t} USING (node))")
    return "WITH " + ",\n".join(parts) + "\n"


def _settings(**own) -> boosting.Settings:
    return boosting.Settings(**({"trees": 2, "depth": 2, "rate": 0.3, "bins": 8, "min_leaf": 20, "seed": 5} | own))


def _fitted(spark: SparkSession, sf_dir: str, **own) -> tuple[boosting.Booster, DataFrame]:
    s = survey(spark, sf_dir).select("event_id", "y", *PAIR)
    return boosting.Booster(PAIR, _settings(**own)).fit(s, "y", key="event_id"), s


@query(boosted_sql(2, 2) + "SELECT event_id, CAST(1 AS INTEGER) AS stage, round(score, 6) AS score FROM s1 UNION ALL SELECT event_id, 2, round(score, 6) FROM s2")
def boosted_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees grown level by level; scores after one and after two of them."""
    model, s = _fitted(spark, sf_dir)
    return rounded(model.decision(s, "event_id", [1, 2]))


@query(boosted_sql(2, 2) + "SELECT event_id, round(score, 6) AS score FROM s2")
def boosted_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree, then one more on the saved and reread model."""
    model, s = _fitted(spark, sf_dir, trees=1)
    path = scratch(spark, "model")
    model.save(spark, path)
    again = boosting.Booster.load(spark, path).continue_fit(s, "y", 1, key="event_id")
    return rounded(again.decision(s, "event_id").drop("stage"))


@query(boosted_sql(1, 3) + "SELECT event_id, round(1 / (1 + exp(-score)), 6) AS p FROM s1")
def boosted_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree grown depth first."""
    model, s = _fitted(spark, sf_dir, trees=1, depth=3, strategy="recursive")
    return rounded(model.probabilities(s, "event_id").drop("stage"))


@query(boosted_sql(2, 1, last_boundary=False) + "SELECT event_id, round(score, 6) AS score FROM s2")
def boosted_without_last_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search that leaves out the last boundary where values are missing."""
    model, s = _fitted(spark, sf_dir, depth=1, missing_boundary=False)
    return rounded(model.decision(s, "event_id").drop("stage"))


@query(boosted_sql(1, 2, categories=True) + "SELECT event_id, round(score, 6) AS score FROM s1")
def boosted_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by sets of answers, ordered by gradient over hessian."""
    model, s = _fitted(spark, sf_dir, trees=1, strategy="recursive", categorical=("answer",))
    return rounded(model.decision(s, "event_id").drop("stage"))


@query(boosted_sql(1, 2, leaves=3) + "SELECT event_id, round(score, 6) AS score FROM s1")
def boosted_best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three leaves: of the root's children the one with the greater gain is split."""
    model, s = _fitted(spark, sf_dir, trees=1, strategy="leafwise", max_leaves=3)
    return rounded(model.decision(s, "event_id").drop("stage"))


_SPLITS = " UNION ALL ".join(f"SELECT f, {d} AS depth FROM best{t}_{d}" for t in (1, 2) for d in (0, 1, 2))


@query(boosted_sql(2, 3) + f"SELECT CASE f WHEN 1 THEN 'measure' ELSE 'answer' END AS feature, count(*) AS splits, count(*) FILTER (depth <= 1) AS shallow FROM ({_SPLITS}) GROUP BY f")
def split_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _fitted(spark, sf_dir, depth=3)
    rows = [(c, n, shallow) for c, (n, shallow) in model.split_usage().items() if n]
    return spark.createDataFrame(rows, "feature string, splits long, shallow long")


@query(boosted_sql(2, 2) + 'SELECT event_id, CAST(CASE WHEN 1 / (1 + exp(-score)) >= 0.2 THEN 1 ELSE -1 END AS INTEGER) AS "Prediction" FROM s2')
def train_and_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full fit on all rows and signed predictions."""

    def fit(train: DataFrame):
        model = boosting.Booster(PAIR, _settings()).fit(train, "y", key="event_id")
        return lambda held: model.probabilities(held, "event_id")

    s = survey(spark, sf_dir).select("event_id", "y", *PAIR)
    return runners.train_and_predict(s, s.drop("y"), fit, "event_id", 0.2)


# -- linear models --

_ROWS = "list({'x': x, 'y': y, 'n': n}) AS rows, sum(n) AS total"


def logistic_sql(rows: str, steps: int, rate: float, penalty: float = 0.0) -> str:
    """CTEs for ``steps`` of descent over ``rows`` (x, y), ending in ``r`` (i, w0, w1) and ``l`` (rows, total)."""
    slope = "1 / (1 + exp(-(w0 + w1 * e.x)))"
    return f"""WITH RECURSIVE o AS ({rows}), d AS (SELECT x, sum(y) AS y, CAST(count(*) AS DOUBLE) AS n FROM o GROUP BY x), l AS (SELECT {_ROWS} FROM d),
r(i, w0, w1) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
  SELECT i + 1, w0 - {rate} * (list_sum(list_transform(rows, lambda e: e.n * {slope} - e.y)) / total + 2 * {penalty} * w0),
    w1 - {rate} * (list_sum(list_transform(rows, lambda e: e.x * (e.n * {slope} - e.y))) / total + 2 * {penalty} * w1) FROM r, l WHERE i < {steps})
"""


_Z = f"SELECT (p - m) / s AS x, y FROM {EVENTS_SQL} AS e, (SELECT avg(p) AS m, stddev_pop(p) AS s FROM {EVENTS_SQL})"


@query(logistic_sql(_Z, 20, 1.0) + f"SELECT event_id, round(1 / (1 + exp(-(w0 + w1 * (p - m) / s))), 6) AS probability FROM {EVENTS_SQL} AS e, r, (SELECT avg(p) AS m, stddev_pop(p) AS s FROM {EVENTS_SQL}) WHERE i = 20")
def platt_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scored_events(spark, sf_dir)
    state = linear.platt(e, "y", "p", steps=20)
    return rounded(e.select("event_id", linear.calibrated(F.col("p"), state).alias("probability")))


_LINES = "SELECT l_quantity / 50 AS x, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.lit(1.0).alias("one"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_returnflag") == "R").cast("double").alias("y"))


@query(
    logistic_sql(_LINES, 8, 1.0, 0.05)
    + "SELECT round(w0, 6) AS w0, round(w1, 6) AS w1, round(list_sum(list_transform(rows, lambda e: e.n * ln(1 + exp(w0 + w1 * e.x)) - e.y * (w0 + w1 * e.x))) / total, 6) AS loss FROM r, l WHERE i = 8"
)
def logistic_penalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weights are penalised; the loss leaves the penalty out."""
    w, loss = linear.logistic(_lines(spark, sf_dir), "y", ["one", "x"], [0.0, 0.0], 8, 1.0, 0.05)
    return rounded(spark.createDataFrame([(float(w[0]), float(w[1]), loss)], "w0 double, w1 double, loss double"))


@query(
    f"""WITH o AS ({_LINES}), g AS (SELECT avg(1 / (1 + exp(-(0.2 - 0.5 * x))) - y) + 2 * 0.05 * 0.2 AS g0, avg(x * (1 / (1 + exp(-(0.2 - 0.5 * x))) - y)) - 2 * 0.05 * 0.5 AS g1 FROM o)
SELECT round(sqrt(g0 * g0 + g1 * g1), 6) AS norm FROM g"""
)
def gradient_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    norm = linear.gradient_norm(_lines(spark, sf_dir), "y", ["one", "x"], np.array([0.2, -0.5]), 0.05)
    return rounded(spark.createDataFrame([(norm,)], "norm double"))


@query(
    f"""WITH o AS ({_LINES}), m AS (SELECT count(*) + 2 * count(*) * 0.01 AS a, sum(x) AS b, sum(x * x) + 2 * count(*) * 0.01 AS d, sum(2 * y - 1) AS u, sum(x * (2 * y - 1)) AS v FROM o),
w AS (SELECT (u * d - b * v) / (a * d - b * b) AS w0, (a * v - b * u) / (a * d - b * b) AS w1 FROM m)
SELECT round(w0, 6) AS w0, round(w1, 6) AS w1, (SELECT count(*) FROM o, w WHERE w0 + w1 * x >= -0.5) AS positive FROM w"""
)
def ridge_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on labels -1 and 1, and how many rows score at least -0.5."""
    rows = _lines(spark, sf_dir).withColumn("signed", 2 * F.col("y") - 1)
    w, _ = linear.ridge(rows, "signed", ["one", "x"], 0.01)
    positive = rows.where(F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("x") >= -0.5).count()
    return rounded(spark.createDataFrame([(float(w[0]), float(w[1]), positive)], "w0 double, w1 double, positive long"))


# -- comparison of studies --

_CELLS = """count(*) FILTER (y = 1 AND before = 0 AND after = 1) AS recovered_fn, count(*) FILTER (y = 1 AND before = 1 AND after = 0) AS lost_tp,
  count(*) FILTER (y = 0 AND before = 0 AND after = 1) AS added_fp, count(*) FILTER (y = 0 AND before = 1 AND after = 0) AS removed_fp"""
_F1 = "2.0 * count(*) FILTER (y = 1 AND {0} = 1) / (count(*) FILTER ({0} = 1) + count(*) FILTER (y = 1))"


@query(
    f"""SELECT round({_F1.format('after')} - {_F1.format('before')}, 6) AS difference, {_CELLS}
FROM (SELECT y, CAST(p >= 0.5 AS INTEGER) AS before, CAST(p >= 0.6 AS INTEGER) AS after FROM {EVENTS_SQL})"""
)
def study_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thresholds on the same scores as two studies; without the drawn interval."""
    e = scored_events(spark, sf_dir)
    low, high = (e.select("event_id", "y", (F.col("p") >= t).cast("int").alias("predicted")) for t in (0.5, 0.6))
    return rounded(evaluation.compare_studies(low, high, "event_id", "y", "predicted").drop("low", "high"))


@query(f"SELECT event_id, y AS truth, CAST(p >= 0.5 AS INTEGER) AS before, CAST(p >= 0.6 AS INTEGER) AS after FROM {EVENTS_SQL}")
def paired_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scored_events(spark, sf_dir)
    return evaluation.paired(*[e.select("event_id", "y", (F.col("p") >= t).cast("int").alias("predicted")) for t in (0.5, 0.6)], "event_id", "y", "predicted")


@query(
    f"""WITH d AS (SELECT user_id % 7 AS candidate, event_id % 3 AS fold, avg(p) - (SELECT avg(p) FROM {EVENTS_SQL}) AS delta FROM {EVENTS_SQL} GROUP BY ALL)
SELECT candidate, round(sum(delta), 6) AS pooled, count(*) FILTER (delta > 0) AS better FROM d GROUP BY candidate HAVING sum(delta) > 0 AND count(*) FILTER (delta > 0) >= 2"""
)
def promoted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A positive pooled change, and at least two of three folds better."""
    e = scored_events(spark, sf_dir)
    mean = e.agg(F.avg("p")).first()[0]
    deltas = e.groupBy((F.col("user_id") % 7).alias("candidate"), (F.col("event_id") % 3).alias("fold")).agg((F.avg("p") - mean).alias("delta"))
    return rounded(evaluation.promoted(deltas))


# -- validation --


def _plain(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.lit(1).alias("stage"), "p")


def _shifted(train: DataFrame):
    """A model that learns one number: the share of positives, added to the score."""
    share = train.agg(F.avg("y")).first()[0]
    return lambda held: held.select("event_id", F.lit(1).alias("stage"), F.least(F.lit(1.0), F.col("p") + share).alias("p"))


def _folds(rows: str, seed: int, folds: int) -> str:
    return f"SELECT *, CAST(ntile({folds}) OVER (PARTITION BY y ORDER BY md5('{seed}|' || event_id), event_id) - 1 AS INTEGER) AS fold FROM {rows}"


_INNER, _OUTER = "(SELECT avg(y) FROM {i} z WHERE z.fold <> {i}.fold)", "(SELECT avg(y) FROM {o} WHERE fold <> {k})"


def _nested_parts(name: str = "", inner: str = _INNER, outer: str = _OUTER) -> list[str]:
    """CTEs of three outer and two inner folds; the last, ``<name>j``, has event_id, y, k, p, t.

    ``inner`` and ``outer`` are what the model of a fold adds to the score.
    """
    o = f"{name}o"
    parts = [f"{o} AS ({_folds(EVENTS_SQL, 4, 3)})"]
    for k in range(3):
        own = {c: f"{name}{c}{k}" for c in "igctj"}
        rows = f"(SELECT event_id, y, p FROM {o} WHERE fold <> {k})"
        parts.append(f"{own['i']} AS ({_folds(rows, 5 + k, 2)})")
        parts.append(f"{own['g']} AS (SELECT y, least(1, p + {inner.format(i=own['i'])}) AS p FROM {own['i']})")
        parts.append(
            f"{own['c']} AS (SELECT p AS t, sum(sum(y)) OVER w AS tp, sum(count(*)) OVER w AS predicted, (SELECT sum(y) FROM {own['g']}) AS positives, (SELECT count(*) FROM {own['g']}) AS total FROM {own['g']} GROUP BY p WINDOW w AS (ORDER BY p DESC))"
        )
        parts.append(f"{own['t']} AS (SELECT t FROM {own['c']} ORDER BY round(2 * tp / (predicted + positives), 15) DESC, (tp + total - positives - (predicted - tp)) / total DESC, t DESC LIMIT 1)")
        parts.append(f"{own['j']} AS (SELECT event_id, y, {k} AS k, least(1, p + {outer.format(o=o, k=k)}) AS p, (SELECT t FROM {own['t']}) AS t FROM {o} WHERE fold = {k})")
    parts.append(f"{name}j AS (" + " UNION ALL ".join(f"SELECT * FROM {name}j{k}" for k in range(3)) + ")")
    return parts


def _nested_sql(tail: str) -> str:
    return "WITH " + ",\n".join(_nested_parts()) + "\n" + tail


_COUNTS = """count(*) FILTER (y = 1 AND p >= t) AS tp, count(*) FILTER (y = 0 AND p >= t) AS fp, count(*) FILTER (y = 0 AND p < t) AS tn, count(*) FILTER (y = 1 AND p < t) AS fn"""


@query(_nested_sql(f"SELECT CAST(fold AS INTEGER) AS fold, CAST(1 AS INTEGER) AS stage, round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM (SELECT *, {METRICS_SQL} FROM (SELECT k AS fold, any_value(t) AS threshold, {_COUNTS} FROM j GROUP BY k))"))
def nested_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from inner out-of-fold scores, judged on the outer folds."""
    by_fold, _ = validation.nested_evaluation(scored_events(spark, sf_dir), "y", "event_id", _shifted, 3, 2, 4)
    return rounded(by_fold.select("fold", "stage", "threshold", "f1", "accuracy"))


@query(
    _nested_sql(
        f"""SELECT 'shifted' AS model, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round((SELECT avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) FROM j), 6) AS log_loss,
  round((SELECT sum(y * tp / predicted) / sum(y) FROM (SELECT p, sum(y) AS y, sum(sum(y)) OVER w AS tp, sum(count(*)) OVER w AS predicted FROM j GROUP BY p WINDOW w AS (ORDER BY p DESC))), 6) AS average_precision
FROM (SELECT *, {METRICS_SQL} FROM (SELECT {_COUNTS} FROM j))"""
    )
)
def suite_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled metrics of a nested validation, logged to a ledger."""
    out = runners.run_suite(scored_events(spark, sf_dir), {"shifted": _shifted}, "y", "event_id", scratch(spark, "ledger"), 3, 2, 4)
    return rounded(out.select("model", "f1", "accuracy", "log_loss", "average_precision"))


@query(_nested_sql("SELECT CAST(1 AS INTEGER) AS stage, round(min(t), 6) AS minimum, round(max(t), 6) AS maximum, round(avg(t), 6) AS mean, round(stddev_pop(t), 6) AS std FROM (SELECT DISTINCT k, t FROM j)"))
def threshold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_fold, _ = validation.nested_evaluation(scored_events(spark, sf_dir), "y", "event_id", _shifted, 3, 2, 4)
    return rounded(validation.threshold_summary(by_fold))


@query(f"WITH o AS ({_folds(EVENTS_SQL, 9, 4)}) SELECT event_id, fold, CAST(1 AS INTEGER) AS stage, round(least(1, p + (SELECT avg(y) FROM o z WHERE z.fold <> o.fold)), 6) AS p FROM o")
def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row scored by the model that did not see it; kept as a checked artifact."""
    placed = sampling.stratified_folds(scored_events(spark, sf_dir), "y", "event_id", 4, 9)
    found = validation.out_of_fold(placed, "event_id", "fold", 4, _shifted)
    return rounded(tables.save_out_of_fold(found, placed, "event_id", scratch(spark, "out-of-fold")))


@query("SELECT event_id FROM events WHERE event_id % 50 = 3 OR event_id % 70 = 9 OR event_id % 90 = 11")
def out_of_fold_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose score is missing, twice there, or above 1."""
    rows = scored_events(spark, sf_dir)
    id = F.col("event_id")
    found = _plain(rows.where(id % 50 != 3)).withColumn("p", F.when(id % 70 == 9, 1.5).otherwise(F.col("p")))
    twice = _plain(rows.where((id % 90 == 11) & (id % 50 != 3)))
    return validation.oof_faults(found.unionByName(twice), rows, "event_id").select("event_id")


@query(f"WITH o AS ({_folds(EVENTS_SQL, 2, 3)}) SELECT event_id FROM o WHERE fold = 2 AND event_id % 10 <> 0 UNION ALL SELECT event_id FROM o WHERE fold = 1 AND event_id % 10 = 1")
def fold_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are in no fold or in two."""
    placed = sampling.stratified_folds(scored_events(spark, sf_dir), "y", "event_id", 3, 2)
    id = F.col("event_id")
    folds = placed.where((F.col("fold") != 2) | (id % 10 == 0)).unionByName(placed.where((F.col("fold") == 1) & (id % 10 == 1)))
    return sampling.coverage_faults(placed, folds, "event_id").select("event_id")


@query(
    f"""WITH o AS ({_folds(EVENTS_SQL, 6, 4)}), h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('6-sample|' || event_id), event_id) AS place FROM o WHERE fold = 0),
q AS (SELECT least(60, count(*)) AS size, round_even(least(60, count(*)) * CAST(sum(y) AS DOUBLE) / count(*), 0) AS ones FROM h)
SELECT event_id, 'fit' AS role FROM o WHERE fold <> 0 UNION ALL SELECT event_id, CASE WHEN place <= CASE WHEN y = 1 THEN ones ELSE size - ones END THEN 'sample' ELSE 'holdout' END FROM h, q"""
)
def selector_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.selector_partition(scored_events(spark, sf_dir), "y", "event_id", 4, 60, 6).select("event_id", "role")


@query("SELECT event_id FROM events ORDER BY md5('8|' || event_id), event_id LIMIT 100")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform_sample(table(spark, sf_dir, "events").select("event_id"), "event_id", 100, 8)


def _permuted_sql(seed: int) -> str:
    """Scores of the rows with another row's value: by key, and by the seeded order."""
    order = f"SELECT p, row_number() OVER (ORDER BY md5('{seed}|' || event_id), event_id) AS place FROM {EVENTS_SQL}"
    return f"(SELECT a.event_id, a.y, b.p FROM (SELECT event_id, y, row_number() OVER (ORDER BY event_id) AS place FROM {EVENTS_SQL}) a JOIN ({order}) b USING (place))"


def _judged_sql(rows: str) -> str:
    return f"""(SELECT {_F1.format('CAST(p >= 0.5 AS INTEGER)')} AS f1, avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS loss FROM {rows}),
(SELECT sum(y * tp / predicted) / sum(y) AS ap FROM (SELECT sum(y) AS y, sum(sum(y)) OVER w AS tp, sum(count(*)) OVER w AS predicted FROM {rows} GROUP BY p WINDOW w AS (ORDER BY p DESC)))"""


@query(
    f"""WITH b AS (SELECT * FROM {_judged_sql(EVENTS_SQL)}), s AS (SELECT * FROM {_judged_sql(_permuted_sql(1))} UNION ALL SELECT * FROM {_judged_sql(_permuted_sql(2))})
SELECT 'value' AS feature, round(avg(b.f1 - s.f1), 6) AS f1_drop, round(stddev_samp(b.f1 - s.f1), 6) AS f1_drop_std, round(avg(b.ap - s.ap), 6) AS ap_drop, round(avg(s.loss - b.loss), 6) AS log_loss_rise FROM s, b"""
)
def permutation_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is lost when the only column is shuffled, over two seeds."""
    return rounded(validation.permutation_importance(scored_events(spark, sf_dir), {"value": ["p"]}, "y", "event_id", _plain, 0.5, [1, 2]))


@query(
    """WITH r AS (SELECT n_name AS feature, n_nationkey AS place, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey % 2 DESC, n_nationkey % 3 DESC, n_nationkey % 5 DESC, n_nationkey) AS rank FROM nation)
SELECT feature, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS kept FROM r WHERE rank <= 9"""
)
def ranked_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best columns by four measures and their place, kept in the order of the table."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    found = n.select(F.col("n_name").alias("feature"), F.col("n_regionkey").cast("double").alias("f1_drop"), (key % 2).alias("ap_drop"), (key % 3).alias("log_loss_rise"))
    usage = {r["n_name"]: (r["n_nationkey"] % 5, 0) for r in n.orderBy("n_nationkey").collect()}
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(validation.ranked_features(found, usage, 9))], "feature string, kept int")


# -- controlled studies --

_THIRD = "CAST(1 AS DOUBLE) / 3"
_FOLD_F1 = "SELECT k, 2.0 * count(*) FILTER (y = 1 AND p >= t) / (count(*) FILTER (p >= t) + count(*) FILTER (y = 1)) AS f1 FROM {0}j GROUP BY k"
_DELTAS = f"(SELECT b.f1 - a.f1 AS delta FROM ({_FOLD_F1.format('a')}) a JOIN ({_FOLD_F1.format('b')}) b USING (k))"


def _two_for_one(train: DataFrame):
    """Two negatives for each positive: the share that is learned is a third."""
    return experiments.undersampled(_shifted, "y", "event_id", 2, 3)(train)


@query(
    "WITH "
    + ",\n".join(_nested_parts("a") + _nested_parts("b", _THIRD, _THIRD))
    + f"\nSELECT 'fewer' AS candidate, round(sum(delta), 6) AS pooled, count(*) FILTER (delta > 0) AS better, sum(delta) > 0 AND count(*) FILTER (delta > 0) >= 2 AS promoted FROM {_DELTAS}"
)
def controlled_undersampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer negatives against all rows, on the same nested folds."""
    e, ledger = scored_events(spark, sf_dir), scratch(spark, "ledger")
    return rounded(experiments.controlled_study(e, _shifted, {"fewer": _two_for_one}, "y", "event_id", ledger, 3, 2, 4).drop("stage"))


@query(
    f"""WITH r AS (SELECT p AS t, sum(sum(y)) OVER w AS tp, sum(count(*)) OVER w AS predicted, (SELECT sum(y) FROM {EVENTS_SQL}) AS positives, (SELECT count(*) FROM {EVENTS_SQL}) AS total FROM {EVENTS_SQL} GROUP BY p WINDOW w AS (ORDER BY p DESC)),
b AS (SELECT t FROM r ORDER BY round(2 * tp / (predicted + positives), 15) DESC, (tp + total - positives - (predicted - tp)) / total DESC, t DESC LIMIT 1)
SELECT 'first' AS name, true AS done, round(t, 6) AS threshold FROM b UNION ALL SELECT 'second', true, round(t, 6) FROM b UNION ALL SELECT 'third', false, NULL"""
)
def calibration_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three candidates calibrated in two runs, the second of which goes on where the first ended."""
    e, ledger = scored_events(spark, sf_dir), scratch(spark, "ledger")
    candidates = dict.fromkeys(("first", "second", "third"), lambda train: _plain)
    for _ in range(2):
        status = experiments.calibrate_pending(e, candidates, "y", "event_id", ledger, 2, 1, 1)
    found = spark.read.parquet(ledger).select("name", F.get_json_object("outcome", "$.threshold").cast("double").alias("threshold"))
    return rounded(status.join(found, "name", "left"))


def _answers(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("CAST(CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey % 5 END AS DOUBLE) AS GENHLTH", "CAST(1 + n_nationkey % 2 AS DOUBLE) AS SMOKER")


@query(
    """SELECT name, semantic_type, count(*) AS train_rows, count(*) FILTER (v IS NULL) AS train_missing, round(avg(v), 6) AS train_mean, max(v) AS test_max
FROM (SELECT 'GENHLTH' AS name, 'ordinal' AS semantic_type, CAST(CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey % 5 END AS DOUBLE) AS v FROM nation
UNION ALL SELECT 'SMOKER', 'binary', CAST(1 + n_nationkey % 2 AS DOUBLE) FROM nation) GROUP BY ALL"""
)
def built_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a codebook and both samples to the written registry."""
    path, rows = scratch(spark, "codebook"), _answers(table(spark, sf_dir, "nation"))
    spark.createDataFrame([(PAGE,)], "value string").coalesce(1).write.text(path)
    out = experiments.build_registry(spark, path, rows, rows, scratch(spark, "registry"))
    return rounded(out.select("name", "semantic_type", "train_rows", "train_missing", "train_mean", "test_max"))


# -- baselines, continued fits, samples, representations --


@query('SELECT event_id, CAST(-1 AS INTEGER) AS "Prediction" FROM events')
def constant_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nobody is positive."""
    e = scored_events(spark, sf_dir)
    return runners.train_and_predict(e, e, runners.constant_fitter(runners.Study([], [], "y", "event_id")), "event_id", 0.5)


@query(
    f"""SELECT 'even' AS model, round(2 * avg(y) / (1 + avg(y)), 6) AS f1, round(avg(y), 6) AS accuracy, round(avg(-(y * ln(0.2) + (1 - y) * ln(0.8))), 6) AS log_loss, round(avg(y), 6) AS average_precision FROM {EVENTS_SQL}"""
)
def even_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score that tells nothing: the best threshold calls everyone positive."""
    fitter = runners.constant_fitter(runners.Study([], [], "y", "event_id"), 0.2)
    out = runners.run_suite(scored_events(spark, sf_dir), {"even": fitter}, "y", "event_id", None, 3, 2, 4)
    return rounded(out.select("model", "f1", "accuracy", "log_loss", "average_precision"))


@query(logistic_sql(_LINES, 8, 1.0) + "SELECT CAST(i AS INTEGER) AS steps, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM r WHERE i IN (4, 8)")
def logistic_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after four steps, and after four more from there."""
    rows, w, found = _lines(spark, sf_dir), [0.0, 0.0], []
    for steps in (4, 8):
        w = [float(x) for x in linear.logistic(rows, "y", ["one", "x"], w, 4, 1.0)[0]]
        found.append((steps, *w))
    return rounded(spark.createDataFrame(found, "steps int, w0 double, w1 double"))


@query(
    f"""WITH c AS (SELECT y, count(*) AS n, floor((SELECT count(*) FROM {EVENTS_SQL}) * 0.3) * count(*) / (SELECT count(*) FROM {EVENTS_SQL}) AS fair FROM {EVENTS_SQL} GROUP BY y),
q AS (SELECT y, floor(fair) AS quota, row_number() OVER (ORDER BY floor(fair) - fair, y) AS place FROM c)
SELECT y, CAST(quota + CASE WHEN place <= floor((SELECT count(*) FROM {EVENTS_SQL}) * 0.3) - (SELECT sum(quota) FROM q) THEN 1 ELSE 0 END AS BIGINT) AS n FROM q"""
)
def tree_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each class that a tree sees: the quotas are met exactly."""
    e = scored_events(spark, sf_dir).select("y", F.col("event_id").alias("rid"))
    quotas = boosting.class_quotas({r["y"]: r["count"] for r in e.groupBy("y").count().collect()}, 0.3)
    return e.where(boosting.sampled(e, quotas, 7, 2)).groupBy("y").agg(F.count("*").alias("n"))


@query(
    f"""SELECT event_id, round(1 / (1 + exp(-(0.3 + 1.5 * greatest(0.2 * p - 0.4 * y + 0.1, 0) - 0.7 * greatest(-0.6 * p + 0.9 * y - 0.2, 0) + 0.25 * greatest(p, 0)))), 6) AS p FROM {EVENTS_SQL}"""
)
def network_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network with given weights, saved, read back and applied batch by batch."""
    import numpy as np

    from millrace.operators import perceptron

    model = perceptron.Perceptron((3,))
    model.weights = [np.array([[0.2, -0.6, 1.0], [-0.4, 0.9, 0.0]]), np.array([[1.5], [-0.7], [0.25]])]
    model.biases = [np.array([0.1, -0.2, 0.0]), np.array([0.3])]
    path = scratch(spark, "network")
    model.save(spark, path)
    e = scored_events(spark, sf_dir).select("event_id", F.col("p").alias("a"), F.col("y").cast("double").alias("b"))
    return rounded(perceptron.predict(e, perceptron.Perceptron.load(spark, path), ["a", "b"], "event_id"))


@query(f"SELECT event_id, answer, days, yes, round(measure, 6) AS measure FROM {RAW_SQL}")
def raw_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocessing.raw_tree(COLUMNS).apply(survey(spark, sf_dir), "event_id"))


@query(
    f"""SELECT event_id, CASE WHEN answer NOT IN (1, 7, 8, 9) THEN answer END AS answer, CASE WHEN days = 77 THEN NULL WHEN days IN (88, 30) THEN 0 ELSE days END AS days, 2 - yes AS yes, round(measure, 6) AS measure FROM {RAW_SQL}"""
)
def overridden_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan names one more missing code and one more code for none."""
    s = survey(spark, sf_dir)
    plan = preprocessing.Plan(missing_codes={"answer": {1.0: "blank"}}, zero_codes={"days": (30.0,)})
    return rounded(preprocessing.fit_tree(s, COLUMNS, ENTRIES, plan).apply(s, "event_id"))


@query(
    f"""SELECT feature, count(*) AS rows, count(*) FILTER (v IS NULL) AS missing, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max
FROM (SELECT 'answer' AS feature, answer AS v FROM {RAW_SQL} WHERE event_id % 4 <> 0 UNION ALL SELECT 'measure', measure FROM {RAW_SQL} WHERE event_id % 4 <> 0) GROUP BY feature"""
)
def audited_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the training rows in an exploratory report."""
    s = survey(spark, sf_dir)
    return rounded(runners.audit(s.where("event_id % 4 <> 0"), s.where("event_id % 4 = 0"), PAIR[::-1], F.col("y"))["train"])


@query("SELECT unnest(['ordinal', 'binary', 'core_survey', 'optional_module', 'none']) AS name, unnest([1, 1, 1, 1, 2]) AS columns")
def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by type, source and risk, read from the tables of the Markdown summary."""
    path, rows = scratch(spark, "codebook"), _answers(table(spark, sf_dir, "nation"))
    spark.createDataFrame([(PAGE,)], "value string").coalesce(1).write.text(path)
    folder = scratch(spark, "registry")
    experiments.build_registry(spark, path, rows, rows, folder)
    lines = spark.read.text(f"{folder}/summary")
    cells = F.split("value", r"\s*\|\s*")
    return lines.where(F.col("value").rlike(r"^\| [a-z_]+ \| \d+ \|$")).select(cells[1].alias("name"), cells[2].cast("int").alias("columns"))

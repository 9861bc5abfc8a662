"""Queries of representations, imputation, validation and whole studies, with their SQL.

They read ``events`` as a survey: an answer with non-response codes, a number
of days with a code for none, a yes/no question and a measurement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import boosting, evaluation, imputation, preprocessing, profile, validation
from millrace.plans import runners
from millrace.plans.catalogue import query, rounded, scored_events, table

COLUMNS = ["answer", "days", "yes", "measure"]
UNSURE = [{"code": "7", "label": "Don't know/Not Sure"}, {"code": "8", "label": "Don't know/Refused/Missing"}, {"code": "9", "label": "Refused"}]
ENTRIES = [
    {"name": "answer", "semantic_type": "categorical", "documented_values": [], "special_values": UNSURE},
    {"name": "days", "semantic_type": "count", "documented_values": [{"code": "88", "label": "None"}], "special_values": [{"code": "77", "label": "Don't know/Not sure"}]},
    {"name": "yes", "semantic_type": "binary", "documented_values": [{"code": "1", "label": "Yes"}, {"code": "2", "label": "No"}], "special_values": []},
    {"name": "measure", "semantic_type": "continuous", "documented_values": [], "special_values": []},
]
SURVEY = [
    "event_id",
    "CAST(1 + user_id % 9 AS DOUBLE) AS answer",
    "CAST(CASE WHEN event_id % 31 = 0 THEN 77 WHEN user_id % 50 = 0 THEN 88 ELSE 1 + event_id % 30 END AS DOUBLE) AS days",
    "CAST(CASE WHEN event_id % 11 <> 0 THEN 1 + event_id % 2 END AS DOUBLE) AS yes",
    "CASE WHEN event_id % 13 <> 0 THEN value END AS measure",
    "CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS y",
]
RAW_SQL = f"(SELECT {', '.join(SURVEY)} FROM events)"
CLEAN_SQL = f"""(SELECT event_id, y, answer AS raw, CASE WHEN answer NOT IN (7, 8, 9) THEN answer END AS answer,
  CASE WHEN days = 77 THEN NULL WHEN days = 88 THEN 0 ELSE days END AS days, 2 - yes AS yes, measure FROM {RAW_SQL})"""
STUDY = runners.Study(COLUMNS, ENTRIES, "y", "event_id")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*SURVEY)


@query(f"""SELECT event_id, answer, days, yes, round(measure, 6) AS measure FROM {CLEAN_SQL}""")
def tree_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = survey(spark, sf_dir)
    return rounded(preprocessing.fit_tree(s, COLUMNS, ENTRIES).apply(s, "event_id"))


@query(
    f"""WITH c AS (SELECT * FROM {CLEAN_SQL}),
f AS (SELECT median(days) AS days, median(measure) AS measure, (SELECT yes FROM c WHERE yes IS NOT NULL GROUP BY yes ORDER BY count(*) DESC, yes LIMIT 1) AS yes, quantile_cont(measure, 0.5) AS knot FROM c),
x AS (SELECT event_id, answer, c.days AS raw_days, coalesce(c.days, f.days) AS days, coalesce(c.yes, f.yes) AS yes, c.yes AS raw_yes, coalesce(c.measure, f.measure) AS measure, c.measure AS raw_measure,
  greatest(coalesce(c.measure, f.measure) - knot, 0) AS h FROM c, f),
m AS (SELECT avg(days) AS ad, stddev_pop(days) AS sd, avg(measure) AS am, stddev_pop(measure) AS sm, avg(h) AS ah, stddev_pop(h) AS sh FROM x)
SELECT event_id, CAST(1 AS DOUBLE) AS intercept, {', '.join(f'CAST(coalesce(answer = {k}, false) AS INTEGER) AS answer__is_{k}' for k in range(2, 7))}, CAST(answer IS NULL AS INTEGER) AS answer__missing,
  round((days - ad) / sd, 6) AS days, yes, CAST(raw_yes IS NULL AS INTEGER) AS yes__missing, round((measure - am) / sm, 6) AS measure, CAST(raw_measure IS NULL AS INTEGER) AS measure__missing,
  round((h - ah) / sh, 6) AS half FROM x, m"""
)
def linear_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = survey(spark, sf_dir)
    plan = preprocessing.Plan(one_hot=("answer",), indicator_share=0.05, hinges={"measure": [0.5]})
    return rounded(preprocessing.fit_linear(s, COLUMNS, ENTRIES, plan).apply(s, "event_id").withColumnRenamed("measure__hinge_q0.5", "half"))


@query(
    f"""WITH c AS (SELECT * FROM {CLEAN_SQL}),
f AS (SELECT median(days) AS days, median(measure) AS measure, (SELECT yes FROM c WHERE yes IS NOT NULL GROUP BY yes ORDER BY count(*) DESC, yes LIMIT 1) AS yes FROM c),
x AS (SELECT event_id, answer, c.days AS raw_days, coalesce(c.days, f.days) AS days, coalesce(c.yes, f.yes) AS yes, c.yes AS raw_yes, coalesce(c.measure, f.measure) AS measure, c.measure AS raw_measure FROM c, f),
m AS (SELECT avg(days) AS ad, stddev_pop(days) AS sd, avg(measure) AS am, stddev_pop(measure) AS sm FROM x)
SELECT event_id, {', '.join(f'CAST(coalesce(answer = {k}, false) AS INTEGER) AS answer__is_{k}' for k in range(1, 7))}, CAST(answer IS NULL AS INTEGER) AS answer__missing, 0 AS answer__unseen,
  round((days - ad) / sd, 6) AS days, CAST(raw_days IS NULL AS INTEGER) AS days__missing, yes, CAST(raw_yes IS NULL AS INTEGER) AS yes__missing,
  round((measure - am) / sm, 6) AS measure, CAST(raw_measure IS NULL AS INTEGER) AS measure__missing FROM x, m"""
)
def network_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = survey(spark, sf_dir)
    return rounded(preprocessing.fit_network(s, COLUMNS, ENTRIES).apply(s, "event_id"))


@query(
    f"""WITH c AS (SELECT * FROM {RAW_SQL}), f AS (SELECT median(days) AS d, median(measure) AS m FROM c), x AS (SELECT event_id, coalesce(days, d) AS days, coalesce(measure, m) AS measure FROM c, f)
SELECT event_id, CAST(1 AS DOUBLE) AS intercept, round((days - (SELECT avg(days) FROM x)) / (SELECT stddev_pop(days) FROM x), 6) AS days,
  round((measure - (SELECT avg(measure) FROM x)) / (SELECT stddev_pop(measure) FROM x), 6) AS measure FROM x"""
)
def baseline_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = survey(spark, sf_dir)
    return rounded(preprocessing.fit_baseline(s, ["days", "measure"]).apply(s, "event_id"))


def _clean() -> dict:
    found = preprocessing.sources(COLUMNS, ENTRIES, preprocessing.Plan())
    return {s.name: s.clean for s in found}


TWELFTHS = ", ".join(f"CAST({i} AS DOUBLE) / 12" for i in range(1, 12))
BINS_SQL = f"""c AS (SELECT * FROM {CLEAN_SQL}), q AS (SELECT list_distinct(quantile_cont(days, [{TWELFTHS}])) AS e FROM c),
b AS (SELECT event_id, raw, answer, measure, CASE WHEN yes IS NULL THEN 0 ELSE CAST(2 - yes AS INTEGER) END AS b1, CASE WHEN days IS NULL THEN 0 ELSE 1 + len(list_filter(e, lambda x: x < days)) END AS b2 FROM c, q)"""


@query(
    f"""WITH {BINS_SQL}, o AS (SELECT * FROM b WHERE answer IS NOT NULL), n AS (SELECT answer, count(*) AS n, (SELECT count(*) FROM o) AS total, (SELECT count(DISTINCT answer) FROM o) AS classes FROM o GROUP BY answer),
w AS (SELECT 1 + max(b1) AS w1, 1 + max(b2) AS w2 FROM b), k AS (SELECT DISTINCT b1, b2 FROM b WHERE raw IN (7, 9)),
t1 AS (SELECT answer, b1, count(*) AS c FROM o GROUP BY ALL), t2 AS (SELECT answer, b2, count(*) AS c FROM o GROUP BY ALL),
s AS (SELECT k.b1, k.b2, n.answer, ln((n + 1) / (total + classes)) + ln((coalesce(t1.c, 0) + 1) / (n + w1)) + ln((coalesce(t2.c, 0) + 1) / (n + w2)) AS score
  FROM k CROSS JOIN n CROSS JOIN w LEFT JOIN t1 ON t1.answer = n.answer AND t1.b1 = k.b1 LEFT JOIN t2 ON t2.answer = n.answer AND t2.b2 = k.b2),
p AS (SELECT b1, b2, answer FROM s QUALIFY row_number() OVER (PARTITION BY b1, b2 ORDER BY score DESC, answer) = 1)
SELECT event_id, CASE WHEN raw IN (7, 9) THEN p.answer ELSE b.answer END AS answer, CAST(raw = 7 AS INTEGER) AS answer__was_unknown, CAST(raw = 9 AS INTEGER) AS answer__was_refused FROM b LEFT JOIN p ON b.b1 = p.b1 AND b.b2 = p.b2"""
)
def bayes_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, codes = survey(spark, sf_dir), preprocessing.code_map(ENTRIES[0])
    target = imputation.Target("answer", "categorical", imputation.response_codes(codes.missing, UNSURE))
    fitted = imputation.fit_imputer(s, [], _clean(), imputation.Settings(("yes", "days"), (target,)))
    return fitted.apply(s, "event_id").select("event_id", "answer", "answer__was_unknown", "answer__was_refused")


@query(
    f"""WITH {BINS_SQL}, o AS (SELECT * FROM b WHERE measure IS NOT NULL),
m AS (SELECT avg(b1) AS ax, avg(measure) AS ay, covar_pop(b1, measure) / var_pop(b1) / 1.01 AS slope, quantile_cont(measure, 0.001) AS low, quantile_cont(measure, 0.999) AS high FROM o)
SELECT event_id, round(coalesce(measure, greatest(low, least(high, ay + slope * (b1 - ax)))), 6) AS measure, CAST(measure IS NULL AS INTEGER) AS measure__was_blank FROM b, m"""
)
def ridge_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = survey(spark, sf_dir)
    settings = imputation.Settings(("yes",), (imputation.Target("measure", "continuous", blank=True),))
    return rounded(imputation.fit_imputer(s, [], _clean(), settings).apply(s, "event_id").select("event_id", "measure", "measure__was_blank"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place, count(*) OVER () AS n FROM events) WHERE place IN (SELECT i * ((SELECT count(*) FROM events) - 1) // 99 FROM range(100) t(i))")
def thinned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imputation.thinned(table(spark, sf_dir, "events").select("event_id"), "event_id", 100)


@query(
    f"""SELECT count(*) AS rows, count(*) * 3 AS cells, sum(k) AS missing, count(*) FILTER (k > 0) AS rows_with_missing, max(k) AS most_in_a_row
FROM (SELECT CAST(answer IS NULL AS INTEGER) + CAST(yes IS NULL AS INTEGER) + CAST(measure IS NULL AS INTEGER) AS k FROM {CLEAN_SQL})"""
)
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = survey(spark, sf_dir)
    return profile.missing_cells(preprocessing.fit_tree(s, COLUMNS, ENTRIES).apply(s), ["answer", "yes", "measure"])


@query(
    """WITH a AS (SELECT text, CAST(lang = 'en' AS INTEGER) AS y FROM documents WHERE doc_id % 2 = 0), g AS (SELECT text, count(*) AS n, count(DISTINCT coalesce(y, 0)) AS k FROM a GROUP BY text HAVING count(*) > 1)
SELECT (SELECT count(*) FROM g) AS groups, (SELECT coalesce(sum(n - 1), 0) FROM g) AS extra_rows, (SELECT count(*) FROM g WHERE k = 2) AS conflicting_groups,
  (SELECT count(*) FROM a WHERE coalesce(text, 'n') IN (SELECT coalesce(text, 'n') FROM documents WHERE doc_id % 2 = 1)) AS rows_in_test"""
)
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return profile.duplicate_summary(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["text"], (F.col("lang") == "en").cast("int"))


@query("SELECT sha256('v' || text) AS digest, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, digest LIMIT 20")
def largest_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.largest_groups(profile.duplicate_rows(table(spark, sf_dir, "documents"), ["text"], F.lit(1))).select("digest", "n")


@query(
    f"""SELECT row_number() OVER (ORDER BY answer NULLS LAST) AS place, coalesce(CAST(CAST(answer AS BIGINT) AS VARCHAR), '<MISSING>') AS value, n FROM (SELECT answer, count(*) AS n FROM {CLEAN_SQL} GROUP BY answer)"""
)
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = survey(spark, sf_dir)
    counts = profile.value_counts(s.select(_clean()["answer"].alias("answer")), "answer")
    return profile.category_order(counts).select(F.col("place").cast("long").alias("place"), "value", "n")


@query(
    """WITH a AS (SELECT user_id AS v, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id AS v, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT CAST(coalesce(a.v, b.v) AS VARCHAR) AS value, round(coalesce(a.n, 0) / (SELECT CAST(sum(n) AS DOUBLE) FROM a), 6) AS left_share, round(coalesce(b.n, 0) / (SELECT CAST(sum(n) AS DOUBLE) FROM b), 6) AS right_share,
  coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a.v = b.v ORDER BY n DESC, value LIMIT 10"""
)
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return rounded(profile.top_values(*[profile.value_counts(e.where(F.col("event_id") % 2 == k), "user_id") for k in (0, 1)]))


def _ntile(seed: int, folds: int) -> str:
    return f"CAST(ntile({folds}) OVER (PARTITION BY quality ORDER BY md5('{seed}|' || doc_id), doc_id) - 1 AS INTEGER)"


_OUTER = f"(SELECT doc_id, quality, {_ntile(5, 3)} AS fold FROM labels)"


@query(
    f"""SELECT o AS outer_fold, CAST(NULL AS INTEGER) AS inner_fold, doc_id, CASE WHEN fold = o THEN 'validation' ELSE 'train' END AS role FROM {_OUTER}, (SELECT unnest([0, 1, 2]) AS o)
"""
    + "".join(
        f"UNION ALL SELECT {k}, j, doc_id, CASE WHEN part = j THEN 'validation' ELSE 'train' END FROM (SELECT doc_id, {_ntile(6 + k, 2)} AS part FROM {_OUTER} WHERE fold <> {k}), (SELECT unnest([0, 1]) AS j)\n" for k in range(3)
    )
)
def nested_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.partitions(table(spark, sf_dir, "labels"), "quality", "doc_id", 3, 2, 5)
    return found.select(F.col("outer").alias("outer_fold"), F.col("inner").alias("inner_fold"), "doc_id", "role")


@query()
def leafwise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-first trees with sets of categories on row samples."""
    s = survey(spark, sf_dir)
    shown = preprocessing.fit_tree(s, COLUMNS, ENTRIES)
    settings = boosting.Settings(trees=3, depth=4, bins=32, min_leaf=20, seed=7, strategy="leafwise", max_leaves=6, categorical=("answer",), subsample=0.8)
    model = boosting.Booster(shown.names, settings).fit(shown.apply(s, "event_id", "y"), "y", key="event_id")
    return rounded(model.probabilities(shown.apply(s, "event_id"), "event_id"))


@query()
def nested_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled metrics of nested validation for a ridge and the constant baseline."""
    fitters = {"ridge": runners.ridge_fitter(STUDY, [1e-4], 4), "nobody": runners.constant_fitter(STUDY)}
    return rounded(runners.run_suite(survey(spark, sf_dir), fitters, "y", "event_id", outer=3, inner=2, seed=3))


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = survey(spark, sf_dir)
    score = runners.logistic_fitter(STUDY, [5], 1.0)(s)
    return rounded(validation.permutation_importance(s, {"measure": ["measure"], "answer": ["answer"]}, "y", "event_id", score, 0.2, [1, 2]))


@query(
    """WITH e AS (SELECT event_id % 3 AS fold, CAST(event_type = 'purchase' AS INTEGER) AS y, round(value / (value + 50), 3) AS p FROM events), c AS (SELECT fold, p AS t, sum(y) AS y, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT fold, t, sum(y) OVER w AS tp, sum(n) OVER w AS predicted, sum(y) OVER (PARTITION BY fold) AS positives, sum(n) OVER (PARTITION BY fold) AS total FROM c WINDOW w AS (PARTITION BY fold ORDER BY t DESC)),
m AS (SELECT fold, t, 2 * tp / (predicted + positives) AS f1, (tp + total - positives - (predicted - tp)) / total AS accuracy FROM r)
SELECT CAST(fold AS INTEGER) AS fold, t AS threshold, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM m QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(f1, 15) DESC, accuracy DESC, t DESC) = 1"""
)
def fold_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scored_events(spark, sf_dir).withColumn("fold", F.col("event_id") % 3)
    return rounded(evaluation.fold_thresholds(e, F.col("y"), F.col("p"), "fold", 3))


@query()
def compare_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thresholds on the same scores, as two studies."""
    e = scored_events(spark, sf_dir)
    low, high = (e.select("event_id", "y", (F.col("p") >= t).cast("int").alias("predicted")) for t in (0.5, 0.6))
    return rounded(evaluation.compare_studies(low, high, "event_id", "y", "predicted"))

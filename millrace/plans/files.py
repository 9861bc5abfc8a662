"""Queries of sources, sinks, codebooks and scalar rules, with their SQL.

Each writes what it reads to a fresh shared folder first, so that the reader,
its checks and the sink are run on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.functions.folders import scratch
from millrace.plans.catalogue import query, rounded, table
from millrace.sources import codebook, reports, tables
from millrace.streaming import scoring

# -- CSV sources and cached copies --

_FEATURES = "SELECT event_id AS \"Id\", CAST(user_id AS DOUBLE) AS user, CASE WHEN event_id % 13 <> 0 THEN value END AS value FROM events"
_LABELS = "SELECT event_id AS \"Id\", CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS label FROM events"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS Id", "CAST(user_id AS DOUBLE) AS user", "CASE WHEN event_id % 13 <> 0 THEN value END AS value")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS Id", "CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS label")


def _csv(df: DataFrame, label: str) -> str:
    path = scratch(df.sparkSession, label)
    df.write.csv(path, header=True)
    return path


@query(_FEATURES)
def csv_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature file with blanks, read with its checks."""
    return tables.read_features(spark, _csv(_features(spark, sf_dir), "features"))


@query(f'SELECT f."Id", label, user, value FROM ({_FEATURES}) f JOIN ({_LABELS}) l ON f."Id" = l."Id"')
def csv_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and labels of two files, which must have the same ids."""
    found = tables.read_features(spark, _csv(_features(spark, sf_dir), "features"))
    labels = tables.read_labels(spark, _csv(_labels(spark, sf_dir), "labels"), "label")
    return tables.aligned(found, labels, "Id")


@query("SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, count(*) FILTER (event_id % 13 = 0) AS blanks FROM events")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, ids and blank cells of a feature file."""
    found = tables.read_features(spark, _csv(_features(spark, sf_dir), "features"))
    return found.agg(F.count("*").alias("rows"), F.count_distinct("Id").alias("ids"), F.count(F.when(F.col("value").isNull(), 1)).alias("blanks"))


@query('SELECT n_nationkey AS position, 100 - n_nationkey AS "Id" FROM nation')
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a sample file in the order of the file."""
    n = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").selectExpr("100 - n_nationkey AS Id", "-1 AS Prediction")
    return tables.read_sample_ids(spark, _csv(n, "sample"))


@query(_FEATURES)
def cached_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy with a receipt, made once and then read."""
    path = scratch(spark, "cache")
    tables.cached(_features(spark, sf_dir), path)
    return tables.cached(_features(spark, sf_dir), path)


@query(
    """SELECT 'x_train' AS name, count(*) FILTER (event_id % 4 <> 0) AS rows FROM events UNION ALL SELECT 'y_train', count(*) FILTER (event_id % 4 <> 0) FROM events
UNION ALL SELECT 'x_test', count(*) FILTER (event_id % 4 = 0) FROM events UNION ALL SELECT 'sample', count(*) FILTER (event_id % 4 = 0) FROM events"""
)
def prepared_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked copies of the four files of a study."""
    folder, test = scratch(spark, "study"), "Id % 4 = 0"
    x, y = _features(spark, sf_dir), _labels(spark, sf_dir)
    files = {"x_train": x.where(f"not ({test})"), "x_test": x.where(test), "y_train": y.where(f"not ({test})"), "sample_submission": x.where(test).selectExpr("Id", "-1 AS Prediction")}
    for name, df in files.items():
        df.write.csv(f"{folder}/{name}.csv", header=True)
    found = tables.prepare(spark, folder, f"{folder}/cache", "label")
    return spark.createDataFrame([(name, df.count()) for name, df in found.items()], "name string, rows long")


@query(f"SELECT count(*) AS rows, CAST(coalesce(sum(CAST(CAST('0x' || left(d, 15) AS UBIGINT) AS HUGEINT)), 0) AS VARCHAR) AS digest FROM (SELECT sha256('v' || event_id || chr(31) || 'v' || user_id || chr(31) || coalesce('v' || event_type, 'n')) AS d FROM events)")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_digest(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))


# -- predictions, ledger, delivery --


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("position"), F.col("event_id").alias("Id"), tables.signed(F.col("value") / 100, 0.2).alias("Prediction"))


_SIGNED = "SELECT event_id AS \"Id\", CAST(CASE WHEN value / 100 >= 0.2 THEN 1 ELSE -1 END AS INTEGER) AS \"Prediction\" FROM events"


@query(_SIGNED)
def predictions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed predictions written in order and read back."""
    path = scratch(spark, "predictions") + ".csv"
    tables.write_predictions(_predictions(spark, sf_dir), path)
    return spark.read.schema("Id long, Prediction int").csv(path, header=True)


@query(f'SELECT "Id", -"Prediction" AS "Prediction", "Prediction" AS found FROM ({_SIGNED}) WHERE "Id" % 7 = 0')
def prediction_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a written file that are not as expected."""
    path = scratch(spark, "predictions") + ".csv"
    own = _predictions(spark, sf_dir)
    tables.write_predictions(own, path)
    return tables.prediction_faults(spark, path, own.withColumn("Prediction", F.when(F.col("Id") % 7 == 0, -F.col("Prediction")).otherwise(F.col("Prediction"))))


@query(f"""SELECT name, (SELECT count(*) FROM ({_SIGNED}) WHERE "Prediction" = 1) AS positives FROM (SELECT unnest(['first', 'second']) AS name)""")
def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified copies of two prediction files and their manifest."""
    own, folder = _predictions(spark, sf_dir), scratch(spark, "delivery")
    paths = {name: f"{folder}/source-{name}.csv" for name in ("first", "second")}
    for path in paths.values():
        tables.write_predictions(own, path)
    return tables.deliver(spark, paths, f"{folder}/out", own).select("name", "positives")


@query("""SELECT unnest(['a', 'b']) AS name, unnest(['{"rate": 0.1}', '{"rate": 0.2}']) AS config, unnest(['{"f1": 0.5}', '{"f1": 0.75}']) AS outcome""")
def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logged runs, published twice: each is in the ledger once."""
    folder, other = scratch(spark, "ledger"), scratch(spark, "ledger")
    for name, rate, f1 in (("a", 0.1, 0.5), ("b", 0.2, 0.75)):
        tables.append_run(spark, folder, name, {"rate": rate}, {"f1": f1})
    runs = spark.read.parquet(folder)
    runs.limit(0).write.parquet(other)
    for _ in range(2):
        tables.publish_runs(runs, other)
    return spark.read.parquet(other).select("name", "config", "outcome")


@query("SELECT bool_and(true) AS named FROM nation")
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of runs begin with the time in UTC, to the microsecond."""
    ids = spark.createDataFrame([(tables.run_id(f"run{i}"),) for i in range(20)], "id string")
    return ids.agg(F.bool_and(F.col("id").rlike(r"^\d{8}T\d{12}Z_run\d+-[0-9a-f]{6}$")).alias("named"))


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with its columns in a fixed order, read back by position."""
    path = scratch(spark, "report")
    tables.write_report_csv(table(spark, sf_dir, "nation"), path, ["n_nationkey", "n_name"])
    return spark.read.schema("key long, name string").csv(path, header=True)


# -- codebook and registry --

PAGE = """BEHAVIORAL RISK FACTOR SURVEILLANCE SYSTEM
CODEBOOK REPORT, 2015
Land-Line and Cell-Phone data
1 of 2

General Health
Section: 1.1 Health Status        Type: Num
Column: 80     SAS Variable Name: GENHLTH
Prologue:
Description: Would you say that in general
your health is:
Value      Value Label              Frequency    Percentage
1          Excellent                 72,000      16.4
2 - 4      Good or fair              350,000     80.0
5          24,000                    5.4
7          Don't know/Not Sure       800         0.2
9          Refused                   300         0.1
BLANK      Not asked or Missing      6           .
Notes: Asked of
all people

Smoker
Module: 3.2 Tobacco       Type: Num
Column: 91     SAS Variable Name: SMOKER
Description: Do you smoke?
Value      Value Label              Frequency    Percentage
1          Yes                       10          50.0
2          No                        10          50.0
"""


@query(
    """SELECT * FROM (VALUES
('GENHLTH', 'General Health', 'Would you say that in general your health is:', 'core_survey', '1.1', [1, 2], ['1=Excellent', '2 - 4=Good or fair', '5=Documented value (label omitted)', '7=Don''t know/Not Sure', '9=Refused', 'BLANK=Not asked or Missing'], ['Asked of all people'], 'ordinal', ['7', '9', 'BLANK'], 'none', ['1:1', '2:4', '5:5', '7:7', '9:9']),
('SMOKER', 'Smoker', 'Do you smoke?', 'optional_module', '3.2', [1, 2], ['1=Yes', '2=No'], [], 'binary', [], 'none', ['1:1', '2:2'])
) t(name, title, description, source_kind, section, pages, documented, notes, semantic_type, special, leakage_risk, intervals)"""
)
def codebook_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a codebook of two pages, with type, special values, domain and leakage."""
    path = scratch(spark, "codebook")
    spark.createDataFrame([(PAGE + "\f" + PAGE,)], "value string").coalesce(1).write.text(path)
    rows = []
    for e in codebook.entries(codebook.read_codebook(spark, path), {"GENHLTH": 9, "SMOKER": 2}):
        intervals = [f"{low:g}:{high:g}" for low, high in codebook.validation_intervals(e)]
        documented = [f"{v['code']}={v['label']}" for v in e["documented_values"]]
        rows.append((e["name"], e["title"], e["description"], e["source_kind"], e["section"], e["codebook_pages"], documented, e["notes"], e["semantic_type"], [v["code"] for v in e["special_values"]], e["leakage_risk"], intervals))
    columns = "name string, title string, description string, source_kind string, section string, pages array<int>, documented array<string>, notes array<string>, semantic_type string, special array<string>, leakage_risk string, intervals array<string>"
    return spark.createDataFrame(rows, columns)


@query("SELECT unnest(['GENHLTH', 'SMOKER']) AS name, unnest(['ordinal', 'binary']) AS semantic_type, (SELECT count(*) FROM nation) AS train_missing, unnest([['SMOKER'], ['GENHLTH']]) AS equal_columns")
def registry_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of columns joined with profiles, written, and its entries read back."""
    found = codebook.entries(codebook.parse_codebook(PAGE), {"GENHLTH": 9, "SMOKER": 2})
    missing = table(spark, sf_dir, "nation").count()
    profile = spark.createDataFrame([(n, missing) for n in ("GENHLTH", "SMOKER")], "feature string, missing long")
    joined = codebook.registry(spark, found, profile, profile, spark.createDataFrame([("GENHLTH", "SMOKER")], "left string, right string"))
    folder = scratch(spark, "registry")
    codebook.write_registry(joined, folder)
    names = [e["name"] for e in codebook.read_registry(spark, f"{folder}/json")]
    return joined.where(F.col("name").isin(names)).select("name", "semantic_type", "train_missing", "equal_columns")


# -- scalar rules --


@query(
    r"""SELECT doc_id, md5(regexp_replace(translate(lower(trim(text)), '’´', ''''''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS label,
  md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug FROM documents"""
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised labels and slugs of whole texts, as digests."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(scalars.normalise_label(F.col("text"))).alias("label"), F.md5(scalars.slug(F.col("text"))).alias("slug"))


@query(
    """SELECT l_orderkey, l_linenumber, format('{:.15g}', l_extendedprice * l_discount / 7) AS ratio,
  CASE WHEN l_tax = 0.05 THEN '<MISSING>' ELSE format('{:.15g}', l_tax * 1e-5) END AS small, format('{:.15g}', l_extendedprice * 3e12 + 0.5) AS large FROM lineitem"""
)
def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions with 15 digits; whole numbers without a point; scientific where very small or large."""
    li = table(spark, sf_dir, "lineitem")
    named = scalars.canonical_number
    small = F.when(F.col("l_tax") != 0.05, F.col("l_tax") * 1e-5)
    return li.select("l_orderkey", "l_linenumber", named(F.col("l_extendedprice") * F.col("l_discount") / 7).alias("ratio"), named(small).alias("small"), named(F.col("l_extendedprice") * 3e12 + 0.5).alias("large"))


@query(
    """SELECT event_id, round(1 / (1 + exp(50 - value)), 6) AS sigmoid, round(ln(1 + exp(value - 50)), 6) AS softplus, round_even(value * 100, 0) / 100 AS cents,
  round(ln(least(greatest(value / 200, 1e-12), 1 - 1e-12) / (1 - least(greatest(value / 200, 1e-12), 1 - 1e-12))), 6) AS logit FROM events WHERE value < 700"""
)
def stable_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value < 700")
    v = F.col("value")
    share = F.least(F.greatest(v / 200, F.lit(1e-12)), F.lit(1 - 1e-12))
    return rounded(e.select("event_id", scalars.sigmoid(v - 50).alias("sigmoid"), scalars.softplus(v - 50).alias("softplus"), scalars.round_half_even(v, 2).alias("cents"), F.ln(share / (1 - share)).alias("logit")))


_CODES = ["7", " 9 ", "BLANK", "", "1.5", "x", None, "7", "9"]
_REASONS = ["Don’t know/Not Sure", "Refused", "Not asked or Missing", "Yes", "No missing values", "Has a refused item", "Missing weight", "Don't know or refused", "MISSING"]


@query(
    """SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS place, unnest([7.0, 9.0, NULL, NULL, 1.5, NULL, NULL, 7.0, 9.0]::DOUBLE[]) AS code,
  unnest(['unknown', 'refused', 'blank', NULL, NULL, NULL, 'blank', 'unknown', 'blank']) AS reason"""
)
def label_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as numbers, and why a labelled code is missing: unknown before refused before blank."""
    rows = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(zip(_CODES, _REASONS))], "place int, code string, label string")
    return rows.select("place", scalars.finite_code(F.col("code")).alias("code"), scalars.missing_reason(F.col("label")).alias("reason"))


# -- streams --


@query(
    """SELECT date_trunc('hour', ts) AS start, count(*) FILTER (event_type = 'purchase' AND value >= 50) AS true_positive, count(*) FILTER (event_type <> 'purchase' AND value >= 50) AS false_positive,
  count(*) FILTER (event_type <> 'purchase' AND value < 50) AS true_negative, count(*) FILTER (event_type = 'purchase' AND value < 50) AS false_negative FROM events GROUP BY 1"""
)
def hourly_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts by event-time window, as the stream counts them."""
    e = table(spark, sf_dir, "events").select("ts", (F.col("event_type") == "purchase").cast("int").alias("y"), "value")
    return scoring.windowed_confusion(e, "ts", "y", "value", 50.0)


# -- checks of written results --


@query(f"""SELECT 'predictions.csv' AS path, length(t) AS size, sha256(t) AS sha256 FROM (SELECT 'Id,Prediction' || chr(10) || string_agg("Id" || ',' || "Prediction" || chr(10), '' ORDER BY "Id") AS t FROM ({_SIGNED}))""")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and SHA-256 of a written file."""
    folder = scratch(spark, "manifest")
    tables.write_predictions(_predictions(spark, sf_dir), f"{folder}/predictions.csv")
    return reports.manifest(spark, folder).where("path like '%.csv'")


@query("SELECT n_name AS path, CASE n_nationkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' ELSE 'unexpected' END AS fault FROM nation")
def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are missing, changed or not expected."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.col("n_nationkey").alias("k"))
    return reports.manifest_faults(n.where("k % 3 <> 2").withColumn("sha256", F.lit("a")), n.where("k % 3 <> 0").withColumn("sha256", F.lit("b")))


@query(
    """SELECT CAST(user_id AS VARCHAR) AS key, 'n' AS "column", CAST(n + 1 AS VARCHAR) AS reported, CAST(n AS VARCHAR) AS recomputed
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) WHERE user_id % 10 = 0"""
)
def report_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a written report that a new computation does not give."""
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    path = scratch(spark, "report")
    tables.write_report_csv(own.withColumn("n", F.col("n") + (F.col("user_id") % 10 == 0).cast("int")), path, ["user_id", "n", "mean"])
    written = spark.read.schema("user_id long, n long, mean double").csv(path, header=True)
    return reports.report_faults(written, own, "user_id")


@query("SELECT 'nations[' || (row_number() OVER (ORDER BY n_nationkey) - 1) || '].name' AS path, n_name AS value FROM nation QUALIFY contains(n_name, '1')")
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String values of a strict JSON document, with their paths."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    document = reports.loaded(reports.dumped({"nations": [{"name": r["n_name"], "key": r["n_nationkey"]} for r in rows]}))
    return spark.createDataFrame(list(reports.strings_in(document, lambda s: "1" in s)), "path string, value string")


@query("SELECT CAST(event_id // 2048 * 2048 AS BIGINT) AS start, count(*) AS rows, round(sum(value), 4) AS total, count(*) FILTER (event_id % 13 = 0) AS blanks FROM (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN value END AS value FROM events) GROUP BY 1")
def chunked_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 2048 rows in order of the id, as matrices."""
    import numpy as np

    own = _features(spark, sf_dir).orderBy("Id")
    found = [(start, len(keys), float(np.nansum(m[:, 0])), int(np.isnan(m[:, 0]).sum())) for start, keys, m in reports.chunks(own, "Id", ["value"])]
    return rounded(spark.createDataFrame(found, "start long, rows long, total double, blanks long"), 4)

"""Feature, label and result tables: validated reads, cached copies, sinks."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.folders import scratch
from millrace.functions.scalars import row_digest


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of ``Id`` and numeric columns; blank is null.

    Rows with another number of fields, repeated ids, and an empty table are
    errors.
    """
    names = spark.read.csv(path, header=True).columns
    if names[:1] != ["Id"] or len(set(names)) != len(names):
        raise ValueError("the header must start with Id and name each column once")
    schema = T.StructType([T.StructField("Id", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names[1:]]])
    df = spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False).csv(path)
    require_unique(df, "Id")
    return df


def read_labels(spark: SparkSession, path: str, label: str) -> DataFrame:
    """A CSV of ``Id`` and a label of -1 or 1."""
    if spark.read.csv(path, header=True).columns != ["Id", label]:
        raise ValueError(f"the header must be Id,{label}")
    df = spark.read.schema(f"Id long, `{label}` int").options(header=True, mode="FAILFAST", enforceSchema=False).csv(path)
    if not df.where(F.col(label).isNull() | ~F.col(label).isin(-1, 1)).isEmpty():
        raise ValueError("labels must be -1 or 1")
    require_unique(df, "Id")
    return df


def require_unique(df: DataFrame, key: str) -> None:
    rows, distinct = df.agg(F.count("*"), F.count_distinct(key)).first()
    if not rows:
        raise ValueError("no rows")
    if rows != distinct:
        raise ValueError(f"{key} must be unique and not null")


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of each side for every key; a key on one side only is an error."""
    only = left.select(key).join(right.select(key), key, "left_anti").unionByName(right.select(key).join(left.select(key), key, "left_anti"))
    if not only.isEmpty():
        raise ValueError(f"{key} differs between the tables")
    return left.join(right, key)


def fingerprint(df: DataFrame) -> dict[str, int]:
    """Rows, and a checksum that does not depend on their order."""
    row = df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("bits"), F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31))).alias("total")).first()
    return {"rows": row["rows"], "bits": row["bits"] or 0, "total": row["total"] or 0}


def table_digest(df: DataFrame) -> DataFrame:
    """``rows, digest``: the sum of the leading 60 bits of each row's SHA-256, whatever the order of rows."""
    head = F.conv(F.substring(row_digest(*[F.col(c) for c in df.columns]), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(head), F.lit(0)).cast("string").alias("digest"))


def cached(df: DataFrame, path: str) -> DataFrame:
    """A Parquet copy with a receipt in a table beside it.

    The copy goes to a folder of its own, and counts once a receipt names it: what
    a writer left that was stopped in between is never read. An existing copy is
    used only if its receipt matches both the source and the copy; else it is an
    error, never overwritten.
    """
    spark, want = df.sparkSession, json.dumps(fingerprint(df), sort_keys=True)
    receipts = f"{path}/receipt"
    held = spark.read.schema("value string, data string").json(receipts).collect() if exists(spark, receipts) else []
    if not held:
        data = f"{path}/data-{uuid.uuid4().hex}"
        df.write.parquet(data)
        spark.createDataFrame([(want, data)], "value string, data string").coalesce(1).write.mode("append").json(receipts)
        return spark.read.schema(df.schema).parquet(data)
    copy = spark.read.schema(df.schema).parquet(held[0]["data"])
    if len(held) > 1 or held[0]["value"] != want or json.dumps(fingerprint(copy), sort_keys=True) != want:
        raise ValueError("the cached copy is stale or was changed")
    return copy


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def signed(p, threshold: float):
    """Probability to -1 or 1; equal to the threshold is 1."""
    return F.when(p >= threshold, 1).otherwise(-1)


def write_predictions(df: DataFrame, path: str, order: str = "position") -> None:
    """``Id,Prediction`` in the given order, in one file with LF line ends; never overwritten.

    Sorted parts are written side by side, and joined by copying their bytes.
    """
    if not df.where(F.col("Prediction").isNull() | ~F.col("Prediction").isin(-1, 1)).isEmpty():
        raise ValueError("predictions must be -1 or 1")
    spark = df.sparkSession
    parts = scratch(spark, "predictions")
    df.orderBy(order).select(F.concat_ws(",", "Id", "Prediction").alias("value")).write.text(parts, lineSep="\n")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    files = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, False)
    try:
        out.write(bytearray(b"Id,Prediction\n"))
        for place in sorted(f.getPath().toString() for f in files.listStatus(source) if f.getPath().getName().startswith("part-")):
            part = files.open(jvm.org.apache.hadoop.fs.Path(place))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    finally:
        out.close()
    files.delete(source, True)


def prediction_faults(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Rows of a written file that differ from ``Id, Prediction`` of ``expected``."""
    found = spark.read.schema("Id long, Prediction int").csv(path, header=True).withColumnRenamed("Prediction", "found")
    return expected.select("Id", "Prediction").join(found, "Id", "full_outer").where(~F.col("Prediction").eqNullSafe(F.col("found")))


def run_id(name: str) -> str:
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%fZ}_{name}-{uuid.uuid4().hex[:6]}"


def append_run(spark: SparkSession, folder: str, name: str, config: dict, outcome: dict) -> str:
    """One row of the experiment ledger; strict JSON, so that NaN is refused."""
    own = run_id(name)
    row = (own, name, json.dumps(config, allow_nan=False, sort_keys=True), json.dumps(outcome, allow_nan=False, sort_keys=True))
    spark.createDataFrame([row], "run_id string, name string, config string, outcome string").coalesce(1).write.mode("append").parquet(folder)
    return own


def publish_runs(runs: DataFrame, folder: str) -> None:
    """Append the runs whose id the ledger does not have."""
    spark = runs.sparkSession
    held = spark.read.parquet(folder).select("run_id")
    runs.join(held, "run_id", "left_anti").write.mode("append").parquet(folder)


def read_sample_ids(spark: SparkSession, path: str) -> DataFrame:
    """``position, Id`` of a sample file ``Id,Prediction``, in the order of the file."""
    if spark.read.csv(path, header=True).columns != ["Id", "Prediction"]:
        raise ValueError("the header must be Id,Prediction")
    df = spark.read.schema("Id long, Prediction int").options(header=True, mode="FAILFAST", enforceSchema=False).csv(path)
    require_unique(df, "Id")
    return df.select(F.monotonically_increasing_id().alias("position"), "Id")


def prepare(spark: SparkSession, folder: str, cache: str, label: str) -> dict[str, DataFrame]:
    """Checked and cached copies of the training, test, label and sample files of a folder."""
    train, test = (read_features(spark, f"{folder}/{n}.csv") for n in ("x_train", "x_test"))
    if train.columns != test.columns:
        raise ValueError("training and test columns differ")
    labels, sample = read_labels(spark, f"{folder}/y_train.csv", label), read_sample_ids(spark, f"{folder}/sample_submission.csv")
    aligned(train.select("Id"), labels, "Id")
    aligned(test.select("Id"), sample, "Id")
    found = {"x_train": train, "x_test": test, "y_train": labels, "sample": sample}
    return {name: cached(df, f"{cache}/{name}") for name, df in found.items()}


def write_report_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A result of bounded size with its columns in a fixed order, as one CSV file."""
    df.select(*fields).coalesce(1).write.csv(path, header=True)


def save_out_of_fold(scores: DataFrame, rows: DataFrame, key: str, path: str) -> DataFrame:
    """Out-of-fold scores as a table, once they cover every row exactly once a stage."""
    from millrace.operators.validation import oof_faults

    if not oof_faults(scores, rows, key).isEmpty():
        raise ValueError("scores must cover every row once and lie in [0, 1]")
    scores.write.parquet(path)
    return scores.sparkSession.read.schema(scores.schema).parquet(path)


def deliver(spark: SparkSession, found: dict[str, str], folder: str, expected: DataFrame) -> DataFrame:
    """Verified copies of prediction files, with a manifest of their counts and checksums."""
    lines = []
    for name, path in sorted(found.items()):
        df = spark.read.schema("Id long, Prediction int").csv(path, header=True)
        aligned(df, expected.select("Id"), "Id")
        ordered = df.join(expected.select("position", "Id"), "Id")
        write_predictions(ordered, f"{folder}/{name}")
        copy = spark.read.schema("Id long, Prediction int").csv(f"{folder}/{name}", header=True)
        if fingerprint(copy) != fingerprint(df):
            raise ValueError(f"the copy of {name} differs")
        lines.append((name, copy.where("Prediction = 1").count(), json.dumps(fingerprint(copy), sort_keys=True)))
    manifest = spark.createDataFrame(lines, "name string, positives long, fingerprint string")
    manifest.coalesce(1).write.json(f"{folder}/manifest")
    return manifest

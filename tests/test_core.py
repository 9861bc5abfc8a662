"""The core operators against published constants, brute force and SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import boosting, cleaning, evaluation, linear, profile, sampling
from millrace.operators.perceptron import Perceptron

# Three rows and the weights and losses that are published for them.
ROWS = [(0.1, 2.3, 3.2), (0.3, 1.0, 0.1), (0.5, 1.4, 2.3)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, "y double, a double, b double").withColumn("z", (F.col("y") > 0.2).cast("double"))


def near(found, weights, loss):
    np.testing.assert_allclose(found[0], weights, rtol=1e-4, atol=1e-6)
    assert found[1] == pytest.approx(loss, rel=1e-4)


def test_linear_solvers(small):
    x = ["a", "b"]
    near(linear.gradient_descent(small, "y", x, [0.5, 1.0], 2, 0.1), [-0.050586, 0.203718], 0.051534)
    near(linear.least_squares(small, "y", x), [0.218786, -0.053837], 0.026942)
    near(linear.ridge(small, "y", x, 1.0), [0.054303, 0.042713], 0.031750)
    near(linear.logistic(small, "z", x, [0.5, 1.0], 2, 0.1), [0.378561, 0.801131], 1.348358)
    near(linear.logistic(small, "z", x, [0.5, 1.0], 2, 0.1, 1.0), [0.216062, 0.467747], 0.972165)
    one = small.limit(1).withColumn("k", F.lit(1))
    near(linear.stochastic_gradient(one, "y", x, [0.5, 1.0], 2, 0.1, 7, "k"), [0.063058, 0.392080], 0.844595)


def test_metrics_and_thresholds(spark):
    df = spark.createDataFrame(list(zip([1, 1, 1, 0, 0, 0], [1, 1, 0, 1, 0, 0])), "t int, p int")
    row = evaluation.metrics(evaluation.confusion(df, F.col("t"), F.col("p"))).first()
    assert row["f1"] == row["precision"] == row["recall"] == pytest.approx(2 / 3)
    ties = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, s double")
    curve = {r["threshold"]: (r["precision"], r["recall"]) for r in evaluation.precision_recall_curve(ties, F.col("y"), F.col("s")).collect()}
    assert curve == {0.9: (1.0, 0.5), 0.8: (pytest.approx(2 / 3), 1.0), 0.1: (0.5, 1.0)}
    assert evaluation.average_precision(ties, F.col("y"), F.col("s")).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    tied = spark.createDataFrame(list(zip([1, 1, 0, 0, 0, 0], [0.9, 0.8, 0.8, 0.8, 0.1, 0.1])), "y int, s double")
    best = evaluation.best_f1_threshold(tied, F.col("y"), F.col("s")).first()
    assert (best["threshold"], best["accuracy"]) == (0.9, pytest.approx(5 / 6))
    assert evaluation.log_loss(spark.createDataFrame([(1, 1.0), (0, 0.0)], "y int, p double"), F.col("y"), F.col("p")).first()[0] < 1e-10


def test_golden_booster_scores(spark):
    x = np.random.default_rng(433).normal(size=(16, 3)).astype(np.float32)
    y = [0, 1, 1, 0, 0, 1, 0, 1, 1, 0, 1, 0, 1, 0, 0, 1]
    rows = [(i, *map(float, r), t) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, y int")
    # Published scores of this case.
    want = {
        "recursive": [
            -0.06225051480366607, -0.02034407293736273, 0.11839729413817743, -0.13676667968181902, -0.13676667968181902, 0.08350027679762122,
            -0.03897911969955998, 0.11839729413817743, 0.11839729413817743, -0.05996322047495945, 0.11839729413817743, -0.09429560006186782,
            0.11839729413817743, 0.06308081377586958, 0.11839729413817743, -0.03897911969955998,
        ],
        "levelwise": [
            -0.12455828317786181, -0.031098254271098958, 0.12689105116118177, -0.16400566095464195, -0.16400566095464195, 0.12689105116118177,
            -0.0705456320478791, 0.12689105116118177, 0.12689105116118177, -0.0705456320478791, 0.12689105116118177, -0.0705456320478791,
            0.12689105116118177, 0.12689105116118177, 0.12689105116118177, -0.0705456320478791,
        ],
    }
    for strategy, scores in want.items():
        s = boosting.Settings(trees=4, depth=2, min_leaf=2, bins=4, max_features=2, seed=29, strategy=strategy, rate=0.05)
        model = boosting.Booster(["a", "b", "c"], s).fit(df, "y")
        got = [r["score"] for r in model.decision(df, "k").orderBy("k").collect()]
        np.testing.assert_allclose(got, scores, rtol=1e-9, atol=1e-12)


def test_missing_only_split(spark):
    rows = [(float(i), 0) for i in range(40)] + [(None, 1)] * 20
    df = spark.createDataFrame(rows, "x double, y int")
    for strategy in ("recursive", "levelwise"):
        s = boosting.Settings(trees=1, depth=1, min_leaf=5, bins=4, strategy=strategy)
        root = boosting.Booster(["x"], s).fit(df, "y").trees[0][0]
        assert (root.feature, root.split_bin, root.missing_left) == (0, 3, False)


def test_cleaning_rules(spark):
    df = spark.createDataFrame([(1.0, 88.0), (2.0, 3.0), (7.0, 77.0)], "b double, d double")
    codes = cleaning.Codes({77.0: "unknown", 99.0: "refused"}, (88.0,))
    assert [r[0] for r in df.select(cleaning.cleaned(F.col("d"), codes)).collect()] == [0.0, 3.0, None]
    swap = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    assert [r[0] for r in swap.select(cleaning.mapped(F.col("x"), {0.0: 1.0, 1.0: 0.0})).collect()] == [1.0, 0.0]
    fruit = spark.createDataFrame([(101.0,), (207.0,), (330.0,), (300.0,), (555.0,), (None,)], "x double")
    assert [r[0] for r in fruit.select(cleaning.daily_rate(F.col("x"))).collect()] == [1.0, 1.0, 1.0, 0.0, 0.0, None]
    with pytest.raises(Exception, match="unexpected frequency"):
        spark.createDataFrame([(444.0,)], "x double").select(cleaning.daily_rate(F.col("x"))).collect()


def test_profiles_and_sampling(spark):
    a, b = (spark.createDataFrame(list(x.items()), "value string, n long") for x in ({"a": 50, "b": 50}, {"a": 20, "b": 80}))
    assert profile.total_variation(a, b).first()[0] == pytest.approx(0.3)
    assert profile.total_variation(a, b.limit(0)).first()[0] == 0
    df = spark.createDataFrame([(i, 1 if i < 10 else 0) for i in range(110)], "k int, y int")
    five, seven = ({r["k"] for r in sampling.undersample(df, "y", "k", r, 1).collect()} for r in (5, 7))
    assert five < seven and len(five) == 60 and len(seven) == 80
    split = sampling.stratified_split(df, "y", "k", 0.2, 3).groupBy("y", "validation").count().collect()
    assert {(r["y"], r["validation"]): r["count"] for r in split} == {(0, True): 20, (0, False): 80, (1, True): 2, (1, False): 8}


def test_perceptron_learns_xor():
    x = np.array([[-1, -1], [-1, 1], [1, -1], [1, 1]] * 16, float)
    y = (x[:, 0] != x[:, 1]).astype(float)
    model = Perceptron((16,), rate=0.02, l2=0, batch=16, epochs=200).fit(x, y)
    assert ((model.probabilities(x) > 0.5) == y).all() and model.loss(x, y) < 0.05


def test_sources(spark, tmp_path):
    from millrace.sources import tables

    (tmp_path / "f.csv").write_text("Id,A,B\n10,1.5,\n11,2.5,3.5\n")
    df = tables.read_features(spark, str(tmp_path / "f.csv"))
    assert [tuple(r) for r in df.orderBy("Id").collect()] == [(10, 1.5, None), (11, 2.5, 3.5)]
    copy = tables.cached(df, str(tmp_path / "copy"))
    assert tables.cached(df, str(tmp_path / "copy")).count() == copy.count() == 2
    with pytest.raises(ValueError, match="stale"):
        tables.cached(df.limit(1), str(tmp_path / "copy"))
    out = spark.createDataFrame([(1, 20, -1), (2, 21, 1)], "position int, Id long, Prediction int")
    tables.write_predictions(out, str(tmp_path / "p"))
    assert tables.prediction_faults(spark, str(tmp_path / "p"), out).isEmpty()


def test_entry_has_the_core_queries(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cached_copy_after_a_stop(spark, tmp_path):
    from millrace.sources import tables

    df = spark.range(20).selectExpr("id as Id", "id * 2.0 as x")
    df.write.parquet(str(tmp_path / "data-left-behind"))  # a writer that was stopped before its receipt
    assert tables.cached(df, str(tmp_path)).count() == 20
    assert tables.cached(df, str(tmp_path)).count() == 20
    with pytest.raises(ValueError, match="stale"):
        tables.cached(df.where("Id > 3"), str(tmp_path))


def test_predictions_are_one_file(spark, tmp_path):
    from millrace.sources import tables

    df = spark.range(50).selectExpr("49 - id as position", "id as Id", "cast(case when id % 3 = 0 then 1 else -1 end as int) as Prediction").repartition(5)
    tables.write_predictions(df, str(tmp_path / "out.csv"))
    lines = (tmp_path / "out.csv").read_bytes().decode().split("\n")
    assert lines[0] == "Id,Prediction" and lines[1:-1] == [f"{i},{1 if i % 3 == 0 else -1}" for i in range(49, -1, -1)] and lines[-1] == ""


def test_equal_columns_on_many_partitions(spark):
    from millrace.operators.profile import duplicate_columns

    df = spark.range(3000).selectExpr("id * 0.1 as a", "id / 7.0 as b", "id * 0.1 as c", "cast(null as double) as d").repartition(13)
    assert [tuple(r) for r in duplicate_columns(df, ["a", "b", "c", "d"]).collect()] == [("a", "c")]


def test_stream_of_scores(spark, tmp_path):
    from millrace.streaming.scoring import windowed_confusion

    rows = spark.range(300).selectExpr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id, 0) as ts", "cast(id % 2 as int) as y", "id % 5 / 4.0 as p")
    rows.coalesce(3).write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, windowed_confusion(rows, "ts", "y", "p", 0.5).collect()))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windowed_confusion(stream, "ts", "y", "p", 0.5, late="1 day").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == want


def test_matrix_files_and_strict_documents(spark, tmp_path):
    from millrace.sources import reports

    df = spark.range(25).selectExpr("id as k", "case when id % 5 = 0 then null else id * 1.5 end as a", "id * -1.0 as b").coalesce(1)
    reports.write_matrix(df, "k", ["a", "b"], str(tmp_path / "m.npy"), 7)
    found = np.load(tmp_path / "m.npy", mmap_mode="r")
    assert found.shape == (25, 2) and np.isnan(found[::5, 0]).all() and found[3].tolist() == [4.5, -3.0]
    assert list(reports.strings_in({"a": ["x", {"b": "y"}], "c": "x", "d": 1}, lambda s: s == "x")) == [("a[0]", "x"), ("c", "x")]
    with pytest.raises(ValueError):
        reports.dumped({"a": float("nan")})
    with pytest.raises(ValueError):
        reports.loaded('{"a": NaN}')


def test_report_cells_at_rounding_edges(spark):
    from millrace.sources import reports

    columns, up = "k long, n long, mean double", float(np.nextafter(51.0384375, 52))
    down = float(np.nextafter(51.0384375, 51))
    report = [(1, 5, up), (2, 5, -1e-10), (3, 5, 51.038438), (4, 6, 1.0), (5, 5, float("inf")), (6, 5, float("nan")), (7, 5, None), (8, 5, 2.0**53)]
    own = [(1, 5, down), (2, 5, 1e-10), (3, 5, 51.038437), (4, 5, 1.0), (5, 5, 1.0), (6, 5, 1.0), (7, 5, 1.0), (8, 5, 2.0**53 + 8)]
    found = reports.report_faults(spark.createDataFrame(report, columns), spark.createDataFrame(own, columns), "k")
    assert found.columns == ["key", "column", "reported", "recomputed"]
    assert sorted((r.key, r.column, r.reported, r.recomputed) for r in found.collect() if r.reported) == [
        ("3", "mean", "51.038438", "51.038437"), ("4", "n", "6", "5"), ("5", "mean", "Infinity", "1.0"), ("6", "mean", "NaN", "1.0"),
    ]
    assert [(r.key, r.column, r.recomputed) for r in found.where("reported IS NULL").collect()] == [("7", "mean", "1.0")]

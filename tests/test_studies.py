"""Whole studies, result files and report tables on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import boosting, evaluation, profile, validation
from millrace.plans import runners
from millrace.sources import tables

ENTRIES = [
    {"name": "a", "semantic_type": "continuous", "documented_values": [], "special_values": []},
    {"name": "c", "semantic_type": "categorical", "documented_values": [], "special_values": [{"code": "9", "label": "Refused"}]},
]
STUDY = runners.Study(["a", "c"], ENTRIES, "y", "k")


@pytest.fixture(scope="module")
def rows(spark):
    random = np.random.default_rng(2)
    found = [(i, float(a), float(random.choice([1, 2, 9])), int(a + 0.2 * random.normal() > 0.5), "x") for i, a in enumerate(random.normal(size=90))]
    return spark.createDataFrame(found, "k long, a double, c double, y int, p string").persist()


def quality(scores, rows):
    joined = scores.select("k", F.col("p").alias("score")).join(rows.select("k", "y"), "k")
    return evaluation.average_precision(joined, F.col("y"), F.col("score")).first()[0]


def test_every_fitter_learns(rows):
    settings = boosting.Settings(trees=3, rate=0.3, depth=2, min_leaf=4, bins=8, strategy="recursive", categorical=("c",))
    boosted = runners.boosting_fitter(STUDY, settings, [1, 3])(rows)(rows)
    assert boosted.select("stage").distinct().count() == 2
    assert quality(boosted.where("stage = 3"), rows) > 0.8
    steps = runners.logistic_fitter(STUDY, [5, 20], 1.0, products=(("a", "c"),))(rows)(rows)
    assert steps.count() == 180 and quality(steps.where("stage = 20"), rows) > 0.8
    ridge = runners.ridge_fitter(STUDY, [1e-4, 0.1], 20)(rows)(rows)
    assert quality(ridge.where("stage = 0"), rows) > 0.8
    network = runners.network_fitter(STUDY, hidden=(8,), epochs=40, rate=0.02, batch=16)
    assert quality(network(rows)(rows), rows) > 0.8
    mean = runners.ensemble_fitter([runners.constant_fitter(STUDY, 0.2), runners.constant_fitter(STUDY, 0.8)])(rows)(rows)
    assert [r[0] for r in mean.select("p").distinct().collect()] == [pytest.approx(0.5)]


def test_train_predict_and_suite(rows, spark, tmp_path):
    fit = runners.ridge_fitter(STUDY, [1e-4], 10)
    threshold = runners.calibrated_threshold(rows, fit, "y", "k", 3, 1)
    found = runners.train_and_predict(rows, rows, fit, "k", threshold)
    assert {r[0] for r in found.select("Prediction").distinct().collect()} == {-1, 1}
    nobody = runners.constant_fitter(STUDY)
    pooled = runners.run_suite(rows, {"nobody": nobody}, "y", "k", str(tmp_path / "ledger"), 2, 2, 1).first()
    assert (pooled["model"], pooled["recall"]) in {("nobody", 0.0), ("nobody", 1.0)}
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 1
    placed = rows.withColumn("fold", (F.col("k") % 2).cast("int"))
    scores = validation.out_of_fold(placed, "k", "fold", 2, nobody)
    assert tables.save_out_of_fold(scores, rows, "k", str(tmp_path / "oof")).count() == 90
    with pytest.raises(ValueError, match="cover every row"):
        tables.save_out_of_fold(scores.limit(5), rows, "k", str(tmp_path / "bad"))


def test_best_threshold_of_constant_scores(spark):
    df = spark.range(4).select((F.col("id") == 0).cast("int").alias("y"), F.lit(0.5).alias("p"))
    best = evaluation.best_f1_threshold(df, F.col("y"), F.col("p")).first()
    assert best["threshold"] == 0.5 and best["f1"] == pytest.approx(0.4)
    none = evaluation.best_f1_threshold(df.withColumn("y", F.lit(0)), F.col("y"), F.col("p")).first()
    assert none["none_positive"] and none["threshold"] is None


def test_comparing_studies(spark):
    rows = [(i, i % 2, int(i % 2 == 1 and i % 3 > 0), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, y int, a int, b int")
    before, after = (df.select("k", "y", F.col(c).alias("p")) for c in "ab")
    row = evaluation.compare_studies(before, after, "k", "y", "p", 500).first()
    assert (row["recovered_fn"], row["lost_tp"], row["added_fp"], row["removed_fp"]) == (10, 0, 0, 0)
    assert row["difference"] == pytest.approx(0.2) and row["low"] <= 0.2 <= row["high"]
    with pytest.raises(ValueError, match="differ"):
        evaluation.paired(before, after.where("k > 0"), "k", "y", "p")
    scored = df.select((F.col("k") % 3).alias("fold"), "y", (F.col("k") / 60).alias("s"))
    own = evaluation.fold_thresholds(scored, F.col("y"), F.col("s"), "fold", 3)
    assert [r["fold"] for r in own.orderBy("fold").collect()] == [0, 1, 2]


def test_plans_and_network_files(spark, tmp_path):
    from millrace.operators.perceptron import Perceptron

    suite = {"variants": [{"name": "one", "exclude": ["a"]}, {"name": "two"}]}
    assert runners.named_plan(suite, "one").exclude == ("a",)
    with pytest.raises(ValueError, match="0 variants"):
        runners.named_plan(suite, "three")
    x = np.random.default_rng(1).normal(size=(40, 2))
    y, seen = (x[:, 0] > 0).astype(float), []
    model = Perceptron((4,), epochs=3).fit(x, y, (x, y), seen.append)
    model.save(spark, str(tmp_path / "net"))
    np.testing.assert_array_equal(Perceptron.load(spark, str(tmp_path / "net")).probabilities(x), model.probabilities(x))
    assert [e["epoch"] for e in seen] == [1, 2, 3] and seen[0]["held_loss"] > 0


def test_prepare_and_deliver(spark, tmp_path):
    files = {"x_train": "Id,A\n1,0.5\n2,\n", "x_test": "Id,A\n3,0.1\n4,0.2\n", "y_train": "Id,L\n1,1\n2,-1\n", "sample_submission": "Id,Prediction\n4,1\n3,1\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    found = tables.prepare(spark, str(tmp_path), str(tmp_path / "cache"), "L")
    assert [r["Id"] for r in found["sample"].orderBy("position").collect()] == [4, 3]
    out = found["sample"].withColumn("Prediction", F.lit(-1))
    tables.write_predictions(out, str(tmp_path / "p"))
    manifest = tables.deliver(spark, {"one": str(tmp_path / "p")}, str(tmp_path / "delivered"), found["sample"])
    assert manifest.first()["positives"] == 0
    tables.write_report_csv(out, str(tmp_path / "r"), ["Prediction", "Id"])
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["Prediction", "Id"]
    (tmp_path / "x_test.csv").write_text("Id,A\n3,0.1\n5,0.2\n")
    with pytest.raises(ValueError):
        tables.prepare(spark, str(tmp_path), str(tmp_path / "cache2"), "L")


def test_reports(spark):
    df = spark.createDataFrame([(1.0, None, 1), (1.0, None, 0), (2.0, 5.0, 1), (None, None, 1)], "a double, b double, y int")
    cells = profile.missing_cells(df, ["a", "b"]).first()
    assert tuple(cells) == (4, 8, 4, 3, 2)
    report = runners.audit(df, df.limit(1), ["a", "b"], F.col("y"))
    summary = report["duplicates"].first()
    assert (summary["groups"], summary["conflicting_groups"], summary["rows_in_test"]) == (1, 1, 2)
    counts = spark.createDataFrame([("10", 1), ("<MISSING>", 2), ("9", 3), ("x", 4)], "value string, n long")
    assert [r["value"] for r in profile.category_order(counts).orderBy("place").collect()] == ["9", "10", "x", "<MISSING>"]
    top = profile.top_values(counts, counts.where("n > 3"), 2).collect()
    assert [(r["value"], r["n"]) for r in top] == [("x", 8), ("9", 3)] and top[0]["right_share"] == 1.0


def test_importance_with_kept_trees(spark):
    from millrace.operators import boosting, validation
    from millrace.plans import experiments

    rows = spark.range(600).selectExpr("id as k", "cast(id % 7 as double) as a", "cast(id % 11 as double) as b", "cast(id % 13 as double) as c", "cast(case when id % 7 + id % 11 > 8 then 1 else 0 end as int) as y")
    model = boosting.Booster(["a", "b", "c"], boosting.Settings(trees=6, depth=1, rate=0.5, min_leaf=10, bins=8)).fit(rows, "y", key="k")
    groups = {"a": ["a"], "b": ["b"], "c": ["c"]}
    whole = validation.permutation_importance(rows, groups, "y", "k", lambda df: model.probabilities(df, "k"), 0.5, [1, 2])
    kept = experiments.boosting_importance(model, rows, groups, "y", "k", 0.5, [1, 2])
    want, got = ({r["feature"]: r for r in df.collect()} for df in (whole, kept))
    for name in groups:
        for c in ("f1_drop", "ap_drop", "log_loss_rise"):
            assert got[name][c] == pytest.approx(want[name][c], abs=1e-9)
    assert got["c"]["log_loss_rise"] == pytest.approx(0, abs=1e-9)


def test_candidates_and_selection(spark):
    from millrace.operators import boosting
    from millrace.plans import experiments, runners

    rows = spark.range(900).selectExpr("id as k", "cast(id % 7 as double) as a", "cast(id % 13 as double) as c", "cast(case when id % 7 > 4 then 1 else 0 end as int) as y")
    entries = [{"name": n, "semantic_type": "continuous", "documented_values": [], "special_values": []} for n in "ac"]
    study = runners.Study(["a", "c"], entries, "y", "k")
    settings = boosting.Settings(trees=3, depth=1, rate=0.5, min_leaf=10, bins=8)
    seen = []
    scorer = experiments.timed(experiments.selected(study, settings, 1, [1], 3, 200), lambda *phase: seen.append(phase))(rows)
    p = {r["k"]: r["p"] for r in scorer(rows).collect()}
    assert [n for n, _ in seen] == ["fit", "score"] and p[5] > 0.5 > p[1]
    assert len({round(v, 9) for v in p.values()}) == 2  # one column, one split
    heavier = {r["k"]: r["p"] for r in experiments.weighted(study, settings, 5.0)(rows)(rows).collect()}
    assert heavier[1] > p[1]
    pilot = runners.boosting_fitter(study, settings)
    sizes = []
    experiments.undersampled(lambda train: sizes.append(train.groupBy("y").count().collect()) or pilot(train), "y", "k", 1, 2, pilot)(rows)
    assert len({r["count"] for r in sizes[0]}) == 1

"""Modelling jobs: properties that hold whatever the trees look like."""

import random

import pytest
from pyspark.sql import functions as F

from clickforge.plans import models as ML

N = 400


@pytest.fixture(scope="module")
def table(spark):
    """Two informative columns and one of noise; one row in five is a click."""
    rng = random.Random(3)
    rows = []
    for i in range(N):
        y = int(i % 5 == 0)
        rows.append((f"k{i:04d}", y, rng.gauss(2.0 * y, 1), rng.gauss(-y, 1), rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "row_key string, __y int, a double, b double, c double").repartition(3).cache()


def test_patience_stops():
    losses = [5, 4, 3, 3.5, 3.4, 3.3, 1]
    assert ML.best_iteration(losses, patience=3) == 3      # the 1 comes too late
    assert ML.best_iteration(losses, patience=4) == 7
    assert ML.best_iteration([], patience=3) == 0


@pytest.fixture(scope="module")
def cv(table):
    return ML.cross_validate(table, ["a", "b", "c"], k=3)


def test_cross_validation(cv, table):
    folds, oof = cv
    rows = folds.collect()
    assert sorted(r["fold"] for r in rows) == [0, 1, 2]
    assert all(0 < r["best_iteration"] <= r["rounds"] < ML.MAX_ROUNDS for r in rows)  # stopped early
    out = oof.collect()
    assert sorted(r["row_key"] for r in out) == sorted(r["row_key"] for r in table.collect())
    assert all(0 <= r["p"] <= 1 for r in out)
    pos, neg = ([r["p"] for r in out if r["__y"] == y] for y in (1, 0))
    assert sum(p > n for p in pos for n in neg) / (len(pos) * len(neg)) > 0.7


def test_patience_acts_on_real_losses(cv):
    assert all(r["rounds"] == r["best_iteration"] + ML.PATIENCE for r in cv[0].collect())


def flagged(table):
    held = F.col("row_key").endswith("5") | F.col("row_key").endswith("2")
    return ML.with_weights(ML.assemble(table, ["a", "b", "c"]), 4.0).withColumn(ML.VALID, held)


def scores(model, rows):
    return [r["p"] for r in ML.positive_probability(model.transform(rows)).orderBy("row_key").collect()]


def test_boosting_gives_the_model_of_the_best_round(table):
    data = flagged(table)
    model, losses, best = ML.boost(data, ML.GBT_A, patience=3)
    assert model.getNumTrees == best == losses.index(min(losses)) + 1 and len(losses) == best + 3
    valid = data.where(ML.VALID)
    assert model.evaluateEachIteration(valid.withColumn("w", F.lit(1.0))) == pytest.approx(losses[:best], rel=1e-9)  # the metric has no class weight


@pytest.mark.parametrize("preset, n", [("GBT_A", 12), ("GBT_CV", 4)])  # later, rounding turns a tie of splits of GBT_CV
def test_resumed_boosting_grows_the_trees_of_a_plain_fit(table, monkeypatch, preset, n):
    monkeypatch.setattr(ML, "WRITE_ROUNDS", 3)
    preset = getattr(ML, preset)
    rounds = ML.Boosting(flagged(table), preset)
    for _ in range(2):
        rounds.step()
    first = [t.toDebugString for t in rounds.trees]
    rounds.run(max_iter=n, patience=100)  # goes on, over checkpoints of the margin
    assert len(rounds.trees) == len(rounds.losses) == n and [t.toDebugString for t in rounds.trees[:2]] == first
    rows = rounds.state.withColumn("row_key", F.monotonically_increasing_id())
    fitted, valid = rows.where(~F.col(ML.VALID)), rows.where(ML.VALID)
    plain = ML.gbt(preset, n).fit(fitted)
    assert [t.numNodes for t in rounds.trees] == [t.numNodes for t in plain.trees]
    assert scores(rounds.model(), valid) == pytest.approx(scores(plain, valid), rel=1e-6)
    assert rounds.losses == pytest.approx(plain.evaluateEachIteration(valid.withColumn("w", F.lit(1.0))), rel=1e-6)
    assert scores(rounds.model(2), valid) == pytest.approx(scores(ML.gbt(preset, 2).fit(fitted), valid), rel=1e-6)


def test_no_row_is_scored_by_a_model_that_saw_it(table):
    """Each base model knows the keys it was fitted on: a row's meta-features never come from one that holds its key."""
    from pyspark.ml.classification import LogisticRegression
    seen = {}

    def watched(name):
        def fit(rows):
            keys, folds = zip(*[(r["row_key"], r["fold"]) for r in rows.select("row_key", "fold").collect()])
            missing = ({0, 1, 2} - set(folds)).pop()
            seen[name, missing] = set(keys)
            return LogisticRegression(labelCol="__y", regParam=0.1).fit(rows)
        return fit

    wide = ML.oof_matrix(table, ["a", "b", "c"], {"one": watched("one"), "two": watched("two")}, k=3).collect()
    assert len(wide) == N and len(seen) == 6
    for r in wide:
        assert all(r["row_key"] not in seen[name, r["fold"]] and 0 < r[name] < 1 for name in ("one", "two"))


def test_stack_on_out_of_fold_scores(table):
    out = ML.stacking_oof(table, ["a", "b", "c"], {k: v for k, v in ML.base_fits(rounds=3).items() if k != "gbt_b"}, k=3).collect()
    assert len(out) == N and {r["fold"] for r in out} == {0, 1, 2}
    pos, neg = ([r["p_stack"] for r in out if r["clicked"] == y] for y in (1, 0))
    assert sum(p > n for p in pos for n in neg) / (len(pos) * len(neg)) > 0.7


def test_same_seed_same_folds(table, cv):
    _, again = ML.cross_validate(table.repartition(7), ["a", "b", "c"], k=3, max_iter=1)
    want = {r["row_key"]: r["fold"] for r in cv[1].collect()}
    assert {r["row_key"]: r["fold"] for r in again.collect()} == want


def test_refit_rounds(spark):
    d = spark.createDataFrame([(0, 3), (1, 6)], "fold int, best_iteration int")
    assert ML.refit_rounds(d) in (4, 5)
    assert ML.refit_rounds(d.withColumn("best_iteration", F.lit(0))) == ML.DEFAULT_ROUNDS


def test_comparison_reports_a_failed_model(table):
    def broken(train, valid):
        raise ArithmeticError("no fit")

    rows = {r["model"]: r for r in ML.compare_models(table, ["a", "b", "c"], max_iter=3, extra={"broken": broken}).collect()}
    assert set(rows) == {"gbt_a", "gbt_b", "logistic", "broken"}
    assert rows["broken"]["error"] == "ArithmeticError: no fit" and rows["broken"]["auc"] == 0.5
    assert all(rows[m]["error"] is None and rows[m]["auc"] > 0.6 for m in ("gbt_a", "gbt_b", "logistic"))


def test_isotonic_calibration_is_monotone(cv):
    rows = sorted((r["p"], r["p_calibrated"], r["__y"]) for r in ML.isotonic_calibration(cv[1]).collect())
    assert len(rows) == N and all(x[1] <= y[1] + 1e-12 for x, y in zip(rows, rows[1:]))
    assert abs(sum(r[1] for r in rows) - sum(r[2] for r in rows)) < 1e-6


def test_stacking(spark, table):
    wide = table.select("row_key", F.col("__y").alias("clicked"), (F.col("a") / 10).alias("m1"), (F.col("b") / 10).alias("m2"))
    out = ML.stacking(wide, ["m1", "m2"]).collect()
    assert len(out) == N and all(0 <= r["p_stack"] <= 1 for r in out)
    one = {r["row_key"]: r["p_stack"] for r in ML.stacking(wide, ["m1"]).collect()}
    assert all(one[r["row_key"]] == r["m1"] for r in wide.collect())


def test_training_run_end_to_end(spark):
    import __spark_entry__ as E
    from clickforge.sources import views as V
    sf = "/root/testdata/sf0.001"
    out = E.queries()["trained_submission"](spark, sf).collect()
    _, te = V.split_train_test(V.impressions(spark, sf))
    assert sorted(r["ID"] for r in out) == [f"TEST_{i:07d}" for i in range(te.count())]
    assert all(0 < r["clicked"] < 1 for r in out)
    assert abs(sum(r["clicked"] for r in out) / len(out) - 0.0191) < 0.001


def test_request_model_in_batch_and_stream(spark):
    import __spark_entry__ as E
    from clickforge.sources import views as V
    sf, q = "/root/testdata/sf0.001", E.queries()
    pick = ["event_id", "success", "ctr_prediction", "recommendation"]
    batch = sorted(tuple(r) for r in q["request_model_scores"](spark, sf).select(pick).collect())
    stream = sorted(tuple(r) for r in q["stream_model_scores"](spark, sf).select(pick).collect())
    assert len(batch) == len(stream) > 0
    assert all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 for x, y in zip(batch, stream))
    req = V.requests(spark, sf)
    model, names = ML.fit_request_model(req)
    lost = req.limit(3).withColumn("user_id", F.lit(None).cast("string"))
    out = ML.score_requests(lost, model, names).collect()
    assert all(not r["success"] and r["error"] and r["ctr_prediction"] == 0.0201 for r in out)


def test_rounds_are_grown_by_few_fits(table, monkeypatch):
    """Not one fit, with its own binning and scans, a round."""
    asked, own = [], ML.gbt
    monkeypatch.setattr(ML, "gbt", lambda preset, n, *a, **k: asked.append(n) or own(preset, n, *a, **k))
    rounds = ML.Boosting(flagged(table), ML.GBT_B)
    assert rounds.run(max_iter=5, patience=4) <= 5 and len(rounds.trees) == len(rounds.losses) == 5
    assert asked == [5]


def test_boosting_without_validation_rows(table):
    data = flagged(table).withColumn(ML.VALID, F.lit(False))
    model, losses, best = ML.boost(data, ML.GBT_B, max_iter=9, patience=3)
    assert best == 0 and losses == [float("inf")] * 3 and model.getNumTrees == 1


def test_training_rows_are_computed_once(spark):
    """Every pass of the training jobs reads the written features."""
    from clickforge.plans import queries as Q
    _, rows, _ = Q._train_features(spark, "/root/testdata/sf0.001")
    assert rows.shared_path and rows.count() > 0


def test_shared_steps_are_written_once(spark, monkeypatch):
    """the stack's scores; F7: the features of the earlier requests."""
    from clickforge.plans import queries as Q
    written, own = [], Q.materialize_table
    monkeypatch.setattr(Q, "materialize_table", lambda d: written.append(set(d.columns)) or own(d))
    assert {r["model"] for r in Q.REGISTRY["stacking_ensemble"](spark, "/root/testdata/sf0.001").collect()} == {"stacking", "dynamic", "main"}
    Q._request_model(spark, "/root/testdata/sf0.001")
    assert any("p_stack" in c for c in written) and any("user_hash" in c for c in written)


def jobs(spark, group, f):
    spark.sparkContext.setJobGroup(group, group)
    out = f()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_a_fit_is_few_jobs(spark, table):
    """Not a job for each level of each tree."""
    data = flagged(table)
    fits = {"stopped": lambda: ML.boost(data, ML.GBT_A, max_iter=40, patience=40)[0],  # F1, F2, F3, F5
            "refit": lambda: ML.refit(table, ["a", "b", "c"], 40),  # F1, F5
            "stacked": lambda: ML.base_fits(rounds=40)["gbt_b"](data.drop(ML.VALID))}  # F4
    for name, fit in fits.items():
        model, n = jobs(spark, f"few-{name}", fit)
        assert model.getNumTrees <= 40 and n < 20, (name, n)


def test_fits_of_all_rows_are_the_librarys(table):
    """the refit and the stack's base models."""
    data = flagged(table).drop(ML.VALID)
    for own in (ML.refit(table, ["a", "b", "c"], 8, ML.GBT_A), ML.base_fits(rounds=8)["gbt_a"](ML.with_weights(data, 4.0))):
        plain = ML.gbt(ML.GBT_A, 8).fit(data)
        assert own.getNumTrees == 8 and own.numFeatures == 3
        assert scores(own, data) == pytest.approx(scores(plain, data), rel=1e-6)


def test_many_rows_give_the_librarys_scores(table, monkeypatch):
    """Siblings taken from their parent, and no split on rounding: other nodes, the same scores."""
    monkeypatch.setattr(ML.B, "EXACT_ROWS", 0)
    data = flagged(table)
    rounds = ML.Boosting(data, ML.GBT_B)
    rounds.grow(10)
    plain = ML.gbt(ML.GBT_B, 10).fit(data.where(~F.col(ML.VALID)))
    assert scores(rounds.model(3), data) == pytest.approx(scores(ML.gbt(ML.GBT_B, 3).fit(data.where(~F.col(ML.VALID))), data), rel=1e-6)
    assert rounds.losses == pytest.approx(plain.evaluateEachIteration(data.where(ML.VALID).withColumn("w", F.lit(1.0))), rel=0.02)


def test_several_tasks_grow_one_model(table, monkeypatch):
    """Rows dealt to tasks of a barrier stage, which exchange histograms."""
    monkeypatch.setattr(ML.B, "EXACT_ROWS", 0)
    one = ML.Boosting(flagged(table), ML.GBT_B)
    one.grow(6)
    monkeypatch.setattr(ML.B, "TASK_ROWS", 150)
    three = ML.Boosting(flagged(table), ML.GBT_B)
    three.grow(6)
    assert three.losses[:3] == pytest.approx(one.losses[:3], rel=1e-6) and three.losses == pytest.approx(one.losses, rel=0.02)


def test_row_stats_skip_what_is_missing(spark):
    from clickforge.functions import exprs as X
    nan = float("nan")
    d = spark.createDataFrame([(1, 1.0, 4.0, None), (2, None, nan, None), (3, 2.0, None, nan), (4, 1.0, 2.0, 6.0)], "i int, a double, b double, c double")
    rows = {r["i"]: tuple(r)[4:] for r in X.with_row_stats(d, {"g": ["a", "b", "c"]}).collect()}
    assert rows[1] == (2.5, pytest.approx(4.5 ** 0.5), 4.0, 1.0) and rows[2] == (None,) * 4 and rows[3] == (2.0, None, 2.0, 2.0)
    assert rows[4] == (3.0, pytest.approx(7.0 ** 0.5), 6.0, 1.0)


def test_kept_scores_are_the_best_rounds(table):
    """F1, F2: the out-of-fold scores need no model of all rounds on the driver."""
    rounds = ML.Boosting(flagged(table), ML.GBT_A)
    best = rounds.run(max_iter=20, patience=3)
    own = {r["row_key"]: r["p"] for r in rounds.validated().collect()}
    valid = rounds.data.where(ML.VALID)
    want = {r["row_key"]: r["p"] for r in ML.positive_probability(rounds.model(best).transform(valid)).collect()}
    bare = ML.Boosting(flagged(table), ML.GBT_A)
    assert bare.run(max_iter=20, patience=3, trees=False) == best and bare.losses == rounds.losses
    assert {r["row_key"]: r["p"] for r in bare.validated().collect()} == own
    assert len(rounds.losses) > best and own.keys() == want.keys() and all(abs(own[k] - want[k]) < 1e-12 for k in want)


def test_what_the_library_refuses_is_refused(table):
    data = flagged(table)
    for bad in (data.withColumn("__y", F.when(F.col("row_key") != "k0007", F.col("__y"))), data.withColumn("w", F.lit(-1.0))):
        with pytest.raises(Exception, match="MUST NOT"):
            ML.boost(bad, ML.GBT_B, max_iter=2)

"""Score ranges of the trained pieces; training itself has no exact expectation."""

import re
import threading

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tarnfold.operators import ensemble, metrics, models, windows
from tarnfold.plans import QUERIES, model_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def signal(spark):
    """Four classes; two noisy coordinates carry the label."""
    base = spark.range(400).select(
        "id",
        (F.col("id") % 4).cast("int").alias("y"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("u"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000.0).alias("v"),
    )
    features = F.array(F.col("y") % 2 + F.col("u"), F.floor(F.col("y") / 2) + F.col("v"))
    df = base.select("id", "y", array_to_vector(features.cast("array<double>")).alias("features"))
    return windows.stratified_folds(df.withColumn("weight", F.lit(1.0)), "y", 3)


def report(held):
    return metrics.classification_report(held.withColumn("pred", ensemble.weighted_argmax("proba", [1.0] * 4))).first()


@pytest.mark.parametrize(
    "factory",
    [
        lambda: models.make_rf(10, 5),
        lambda: models.make_extra_trees(10, 5),
        lambda: models.make_lr(0.01),
        lambda: models.OneVsRestGBT(4, lambda: models.make_gbt(3, 3, columns="all")),
    ],
)
def test_out_of_fold_predictions(signal, factory):
    test = signal.select("id", "features")
    held, scored = models.cross_val_predict(factory, signal, test=test)
    assert held.count() == 400 and held.select("id").distinct().count() == 400
    totals = held.union(scored.select(*[c for c in scored.columns][:0], "*").withColumns({"y": F.lit(0), "weight": F.lit(1.0), "fold": F.lit(0)}).select(held.columns))
    worst = totals.select(F.max(F.abs(F.aggregate("proba", F.lit(0.0), lambda a, v: a + v) - 1))).first()[0]
    assert worst < 1e-9
    assert report(held).accuracy > 0.8


def test_roster_and_pseudo_labels(signal):
    roster = {"rf": lambda: models.make_rf(5, 4), "lr": lambda: models.make_lr(0.01)}
    oof, _ = models.cross_val_roster(roster, signal)
    assert oof.count() == 400 and {"p_rf", "p_lr"} <= set(oof.columns)
    train, test = signal.filter("fold <> 0"), signal.filter("fold = 0").select("id", "features")
    grid = ensemble.weight_grid([0.9, 1.0], [1.0], [1.0], [1.0])
    result = models.pseudo_label_loop(roster, train, test, grid, rounds=((0.7, 2), (0.6, 1)), folds=2)
    assert result.predictions.count() == test.count()
    assert result.train.count() == train.count() + sum(result.rounds)
    truth = result.predictions.join(signal.select("id", "y"), "id")
    assert truth.filter("y = pred").count() / test.count() > 0.8
    none = models.pseudo_label_loop(roster, train, test, grid, rounds=((1.1, 2), (0.6, 1)), folds=2)
    assert none.rounds == [0] and none.train.count() == train.count()


def test_stacking_is_no_worse_than_its_parts(spark):
    auc = {n: QUERIES[n](spark, SF).first().auc for n in ("stack_lr", "stack_lr_in_sample", "stack_ridge")}
    assert all(0.5 < v <= 1.0 for v in auc.values())


def test_importances_are_sorted(signal):
    model = models.make_rf(5, 4).fit(signal)
    ranked = models.importances(model, ["a", "b"])
    assert ranked[0][1] >= ranked[1][1] > 0
    assert len(models.importances(models.make_lr().fit(signal), ["a", "b"])) == 2


def test_drawn_cuts_differ_by_tree(signal):
    model = models.ExtraTrees(trees=8, depth=4, cuts=16).fit(signal)
    assert model.drawn.shape == (2, 16) and len(set(model.drawn.ravel())) == 32
    used = [frozenset(map(int, re.findall(r"feature (\d+)", t.toDebugString))) for t in model.forest.trees]
    assert len(set(used)) >= 4 and all(f < 32 for u in used for f in u)


def test_boosting_keeps_the_best_rounds(signal):
    binary = signal.withColumn("y", (F.col("y") % 2).cast("double"))
    factory = lambda n=8: models.make_gbt(n, 2, columns="all")
    told = []
    model = models.EarlyStoppedGBT(factory, share=0.25, report=told.append).fit(binary)
    assert told == [model.getNumTrees] and 1 <= told[0] <= 8
    # cut off behind a round, a model is what fewer rounds would have made
    full, short = factory().fit(binary), factory(3).fit(binary)
    cut = models.first_rounds(full, 3)
    both = [{r.id: r.proba[1] for r in models.predict(m, binary.select("id", "features")).collect()} for m in (cut, short)]
    assert both[0].keys() == both[1].keys() and all(both[0][k] == pytest.approx(both[1][k], abs=1e-9) for k in both[0])


@pytest.mark.parametrize("l2", [1.0, 0.01])
def test_newton_steps_end_at_the_optimum(spark, l2):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1.0, 5.0, 0.2]
    y = (x @ [1.0, -0.5, 3.0] + rng.logistic(size=300) > 0.5).astype(int)
    rows = [(i, int(y[i]), i % 4, *map(float, x[i])) for i in range(300)] + [(300, 1, 0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, a double, b double, c double")
    model = models.newton_logistic(df, ["a", "b", "c"], fold="fold", l2=l2)
    assert sorted(model.weights) == [0, 1, 2, 3]
    for k, w in model.weights.items():
        seen = np.arange(300) % 4 != k
        design = np.column_stack([np.ones(seen.sum()), x[seen]])
        p = 1 / (1 + np.exp(-design @ w))
        assert np.abs(design.T @ (y[seen] - p) - l2 * np.array([0, *w[1:]])).max() < 1e-6
    held = {r.id: r.s for r in model.score(df, "s").collect()}
    for i in (0, 17, 299):
        assert held[i] == pytest.approx(1 / (1 + np.exp(-np.dot(model.weights[i % 4], [1, *x[i]]))))
    assert held[300] is None


@pytest.mark.parametrize("train", ["cross_val_predict", "cross_val_roster", "fit_final"])
def test_fits_scan_as_many_parts_as_there_are_cores(spark, signal, train):
    parts = []

    class Spy:
        def fit(self, df):
            parts.append(df.rdd.getNumPartitions())
            return models.make_lr(0.01).fit(df)

    few = signal.coalesce(1)
    if train == "cross_val_predict":
        models.cross_val_predict(Spy, few)
    elif train == "cross_val_roster":
        models.cross_val_roster({"a": Spy}, few)
    else:
        models.fit_final(Spy, few, signal.select("id", "features"))
    assert parts and min(parts) >= spark.sparkContext.defaultParallelism


def test_compare_params_fits_all_sets_and_folds_side_by_side(spark, signal):
    rows = signal.withColumn("y", (F.col("y") == 3).cast("int"))
    meet, parts = threading.Barrier(6), []

    class Spy:
        def __init__(self, reg):
            self.reg = reg

        def fit(self, df):
            parts.append(df.rdd.getNumPartitions())
            meet.wait(60)  # breaks unless all six fits are under way
            return models.make_lr(self.reg).fit(df)

    regs = {"free": 0.0, "firm": 0.5}
    board = models.compare_params({n: lambda r=r: Spy(r) for n, r in regs.items()}, rows)
    assert len(parts) == 6 and sum(parts) >= spark.sparkContext.defaultParallelism and max(parts) <= 2
    got = {r.config: r for r in board.collect()}
    assert set(got) == set(regs)
    for name, reg in regs.items():
        held, _ = models.cross_val_predict(lambda: models.make_lr(reg), rows)  # noqa: B023
        want = metrics.ranking_scores(held.withColumn("score", F.get("proba", 1)), "y", "score").first()
        assert got[name].auc == pytest.approx(want.auc, abs=1e-6) and got[name].ap == pytest.approx(want.ap, abs=1e-6)


def test_compare_params_on_a_large_table_has_a_part_for_every_core(spark, signal, monkeypatch):
    monkeypatch.setattr(models, "FIT_ROWS", 10)
    rows, ids, at_once = models._stored_for_fits(signal.coalesce(1), "fold", 2)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert (ids, at_once, rows.count()) == ([0, 1, 2], models.AT_ONCE, 400)


def test_plant_features_search_neighbours_once(spark, monkeypatch):
    seen, search = spark.sparkContext.accumulator(0), model_queries.geo.neighbor_features

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(model_queries.geo, "neighbor_features", lambda *a, **k: (out := search(*a, **k)).mapInArrow(count, out.schema))
    features = model_queries._plant_features(spark, SF)
    assert seen.value == features.count() > 0

"""Cross-validated Spark ML models, stacking and the pseudo-label loop."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    HashingTF,
    IDF,
    IndexToString,
    NGram,
    RegexTokenizer,
    StringIndexer,
    UnivariateFeatureSelector,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tarnfold.functions.columns import clip01
from tarnfold.operators.encode import append_pseudo, class_weight_col, union_rows
from tarnfold.operators.ensemble import (
    average_proba,
    best_class_weights,
    blend,
    pseudo_labels,
    weighted_argmax,
)
from tarnfold.operators.metrics import ranking_scores
from tarnfold.operators.windows import stratified_folds, stratified_split
from tarnfold.session import cut_lineage

FEATURES, LABEL, WEIGHT = "features", "y", "weight"
Factory = Callable[[], Estimator]
# Fits that run side by side over a large table.
AT_ONCE = 4
# Rows that one task of a fit may as well scan alone where other fits use the other cores.
FIT_ROWS = 100_000


def make_rf(trees: int = 200, depth: int = 10, min_leaf: int = 3, weight: str | None = WEIGHT, **more) -> Estimator:
    est = RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, seed=42, **more,
    )
    return est.setWeightCol(weight) if weight else est


@dataclass
class ExtraTrees:
    """Extremely randomised trees: cut points are drawn from each column's range, not searched for.

    Every column gets ``cuts`` uniform draws, each a 0/1 column "greater than the draw". A node looks at as many of
    these, picked at random, as the square root of the number of columns, and takes the best: so every node of every tree has
    cut points of its own. All rows train every tree.
    """

    trees: int = 200
    depth: int = 12
    min_leaf: int = 2
    cuts: int = 16
    seed: int = 42
    weight: str | None = WEIGHT

    def fit(self, df: DataFrame) -> "ExtraTreesModel":
        span = df.select(Summarizer.metrics("min", "max").summary(F.col(FEATURES)).alias("s")).first().s
        low, high = span["min"].toArray(), span["max"].toArray()
        drawn = np.sort(np.random.default_rng(self.seed).uniform(low[:, None], high[:, None], (len(low), self.cuts)), axis=1)
        forest = RandomForestClassifier(
            featuresCol="_cuts", labelCol=LABEL, numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=self.min_leaf,
            featureSubsetStrategy=str(max(1, math.ceil(math.sqrt(len(low))))), bootstrap=False, seed=self.seed,
        )
        if self.weight:
            forest = forest.setWeightCol(self.weight)
        return ExtraTreesModel(forest.fit(_over_cuts(df, drawn)), drawn)


@dataclass
class ExtraTreesModel:
    forest: Model
    drawn: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        return self.forest.transform(_over_cuts(df, self.drawn)).drop("_cuts")


def _over_cuts(df: DataFrame, drawn: np.ndarray) -> DataFrame:
    cuts = F.from_json(F.lit(json.dumps(drawn.tolist())), "array<array<double>>")
    over = F.zip_with(vector_to_array(FEATURES), cuts, lambda x, cs: F.transform(cs, lambda c: (x > c).cast("double")))
    return df.withColumn("_cuts", array_to_vector(F.flatten(over)))


def make_extra_trees(trees: int = 200, depth: int = 12, min_leaf: int = 2, **more) -> ExtraTrees:
    return ExtraTrees(trees, depth, min_leaf, **more)


def make_gbt(
    iterations: int = 150, depth: int = 6, rate: float = 0.1, rows: float = 0.8,
    columns: str = "0.8", validation: str | None = None, weight: str | None = None,
) -> Estimator:
    est = GBTClassifier(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=iterations, maxDepth=depth, stepSize=rate,
        subsamplingRate=rows, featureSubsetStrategy=columns, seed=42,
    )
    if validation:
        est = est.setValidationIndicatorCol(validation)
    return est.setWeightCol(weight) if weight else est


@dataclass
class EarlyStoppedGBT:
    """Boosting that keeps the rounds up to the least loss on rows of its own that it did not train on.

    ``share`` of every class is held back by the hash of ``key``. The loss after every round comes from one pass over
    those rows, and the trees behind the best round are cut off. ``report`` is told the number of rounds kept.
    """

    factory: Callable[[], GBTClassifier]
    share: float = 0.1
    key: str = "id"
    report: Callable[[int], None] | None = None

    def fit(self, df: DataFrame) -> GBTClassificationModel:
        split = stored_evenly(stratified_split(df, LABEL, self.share, self.key))
        model = self.factory().fit(split.filter("split = 'train'"))
        losses = model.evaluateEachIteration(split.filter("split = 'test'"))
        best = losses.index(min(losses)) + 1 if losses and not any(map(math.isnan, losses)) else model.getNumTrees
        if self.report:
            self.report(best)
        return first_rounds(model, best)


def first_rounds(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model that boosting would have been after ``n`` rounds."""
    context = SparkContext._active_spark_context
    ml = context._jvm.org.apache.spark.ml
    trees, weights = model._java_obj.trees(), model._java_obj.treeWeights()
    some = context._gateway.new_array(ml.regression.DecisionTreeRegressionModel, n)
    shares = context._gateway.new_array(context._jvm.double, n)
    for i in range(n):
        some[i], shares[i] = trees[i], weights[i]
    short = GBTClassificationModel(ml.classification.GBTClassificationModel(model.uid, some, shares))
    return short.setFeaturesCol(FEATURES)


def make_lr(reg: float = 0.0, weight: str | None = WEIGHT, iterations: int = 200) -> Estimator:
    est = LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, family="auto", regParam=reg, maxIter=iterations
    )
    return est.setWeightCol(weight) if weight else est


@dataclass
class OneVsRestGBT:
    """Boosted trees for several classes: one binary model each, probabilities normalised."""

    classes: int
    factory: Factory

    def fit(self, df: DataFrame) -> "OneVsRestModel":
        def one(c: int) -> Model:
            return self.factory().fit(df.withColumn(LABEL, (F.col(LABEL) == c).cast("double")))

        return OneVsRestModel(_in_parallel(one, range(self.classes)))


@dataclass
class OneVsRestModel:
    models: list

    def transform(self, df: DataFrame) -> DataFrame:
        out, names = df, []
        for c, model in enumerate(self.models):
            name = f"_ovr{c}"
            scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_p").transform(out)
            out = scored.withColumn(name, F.get(vector_to_array("_p"), 1)).drop("_p")
            names.append(name)
        total = sum((F.col(n) for n in names), F.lit(0.0))
        share = F.array(*[F.col(n) / total for n in names])
        return out.withColumn("probability", array_to_vector(share)).drop(*names)


def _in_parallel(work: Callable, items: Sequence, at_once: int = AT_ONCE) -> list:
    """Run independent fits side by side from the driver, as Spark's own CrossValidator does."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(work, items))


def stored_evenly(df: DataFrame) -> DataFrame:
    """Stored once for many fits, in at least as many parts as there are cores.

    A shuffle leaves a small table in one or two parts, and then a fit, which scans it hundreds of times, has that many tasks.
    """
    stored = cut_lineage(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return stored if stored.rdd.getNumPartitions() >= cores else cut_lineage(stored.repartition(cores))


def _stored_for_fits(df: DataFrame, fold: str, sets: int) -> tuple[DataFrame, list, int]:
    """The table stored once for ``sets`` cross-validations together, its folds, and how many fits to run side by side.

    A fit is hundreds of short jobs, which cost more by their tasks than by the rows of a small table. So a small table has
    few parts and many fits at once keep the cores busy; a large one has at least as many parts as there are cores.
    """
    stored = cut_lineage(df)
    sizes = stored.groupBy(fold).count().orderBy(fold).collect()
    ids = [r[0] for r in sizes]
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(sum(r[1] for r in sizes) / FIT_ROWS), math.ceil(cores / max(1, sets * len(ids))))
    if parts >= cores:
        return stored_evenly(stored), ids, AT_ONCE
    return cut_lineage(stored.repartition(parts)), ids, max(AT_ONCE, 2 * cores // parts)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="keep").transform(df)


def predict(model, df: DataFrame, out: str = "proba") -> DataFrame:
    """Class-probability array of a fitted model; other model columns are dropped."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability").alias(out))


def cross_val_predict(
    factory: Factory,
    df: DataFrame,
    fold: str = "fold",
    test: DataFrame | None = None,
    out: str = "proba",
    folds: Sequence[int] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold probabilities for every row of ``df`` (columns y, features, fold), and
    the average of the fold models on ``test``. The input is materialised once."""
    df = stored_evenly(df)
    ids = list(folds) if folds is not None else [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    models = _in_parallel(lambda i: factory().fit(df.filter(F.col(fold) != i)), ids)
    held = union_rows(*[predict(m, df.filter(F.col(fold) == i), out) for i, m in zip(ids, models)])
    if test is None:
        return held, None
    scored, names = test, [f"_fold{i}" for i in ids]
    for name, model in zip(names, models):
        scored = predict(model, scored, name)
    return held, scored.withColumn(out, average_proba(names)).drop(*names)


def cross_val_roster(
    roster: Mapping[str, Factory],
    df: DataFrame,
    fold: str = "fold",
    test: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """One out-of-fold table with a column ``p_<model>`` per model.

    The models of a fold score that fold one after the other in a single pass, so the
    columns need no join. ``test`` gets the fold models' average per model.
    """
    df = stored_evenly(df)
    ids = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    jobs = [(i, n) for i in ids for n in roster]
    fitted = dict(
        zip(jobs, _in_parallel(lambda j: roster[j[1]]().fit(df.filter(F.col(fold) != j[0])), jobs))
    )
    parts = []
    for i in ids:
        part = df.filter(F.col(fold) == i)
        for n in roster:
            part = predict(fitted[(i, n)], part, f"p_{n}")
        parts.append(part.drop(FEATURES))
    oof = cut_lineage(union_rows(*parts))
    if test is None:
        return oof, None
    for n in roster:
        names = [f"_fold{i}" for i in ids]
        for i, name in zip(ids, names):
            test = predict(fitted[(i, n)], test, name)
        test = test.withColumn(f"p_{n}", average_proba(names)).drop(*names)
    return oof, test.drop(FEATURES)


def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Feature importances or absolute coefficients, highest first."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = abs(model.coefficientMatrix.toArray()).max(axis=0)
    else:
        values = abs(model.coefficients.toArray())
    return sorted(zip(names, map(float, values)), key=lambda pair: (-pair[1], pair[0]))


def fit_final(factory: Factory, train: DataFrame, test: DataFrame, out: str = "proba") -> DataFrame:
    return predict(factory().fit(stored_evenly(train)), test, out)


def compare_params(
    factories: Mapping[str, Factory], df: DataFrame, fold: str = "fold", y: str = LABEL
) -> DataFrame:
    """Pooled out-of-fold ranking scores per parameter set: ``(config, auc, ap, composite)``.

    The fits of all sets and folds scan one stored table and run side by side.
    """
    df, ids, at_once = _stored_for_fits(df, fold, len(factories))
    jobs = [(name, i) for name in factories for i in ids]
    fitted = _in_parallel(lambda j: factories[j[0]]().fit(df.filter(F.col(fold) != j[1])), jobs, at_once)
    scored = [
        predict(model, df.filter(F.col(fold) == i)).select(F.lit(name).alias("config"), y, F.get("proba", 1).alias("score"))
        for (name, i), model in zip(jobs, fitted)
    ]
    return ranking_scores(cut_lineage(union_rows(*scored)), y, "score", ["config"])


def ablation(
    factory: Factory, df: DataFrame, feature_sets: Mapping[str, Sequence[str]], fold: str = "fold", y: str = LABEL
) -> DataFrame:
    """As :func:`compare_params`, one model over several column lists."""
    df = cut_lineage(df)
    scored = []
    for name, columns in feature_sets.items():
        held, _ = cross_val_predict(factory, assemble(df, columns), fold)
        scored.append(held.select(F.lit(name).alias("config"), y, F.get("proba", 1).alias("score")))
    return ranking_scores(cut_lineage(union_rows(*scored)), y, "score", ["config"])


def compare_rosters(
    oof: DataFrame, rosters: Mapping[str, Sequence[str]], y: str = LABEL, score: Callable | None = None
) -> DataFrame:
    """Score the mean of several subsets of models over one out-of-fold table."""
    rows = []
    for name, members in rosters.items():
        mixed = oof.withColumn("proba", average_proba([f"p_{m}" for m in members]))
        if score is None:
            one = ranking_scores(mixed.withColumn("score", F.get("proba", 1)), y, "score")
        else:
            one = score(mixed)
        rows.append(one.withColumn("config", F.lit(name)))
    return union_rows(*rows)


def _stacked(
    fit: Callable[[DataFrame, int], Model],
    score: Callable[[Model, DataFrame, str], DataFrame],
    train: DataFrame,
    out_of_fold: bool,
    fold: str,
    test: DataFrame | None,
) -> tuple[DataFrame, DataFrame | None]:
    """Fit on the rows outside each fold (and how many they are) and score the fold; the test
    table gets the average of the fold models. In-sample: one model that scores its own rows."""
    train = cut_lineage(train)
    sizes = {r[0]: r[1] for r in train.groupBy(fold if out_of_fold else F.lit(0).alias("all")).count().collect()}
    total = sum(sizes.values())
    if not out_of_fold:
        model = fit(train, total)
        return score(model, train, "stack"), None if test is None else score(model, test, "stack")
    ids = sorted(sizes)
    fitted = _in_parallel(lambda i: fit(train.filter(F.col(fold) != i), total - sizes[i]), ids)
    held = union_rows(*[score(m, train.filter(F.col(fold) == i), "stack") for i, m in zip(ids, fitted)])
    if test is None:
        return held, None
    names = [f"_fold{i}" for i in ids]
    for name, model in zip(names, fitted):
        test = score(model, test, name)
    return held, test.withColumn("stack", sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names)


@dataclass
class NewtonLogistic:
    """Logistic regression with squared penalty ``l2`` / 2 on the weights, one set of weights per held-out fold.

    ``weights[k]`` is the intercept and the weights of the model that did not see fold ``k`` (None: all rows).
    """

    columns: list[str]
    fold: str | None
    weights: dict
    steps: int

    def score(self, df: DataFrame, out: str, held_out: bool = True) -> DataFrame:
        """Probability by the model that did not see the row's fold, or by the mean of all models."""
        by_fold = {k: _sigmoid(self.columns, w) for k, w in self.weights.items()}
        if not held_out or self.fold is None:
            return df.withColumn(out, sum(by_fold.values(), F.lit(0.0)) / len(by_fold))
        value = F.lit(None).cast("double")
        for k, p in by_fold.items():
            value = F.when(F.col(self.fold).eqNullSafe(F.lit(k)), p).otherwise(value)
        return df.withColumn(out, value)


def _sigmoid(columns: Sequence[str], weights: Sequence[float]) -> Column:
    z = F.lit(float(weights[0]))
    for c, w in zip(columns, weights[1:]):
        z = z + F.col(c) * F.lit(float(w))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def newton_logistic(
    df: DataFrame, columns: Sequence[str], y: str = LABEL, fold: str | None = None, l2: float = 1.0, tol: float = 1e-10, most: int = 50
) -> NewtonLogistic:
    """The exact optimum for all folds at once by Newton steps.

    Each step is one scan: a task adds up gradient, loss and Gram matrix of its rows for every fold's model, and the sums
    (folds by columns squared, however many rows) meet in the driver, which solves the small systems. A step that does
    not lower a fold's loss is halved. Rows with a missing value take no part.
    """
    names = [*columns, y, *([fold] if fold else [])]
    rows = cut_lineage(df.select(*names).dropna())
    ids = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()] if fold else [None]
    p = len(columns) + 1
    upper = [(i, j) for i in range(p) for j in range(i, p)]

    def sums(trial: dict) -> dict:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, gradient, gram = np.zeros(len(ids)), np.zeros((len(ids), p)), np.zeros((len(ids), p, p))
            for batch in batches:
                values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
                x = np.column_stack([np.ones(batch.num_rows), *[v.astype(float) for v in values[: p - 1]]])
                label = values[p - 1].astype(float)
                for n, k in enumerate(ids):
                    seen = values[p] != k if fold else np.ones(len(label), bool)
                    xs, z = x[seen], x[seen] @ trial[k]
                    e = 1.0 / (1.0 + np.exp(-z))
                    loss[n] += np.sum(np.logaddexp(0, z) - label[seen] * z)
                    gradient[n] += xs.T @ (label[seen] - e)
                    gram[n] += (xs * (e * (1 - e))[:, None]).T @ xs
            flat = np.column_stack([loss, gradient, gram[:, [i for i, _ in upper], [j for _, j in upper]]])
            at = np.indices(flat.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[0].ravel()), pa.array(at[1].ravel()), pa.array(flat.ravel())], names=["model", "at", "value"]
            )

        got = rows.mapInArrow(add, "model long, at long, value double").groupBy("model", "at").agg(F.sum("value").alias("value")).collect()
        table = np.zeros((len(ids), 1 + p + len(upper)))
        for r in got:
            table[r.model, r.at] = r.value
        out = {}
        ridge = np.diag([0.0] + [l2] * (p - 1))
        for n, k in enumerate(ids):
            w, gram = trial[k], np.zeros((p, p))
            for (i, j), v in zip(upper, table[n, 1 + p :]):
                gram[i, j] = gram[j, i] = v
            out[k] = (table[n, 0] + 0.5 * w @ ridge @ w, table[n, 1 : 1 + p] - ridge @ w, gram + ridge)
        return out

    best = {k: np.zeros(p) for k in ids}
    trial, low, turn, steps = dict(best), {k: np.inf for k in ids}, {}, 0
    while steps < most:
        steps += 1
        for k, (loss, gradient, gram) in sums(trial).items():
            if loss <= low[k] + 1e-9 * abs(loss):
                best[k], low[k] = trial[k], min(loss, low[k])
                turn[k] = np.linalg.lstsq(gram, gradient, rcond=None)[0]
            else:
                turn[k] = turn[k] / 2
            trial[k] = best[k] + turn[k]
        if max(np.abs(t).max() for t in turn.values()) < tol:
            break
    return NewtonLogistic(list(columns), fold, {k: trial[k].tolist() for k in ids}, steps)


def stack_lr(
    oof: DataFrame,
    scores: Sequence[str],
    out_of_fold: bool = True,
    fold: str = "fold",
    test: DataFrame | None = None,
    c: float | None = 1.0,
) -> tuple[DataFrame, DataFrame | None]:
    """Logistic regression over model scores; in-sample scoring is kept as an option.

    The squared weights cost 1 / (2c) in the sum of the rows' losses, unscaled; ``c=None`` leaves them free. Out of
    fold, the test table gets the mean of the folds' models.
    """
    model = newton_logistic(oof, scores, LABEL, fold if out_of_fold else None, 0.0 if c is None else 1.0 / c)
    held = model.score(oof, "stack")
    return held, None if test is None else model.score(test, "stack", held_out=False)


def stack_ridge(
    oof: DataFrame,
    scores: Sequence[str],
    alpha: float = 1.0,
    out_of_fold: bool = True,
    fold: str = "fold",
    test: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Ridge on unscaled scores, clipped to [0, 1].

    ``alpha`` is per table; Spark's penalty is per row and divided by the label's deviation.
    """

    def fit(rows: DataFrame, n: int) -> Model:
        deviation = rows.agg(F.stddev_pop(LABEL)).first()[0] or 0.0
        return LinearRegression(
            featuresCol=FEATURES, labelCol=LABEL, elasticNetParam=0.0, standardization=False,
            regParam=alpha * deviation / max(n, 1), predictionCol="_raw", solver="normal",
        ).fit(rows)

    def score(model: Model, rows: DataFrame, name: str) -> DataFrame:
        return model.transform(rows).withColumn(name, clip01("_raw")).drop("_raw")

    held, scored = _stacked(
        fit, score, assemble(oof, scores), out_of_fold, fold, None if test is None else assemble(test, scores)
    )
    return held.drop(FEATURES), None if scored is None else scored.drop(FEATURES)


def choose_ensemble(oof: DataFrame, candidates: Mapping[str, str], y: str = LABEL) -> DataFrame:
    """Scores of several ready score columns side by side, to pick from with ``choose_best``."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("config_id"), F.lit(n).alias("config"), F.col(c).alias("score"))
            for i, (n, c) in enumerate(candidates.items())
        ]
    )
    return ranking_scores(oof.select(y, F.inline(cells)), y, "score", ["config_id", "config"])


def fixed_blend(oof: DataFrame, scores: Sequence[str], weights: Sequence[float], out: str = "blend") -> DataFrame:
    return oof.withColumn(out, blend(scores, weights))


@dataclass
class PseudoLabelResult:
    predictions: DataFrame
    train: DataFrame
    weights: list[list[float]]
    rounds: list[int]


def pseudo_label_loop(
    roster: Mapping[str, Factory],
    train: DataFrame,
    test: DataFrame,
    grid: Sequence[Sequence[float]],
    rounds: Sequence[tuple[float, int]] = ((0.92, 6), (0.88, 5), (0.85, 4)),
    folds: int = 3,
    key: str = "id",
) -> PseudoLabelResult:
    """Grow the training table with confident test rows, re-tuning class weights in between.

    ``train`` has (key, y, features), ``test`` (key, features). Every round materialises
    the grown table; a test row may be taken again in a later round.
    """
    columns = [key, LABEL, FEATURES]
    current = cut_lineage(train.select(*columns))

    def tuned(table: DataFrame) -> list[float]:
        folded = stratified_folds(class_weight_col(table, LABEL), LABEL, folds, key=key)
        oof, _ = cross_val_roster(roster, folded)
        mean = average_proba([f"p_{n}" for n in roster])
        return list(best_class_weights(oof.select(LABEL, mean.alias("proba")), grid).first()["weights"])

    weights, grown, history = tuned(current), [], []
    history.append(weights)
    for i, (confidence, agree) in enumerate(rounds):
        scored = _score_roster(roster, current, test)
        names = [f"p_{n}" for n in roster]
        picked = cut_lineage(
            pseudo_labels(scored, names, weights, confidence, agree, LABEL).select(*columns)
        )
        n = picked.count()
        grown.append(n)
        if n == 0:
            break
        current = cut_lineage(append_pseudo(current, picked))
        if i < len(rounds) - 1:
            weights = tuned(current)
            history.append(weights)
    scored = _score_roster(roster, current, test)
    final = scored.withColumn("proba", average_proba([f"p_{n}" for n in roster]))
    final = final.withColumn("pred", weighted_argmax("proba", weights)).select(key, "proba", "pred")
    return PseudoLabelResult(final, current, history, grown)


def _score_roster(roster: Mapping[str, Factory], train: DataFrame, test: DataFrame) -> DataFrame:
    weighted = stored_evenly(class_weight_col(train, LABEL))
    models = _in_parallel(lambda n: roster[n]().fit(weighted), list(roster))
    scored = test
    for name, model in zip(roster, models):
        scored = predict(model, scored, f"p_{name}")
    return cut_lineage(scored)


def text_vectors(
    text: str = "text", label: str = "label", buckets: int = 1 << 16, ngrams: int = 2
) -> Pipeline:
    """Hashed counts of words and n-grams, as one sparse vector ``_counts``, and the label's number ``_y``."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)[^\p{L}\p{N}]+")
    stages: list = [
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip"),
        words,
    ]
    for n in range(1, ngrams + 1):
        stages += [
            NGram(n=n, inputCol="_words", outputCol=f"_grams{n}"),
            HashingTF(inputCol=f"_grams{n}", outputCol=f"_tf{n}", numFeatures=buckets),
        ]
    stages.append(VectorAssembler(inputCols=[f"_tf{n}" for n in range(1, ngrams + 1)], outputCol="_counts"))
    return Pipeline(stages=stages)


def text_learner(reg: float = 0.01, keep: int = 8192) -> Pipeline:
    """The ``keep`` counts that tell most about the label by chi-square, as TF-IDF, into a multinomial logistic regression."""
    chosen = UnivariateFeatureSelector(featuresCol="_counts", outputCol="_chosen", labelCol="_y", selectionMode="numTopFeatures")
    chosen = chosen.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(keep)
    weighted = IDF(inputCol="_chosen", outputCol=FEATURES)
    return Pipeline(
        stages=[chosen, weighted, LogisticRegression(featuresCol=FEATURES, labelCol="_y", regParam=reg, maxIter=50, predictionCol="_pred")]
    )


def fit_text_classifier(
    df: DataFrame, text: str = "text", label: str = "label", buckets: int = 1 << 16, ngrams: int = 2, reg: float = 0.01, keep: int = 8192
) -> PipelineModel:
    """Fitted pipeline from text to ``predicted``, the label; the label list is in its last stage, so saving it saves both.

    Texts are split and hashed once; selection, weighting and regression scan the stored sparse vectors.
    """
    encoder = text_vectors(text, label, buckets, ngrams).fit(df)
    vectors = stored_evenly(encoder.transform(df).select("_y", "_counts"))
    learner = text_learner(reg, keep).fit(vectors)
    names = IndexToString(inputCol="_pred", outputCol="predicted", labels=encoder.stages[0].labels)
    return PipelineModel([*encoder.stages[1:], *learner.stages, names])

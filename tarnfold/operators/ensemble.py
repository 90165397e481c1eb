"""Probability averaging, blends, class-weight searches and decision rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarnfold.operators.joins import cross_grid, grid_literal
from tarnfold.operators.metrics import AP_SHARE, AUC_SHARE, confusion, f1_from_confusion, ranking_scores, weakest_two
from tarnfold.operators.stats import best_config, top


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weighted_proba(probas: Sequence[str | Column], weights: Sequence[float | Column]) -> Column:
    """Weighted mean of class-probability arrays."""
    factors = [w if isinstance(w, Column) else F.lit(float(w)) for w in weights]
    total = reduce(lambda a, b: a + b, factors)

    def scale(proba: str | Column, factor: Column) -> Column:
        return F.transform(_col(proba), lambda v: v * factor)

    scaled = [scale(p, w) for p, w in zip(probas, factors)]
    summed = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scaled)
    return F.transform(summed, lambda v: v / total)


def average_proba(probas: Sequence[str | Column]) -> Column:
    return weighted_proba(probas, [1.0] * len(probas))


def blend(scores: Sequence[str | Column], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [_col(s) * F.lit(float(w)) for s, w in zip(scores, weights)])


def weighted_argmax(proba: str | Column, weights: Sequence[float | Column]) -> Column:
    """Class with the highest weighted probability, the lowest index on ties (codegen only)."""
    p = _col(proba)
    scores = [
        F.get(p, i) * (w if isinstance(w, Column) else F.lit(float(w))) for i, w in enumerate(weights)
    ]
    highest = F.greatest(*scores)
    choice = F.when(scores[0] == highest, F.lit(0))
    for i, s in enumerate(scores[1:], start=1):
        choice = choice.when(s == highest, F.lit(i))
    return choice


def weight_grid(*axes: Sequence[float]) -> list[list[float]]:
    """Every combination, the first axis slowest; the place in the list breaks ties."""
    return [list(map(float, point)) for point in product(*axes)]


def class_weight_search(
    df: DataFrame,
    grid: Sequence[Sequence[float]],
    y: str = "y",
    proba: str = "proba",
    share_class: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """``weakest_two`` for every weight vector: ``(config_id, weights, score, share)``.

    Each row meets each vector inside the scan; what is shuffled is one confusion count
    per configuration and task. ``share`` is the predicted share of ``share_class``.
    """
    k = len(grid[0])
    configs = [{"config_id": i, "weights": list(w)} for i, w in enumerate(grid)]
    tried = cross_grid(df.select(*by, y, proba), configs)
    pred = weighted_argmax(proba, [F.get(F.col("weights"), i) for i in range(k)])
    counts = confusion(tried.withColumn("pred", pred), y, "pred", [*by, "config_id", "weights"])
    keys = [*by, "config_id", "weights"]
    per_class = f1_from_confusion(counts, keys, list(range(k)))
    scores = weakest_two(per_class, keys).withColumn("score", F.round("weakest_two", 12)).drop("weakest_two")
    if share_class is None:
        return scores
    shares = counts.groupBy(*by, "config_id").agg(
        (F.sum(F.when(F.col("pred") == share_class, F.col("n")).otherwise(0)) / F.sum("n")).alias("share")
    )
    return scores.join(shares, [*by, "config_id"])


def best_class_weights(df: DataFrame, grid, y: str = "y", proba: str = "proba") -> DataFrame:
    return best_config(class_weight_search(df, grid, y, proba), "score", "config_id")


def constrained_class_weights(
    df: DataFrame, grid, share_class: int, low: float, high: float, n: int = 5, y: str = "y", proba: str = "proba"
) -> DataFrame:
    """Best ``n`` vectors among those that give ``share_class`` between low and high."""
    tried = class_weight_search(df, grid, y, proba, share_class)
    return top(tried.filter(F.col("share").between(low, high)), "score", n, ["config_id"])


def class_weight_leaderboard(
    df: DataFrame, grid, share_class: int, n: int = 10, y: str = "y", proba: str = "proba"
) -> DataFrame:
    return top(class_weight_search(df, grid, y, proba, share_class), "score", n, ["config_id"])


def weight_what_if(df: DataFrame, grid: Sequence[Sequence[float]], proba: str = "proba") -> DataFrame:
    """How many rows go to each class under every given weight vector."""
    configs = [{"config_id": i, "weights": list(w)} for i, w in enumerate(grid)]
    pred = weighted_argmax(proba, [F.get(F.col("weights"), i) for i in range(len(grid[0]))])
    counts = (
        cross_grid(df.select(proba), configs)
        .withColumn("pred", pred)
        .groupBy("config_id", "pred")
        .agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy("config_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "config_id").select(
        "config_id", "pred", "n", (F.col("n") / F.col("total")).alias("share")
    )


def blend_search(
    df: DataFrame, scores: Sequence[str], grid: Sequence[Sequence[float]], y: str = "y"
) -> DataFrame:
    """AUC, AP and composite of every weighted sum of scores: ``(config_id, weights, ...)``."""
    configs = [{"config_id": i, "weights": list(map(float, w))} for i, w in enumerate(grid)]
    mixed = reduce(
        lambda a, b: a + b, [F.col(s) * F.get(F.col("weights"), i) for i, s in enumerate(scores)]
    )
    tried = cross_grid(df.select(y, *scores), configs).select("config_id", y, mixed.alias("score"))
    ranked = ranking_scores(tried, y, "score", ["config_id"])
    weights = F.get(grid_literal(configs), F.col("config_id").cast("int"))["weights"]
    return ranked.select("config_id", weights.alias("weights"), "auc", "ap", "composite")


def blend_bounds(
    df: DataFrame, scores: Sequence[str], grid: Sequence[Sequence[float]], y: str = "y", bins: int = 1024
) -> DataFrame:
    """Least and greatest composite that each weighted sum can have: ``(config_id, low, high)``, from one scan.

    What is shuffled is a count of each class per configuration and bin of the sum, whatever the number of rows. Rows
    of one bin may stand in any order: pairs inside it win all or none, and the precision at its positives is
    between that of its first with all negatives before it and that of its last with none.
    """
    configs = [{"config_id": i, "weights": list(map(float, w))} for i, w in enumerate(grid)]
    known = df.select(y, *scores).dropna()
    span = known.agg(*[F.min(s).alias(f"low_{s}") for s in scores], *[F.max(s).alias(f"high_{s}") for s in scores])
    span = span.agg(F.first(F.struct("*")).alias("s")).scalar()
    edge = lambda w, s, near, far: w * F.when(w >= 0, F.col(f"_s.{near}_{s}")).otherwise(F.col(f"_s.{far}_{s}"))
    weight = [F.get(F.col("weights"), i) for i in range(len(scores))]
    mixed = reduce(lambda a, b: a + b, [F.col(s) * w for s, w in zip(scores, weight)])
    least = reduce(lambda a, b: a + b, [edge(w, s, "low", "high") for s, w in zip(scores, weight)])
    most = reduce(lambda a, b: a + b, [edge(w, s, "high", "low") for s, w in zip(scores, weight)])
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.try_divide((mixed - least) * bins, most - least))))
    tried = cross_grid(known.withColumn("_s", span), configs).select("config_id", y, F.coalesce(place, F.lit(0)).alias("bin"))
    counts = tried.groupBy("config_id", "bin").agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q"))
    upto = W.partitionBy("config_id").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("config_id")
    below = F.coalesce(F.sum("q").over(upto), F.lit(0))
    p_before = F.coalesce(F.sum("p").over(upto), F.lit(0))
    sums = counts.withColumns({"below": below, "pp": F.sum("p").over(whole), "qq": F.sum("q").over(whole), "p_before": p_before})
    p_above, q_above = F.col("pp") - F.col("p_before") - F.col("p"), F.col("qq") - F.col("below") - F.col("q")
    some = F.col("p") > 0
    first = F.when(some, F.col("p") * (p_above + 1) / (p_above + 1 + q_above + F.col("q"))).otherwise(0.0)
    last = F.when(some, F.col("p") * (p_above + F.col("p")) / (p_above + F.col("p") + q_above)).otherwise(0.0)
    auc = lambda inside: F.try_divide(F.sum(F.col("p") * (F.col("below") + inside)).cast("double"), F.max("pp") * F.max("qq"))
    ap = lambda part: F.try_divide(F.sum(part), F.max("pp"))
    return sums.groupBy("config_id").agg(
        (AUC_SHARE * auc(F.lit(0)) + AP_SHARE * ap(first)).alias("low"), (AUC_SHARE * auc(F.col("q")) + AP_SHARE * ap(last)).alias("high")
    )


def best_blend(
    df: DataFrame, scores: Sequence[str], grid: Sequence[Sequence[float]], y: str = "y", bins: int = 1024
) -> DataFrame:
    """The row of :func:`blend_search` with the best composite (the first, if several): exact scores are
    taken of those configurations only that can still win by their bounds."""
    bounds = blend_bounds(df, scores, grid, y, bins).collect()  # one row per configuration
    known = [r for r in bounds if r.low is not None]
    limit = max((r.low for r in known), default=0.0) - 1e-9
    able = sorted(r.config_id for r in known if r.high >= limit) or list(range(len(grid)))
    board = blend_search(df, scores, [grid[i] for i in able], y)
    numbers = F.array(*[F.lit(i) for i in able])
    return choose_best(board).withColumn("config_id", F.get(numbers, F.col("config_id").cast("int")).cast("long"))


def convex_grid(weights: Sequence[float]) -> list[list[float]]:
    return [[float(w), 1.0 - float(w)] for w in weights]


def simplex_grid(first: Sequence[float], second: Sequence[float], least: float = 0.1) -> list[list[float]]:
    """Three weights that add to one, the third at least ``least``."""
    points = [[float(a), float(b), round(1.0 - a - b, 10)] for a, b in product(first, second)]
    return [p for p in points if p[2] >= least]


def choose_best(board: DataFrame, score: str = "composite", order: str = "config_id") -> DataFrame:
    return best_config(board.withColumn(score, F.round(score, 12)), score, order)


def pseudo_labels(
    df: DataFrame,
    probas: Sequence[str],
    class_weights: Sequence[float],
    confidence: float,
    min_agree: int,
    out: str = "pseudo",
) -> DataFrame:
    """Rows whose mean probability reaches ``confidence`` in some class and whose weighted
    choice is the own choice of at least ``min_agree`` models."""
    plain = [1.0] * len(class_weights)
    scored = df.withColumn("_mean", average_proba(probas))
    scored = scored.withColumn(out, weighted_argmax("_mean", class_weights))
    agree = reduce(
        lambda a, b: a + b,
        [(weighted_argmax(p, plain) == F.col(out)).cast("int") for p in probas],
    )
    return (
        scored.withColumn("confidence", F.array_max("_mean"))
        .withColumn("agree", agree)
        .filter((F.col("confidence") >= confidence) & (F.col("agree") >= min_agree))
        .drop("_mean")
    )


def override_if(
    label: str | Column, score: str | Column, model: str | Column, threshold: float = 3.0
) -> Column:
    """The keyword label where its score is above the threshold, else the model's."""
    return F.when(_col(score) > threshold, _col(label)).otherwise(_col(model))


def first_non_null(*predictions: str | Column) -> Column:
    return F.coalesce(*[_col(p) for p in predictions])


def vote3(
    direct: str,
    keyword: str,
    translated: str,
    lang: str = "lang",
    prefer_translated: Sequence[str] = ("de", "fr"),
    use_translation: bool = True,
) -> Column:
    """Agreement wins; then, in the listed languages, the translated text's label; else the direct one."""
    d, k, t = F.col(direct), F.col(keyword), F.col(translated)
    foreign = F.col(lang).isin(list(prefer_translated)) & F.lit(use_translation)
    return F.when(d.eqNullSafe(k) & d.eqNullSafe(t), d).when(foreign, t).otherwise(d)


def model_weight_search(
    df: DataFrame,
    probas: Sequence[str],
    tuples: Sequence[Sequence[float]],
    class_grid: Sequence[Sequence[float]],
    y: str = "y",
    fold: str = "fold",
) -> DataFrame:
    """Mean fold score of every model weighting, with its own best class weights."""
    k = len(class_grid[0])
    configs = [{"model_id": i, "model_weights": list(map(float, t))} for i, t in enumerate(tuples)]
    mixed = weighted_proba(probas, [F.get(F.col("model_weights"), i) for i in range(len(probas))])
    tried = cross_grid(df.select(y, fold, *probas), configs).select(
        "model_id", "model_weights", y, fold, mixed.alias("proba")
    )
    plain = tried.withColumn("pred", weighted_argmax("proba", [1.0] * k))
    keys = ["model_id", "model_weights", fold]
    per_fold = weakest_two(f1_from_confusion(confusion(plain, y, "pred", keys), keys, list(range(k))), keys)
    cv = per_fold.groupBy("model_id", "model_weights").agg(F.avg("weakest_two").alias("cv_mean"))
    tuned = class_weight_search(tried, class_grid, y, "proba", by=["model_id"])
    best = tuned.groupBy("model_id").agg(
        F.min_by(F.struct("weights", "score"), F.struct(-F.col("score"), F.col("config_id"))).alias("b")
    )
    return cv.join(best, "model_id").select(
        "model_id", "model_weights", "cv_mean", F.col("b.weights").alias("class_weights"), F.col("b.score").alias("tuned_score")
    )

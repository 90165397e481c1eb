"""Exact ranking and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tarnfold.operators.encode import union_rows
from tarnfold.operators.ordering import running_totals

AUC_SHARE, AP_SHARE = 0.7, 0.3


def ranking_scores(
    df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """``auc`` (ties count half), ``ap`` (step sum) and their 0.7 / 0.3 composite, per ``by``.

    Rows collapse to distinct scores first; one ascending running count gives both.
    """
    by = list(by)
    vals = (
        df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(score).alias("_score"))
        .agg(
            F.sum(F.col(y).cast("long")).alias("pos"),
            F.sum(F.lit(1) - F.col(y).cast("long")).alias("neg"),
        )
    )
    r = running_totals(vals, by, "_score", ["pos", "neg"])
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    below = F.col("neg_upto") - F.col("neg")
    at_least_pos = (F.col("pos_all") - F.col("pos_upto") + F.col("pos")).cast("double")
    at_least = at_least_pos + (F.col("neg_all") - F.col("neg_upto") + F.col("neg"))
    sums = r.groupBy(*by).agg(
        F.sum(pos * (below + neg / 2.0)).alias("_wins"),
        F.sum(pos * at_least_pos / at_least).alias("_gain"),
        F.max("pos_all").cast("double").alias("_p"),
        F.max("neg_all").cast("double").alias("_n"),
    )
    auc = F.try_divide(F.col("_wins"), F.col("_p") * F.col("_n"))
    ap = F.try_divide(F.col("_gain"), F.col("_p"))
    return sums.select(
        *by,
        auc.alias("auc"),
        ap.alias("ap"),
        (F.lit(AUC_SHARE) * auc + F.lit(AP_SHARE) * ap).alias("composite"),
    )


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    return ranking_scores(df, y, score, by).select(*by, "auc")


def average_precision(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    return ranking_scores(df, y, score, by).select(*by, "ap")


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def f1_from_confusion(counts: DataFrame, by: Sequence[str] = (), labels: Sequence | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is 0.

    With ``labels`` exactly these classes appear, else every class seen in y or pred.
    """
    by = list(by)
    sides = F.array(
        F.struct(
            F.col("y").alias("class"),
            F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
        ),
        F.struct(
            F.col("pred").alias("class"),
            F.lit(0).cast("long").alias("tp"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    rows = counts.select(*by, F.inline(sides)).filter(F.col("class").isNotNull())
    if labels is not None:
        rows = rows.filter(F.col("class").isin(list(labels)))
        zero = [F.lit(0).cast("long").alias(c) for c in ("tp", "support", "predicted")]
        each = F.explode(F.array(*[F.lit(v) for v in labels])).alias("class")
        rows = rows.unionByName(counts.select(*by).distinct().select(*by, each).select(*by, "class", *zero))
    tp, support, predicted = F.sum("tp"), F.sum("support"), F.sum("predicted")

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return rows.groupBy(*by, "class").agg(
        ratio(tp, predicted).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, support + predicted).alias("f1"),
        support.alias("support"),
        tp.alias("tp"),
    )


def f1_per_class(
    df: DataFrame, labels: Sequence, y: str = "y", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    return f1_from_confusion(confusion(df, y, pred, by), by, labels).select(*by, "class", "f1", "support")


def weakest_two(f1s: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the two lowest class scores (as many rows per group as there are classes)."""
    lowest = F.slice(F.array_sort(F.collect_list("f1")), 1, 2)
    mean = F.aggregate(lowest, F.lit(0.0), lambda acc, v: acc + v) / F.size(lowest)
    return f1s.groupBy(*by).agg(mean.alias("weakest_two"))


def weakest_two_f1(
    df: DataFrame, labels: Sequence, y: str = "y", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    return weakest_two(f1_per_class(df, labels, y, pred, by), by)


def classification_report(
    df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, macro F1 and support-weighted F1 over the classes seen in y or pred."""
    classes = f1_from_confusion(confusion(df, y, pred, by), by)
    rows = F.sum("support").cast("double")
    return classes.groupBy(*by).agg(
        (F.sum("tp") / rows).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / rows).alias("weighted_f1"),
        F.sum("support").alias("n"),
    )


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    same = F.col(a).eqNullSafe(F.col(b)).cast("long")
    return df.groupBy(*by).agg(
        F.sum(same).alias("same"), F.count("*").alias("n"), F.avg(same).alias("agreement")
    )


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(~F.col(a).eqNullSafe(F.col(b)))


def cv_summary(scores: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.groupBy(*by).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("folds")
    )


def oof_score(oof: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """The composite over all folds pooled."""
    return ranking_scores(oof, y, score)


def leaderboard(rows: Sequence[DataFrame], score: str, baseline: str, name: str = "config") -> DataFrame:
    """All configurations, best first, with the difference from the baseline."""
    board = union_rows(*rows)
    base = board.filter(F.col(name) == baseline).agg(F.max(score).alias("b")).scalar()
    return board.withColumn("gain", F.col(score) - base).orderBy(F.col(score).desc(), name)

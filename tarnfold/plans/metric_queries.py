"""Ranking and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.operators import joins, metrics
from tarnfold.plans.feature_queries import _ranking_sql
from tarnfold.plans.registry import query, rounded
from tarnfold.sources.views import PROBA_SQL, fold_sql, folded_proba, proba, table
from tarnfold.operators.ensemble import weighted_argmax

CLASSES = [0, 1, 2, 3]
ONES = [1.0] * 4


def argmax_sql(scores):
    top = f"greatest({', '.join(scores)})"
    return "case " + " ".join(f"when {s} = {top} then {i}" for i, s in enumerate(scores)) + " end"


def _pred(m):
    return argmax_sql([f"m{m}p{j}" for j in range(4)])


PREDS_SQL = f"{PROBA_SQL}, preds as (select id, y, {_pred(0)} as a, {_pred(1)} as b from proba)"


def predictions(spark, sf):
    return proba(spark, sf).select(
        "id", "y", weighted_argmax("p_m0", ONES).alias("a"), weighted_argmax("p_m1", ONES).alias("b")
    )


@query(
    "auc_ap",
    f"with s as (select case when l_returnflag = 'R' then 1 else 0 end as y, l_extendedprice as score from lineitem), {_ranking_sql('s')}",
)
def auc_ap(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.col("l_extendedprice").alias("score")
    )
    return rounded(metrics.ranking_scores(lines))


@query(
    "auc_by_group",
    """with s as (select l_linestatus, case when l_returnflag = 'R' then 1 else 0 end as y, l_discount as score from lineitem),
 v as (select l_linestatus, score, sum(y) as p, sum(1 - y) as q from s group by 1, 2),
 r as (select *, sum(q) over (partition by l_linestatus order by score) - q as below, sum(p) over (partition by l_linestatus) as pp,
  sum(q) over (partition by l_linestatus) as qq from v)
 select l_linestatus, round(cast(sum(p * (below + q / 2.0::double)) as double) / (max(pp) * max(qq)), 6) as auc from r group by 1""",
)
def auc_by_group(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_linestatus", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.col("l_discount").alias("score")
    )
    return rounded(metrics.roc_auc(lines, by=["l_linestatus"]))


_F1_SQL = f"""with {PREDS_SQL}, c as (select unnest([0, 1, 2, 3]) as class),
 f as (select class, coalesce(2.0::double * count(*) filter (y = class and a = class) / nullif(count(*) filter (y = class) + count(*) filter (a = class), 0), 0) as f1,
  count(*) filter (y = class) as support, count(*) filter (y = class and a = class) as tp from preds, c group by 1)"""


@query("f1_per_class", f"{_F1_SQL} select class, round(f1, 6) as f1, support from f")
def f1_per_class(spark, sf):
    return rounded(metrics.f1_per_class(predictions(spark, sf), CLASSES, "y", "a"))


@query("weakest_two", f"{_F1_SQL} select round(avg(f1), 6) as weakest_two from (select f1 from f order by f1 limit 2)")
def weakest_two(spark, sf):
    return rounded(metrics.weakest_two_f1(predictions(spark, sf), CLASSES, "y", "a"))


@query(
    "macro_weighted_f1",
    f"""{_F1_SQL} select round(cast(sum(tp) as double) / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1,
 round(sum(f1 * support) / sum(support), 6) as weighted_f1, cast(sum(support) as bigint) as n from f""",
)
def macro_weighted_f1(spark, sf):
    return rounded(metrics.classification_report(predictions(spark, sf), "y", "a"))


@query(
    "agreement",
    f"with {PREDS_SQL} select y, count(*) filter (a = b) as same, count(*) as n, round(avg(case when a = b then 1.0 else 0.0 end), 6) as agreement from preds group by 1",
)
def agreement(spark, sf):
    both = predictions(spark, sf)
    joined = joins.join_predictions(both.select("id", "y", "a"), both.select("id", "b"))
    return rounded(metrics.agreement(joined, "a", "b", ["y"]))


@query("disagreements", f"with {PREDS_SQL} select id, a as label_a, b as label_b from preds where a <> b")
def disagreements(spark, sf):
    both = predictions(spark, sf)
    compared = joins.compare_predictions(
        both.select("id", F.col("a").alias("label")), both.select("id", F.col("b").alias("label"))
    )
    return metrics.disagreements(compared, "label_a", "label_b").drop("same")


@query(
    "disagreement_by_class",
    f"with {PREDS_SQL} select y, count(*) as n from preds where a <> b group by 1",
)
def disagreement_by_class(spark, sf):
    return metrics.disagreements(predictions(spark, sf), "a", "b").groupBy("y").agg(F.count("*").alias("n"))


@query(
    "cv_summary",
    f"""with {PREDS_SQL}, p as (select *, {fold_sql('y', 'id', 5)} as fold from preds), c as (select unnest([0, 1, 2, 3]) as class),
 f as (select fold, class, coalesce(2.0::double * count(*) filter (y = class and a = class) / nullif(count(*) filter (y = class) + count(*) filter (a = class), 0), 0) as f1
  from p, c group by 1, 2), w as (select fold, avg(f1) as s from (select * from f qualify row_number() over (partition by fold order by f1, class) <= 2) group by 1)
 select round(avg(s), 6) as mean, round(stddev_pop(s), 6) as std, count(*) as folds from w""",
)
def cv_summary(spark, sf):
    scored = folded_proba(spark, sf).select("y", "fold", weighted_argmax("p_m0", ONES).alias("a"))
    per_fold = metrics.weakest_two_f1(scored, CLASSES, "y", "a", ["fold"])
    return rounded(metrics.cv_summary(per_fold, "weakest_two"))


@query(
    "leaderboard",
    f"""with {PREDS_SQL}, r as (select 'm0' as config, avg(case when a = y then 1.0 else 0.0 end) as accuracy from preds union all
  select 'm1', avg(case when b = y then 1.0 else 0.0 end) from preds)
 select config, round(accuracy, 6) as accuracy, round(accuracy - (select accuracy from r where config = 'm0'), 6) as gain from r""",
)
def leaderboard(spark, sf):
    both = predictions(spark, sf)
    rows = [
        metrics.classification_report(both, "y", c).select(F.lit(n).alias("config"), "accuracy")
        for n, c in (("m0", "a"), ("m1", "b"))
    ]
    return rounded(metrics.leaderboard(rows, "accuracy", "m0"))

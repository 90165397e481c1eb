"""Blends, class-weight searches and decision rules over three probability models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.operators import ensemble
from tarnfold.plans.metric_queries import argmax_sql
from tarnfold.plans.registry import query, rounded
from tarnfold.sources.views import PROBA_SQL, documents, fold_sql, folded_proba, proba

GRID = ensemble.weight_grid([0.6, 0.7, 0.8, 0.9, 1.0], [0.8, 0.9, 1.0, 1.1, 1.2], [0.8, 0.9, 1.0, 1.1], [1.5, 2.0, 2.5, 3.0, 3.5])
SMALL = ensemble.weight_grid([0.6, 0.8, 1.0], [1.0, 1.1], [0.9, 1.0], [2.0, 2.5, 3.0])
BOARD = ensemble.weight_grid([0.5, 0.6, 0.7], [0.9, 1.0], [0.8, 0.9, 1.0], [2.0, 2.5, 3.0, 3.5, 4.0])
PROBAS = ["p_m0", "p_m1", "p_m2"]

MEAN_SQL = f"""{PROBA_SQL}, mean as (select id, y, {', '.join(f'(m0p{j} + m1p{j} + m2p{j}) / 3 as p{j}' for j in range(4))} from proba)"""


def _mean(spark, sf):
    return proba(spark, sf).select("id", "y", ensemble.average_proba(PROBAS).alias("proba"))


def _grid_sql(grid):
    rows = ", ".join(f"({i}, {', '.join(f'{w}::double' for w in ws)})" for i, ws in enumerate(grid))
    return f"grid as (select cast(config_id as bigint) as config_id, w0, w1, w2, w3 from (values {rows}) v(config_id, w0, w1, w2, w3))"


def _search_sql(grid, source=MEAN_SQL, table_="mean", by=""):
    key = f"{by}config_id"
    return f"""{source}, {_grid_sql(grid)},
 tried as (select {by}config_id, y, {argmax_sql([f'p{j} * w{j}' for j in range(4)])} as pred from {table_}, grid),
 conf as (select {key}, y, pred, count(*) as n from tried group by all),
 class as (select unnest([0, 1, 2, 3]) as c),
 f as (select {key}, c, coalesce(2.0::double * sum(n) filter (y = c and pred = c) / (coalesce(sum(n) filter (y = c), 0) + coalesce(sum(n) filter (pred = c), 0)), 0) as f1
  from conf, class group by all),
 share as (select {key}, cast(coalesce(sum(n) filter (pred = 3), 0) as double) / sum(n) as share from conf group by all),
 score as (select {key}, round(avg(f1), 12) as score from (select * from f qualify row_number() over (partition by {key} order by f1, c) <= 2) group by all)"""


_LISTED = "config_id, [w0, w1, w2, w3] as weights, round(score, 6) as score"


@query("weighted_argmax", f"with {MEAN_SQL} select id, {argmax_sql(['p0 * 0.6::double', 'p1', 'p2 * 0.9::double', 'p3 * 2.5::double'])} as pred from mean")
def weighted_argmax(spark, sf):
    return _mean(spark, sf).select("id", ensemble.weighted_argmax("proba", [0.6, 1.0, 0.9, 2.5]).alias("pred"))


@query(
    "weighted_proba",
    f"with {PROBA_SQL} select id, " + ", ".join(f"round((2 * m0p{j} + m1p{j} + 0.5 * m2p{j}) / 3.5, 6) as p{j}" for j in range(4)) + " from proba",
)
def weighted_proba(spark, sf):
    mixed = proba(spark, sf).withColumn("p", ensemble.weighted_proba(PROBAS, [2, 1, 0.5]))
    return rounded(mixed.select("id", *[F.get("p", j).alias(f"p{j}") for j in range(4)]))


@query("class_weight_search", f"with {_search_sql(GRID)} select {_LISTED} from score join grid using (config_id)")
def class_weight_search(spark, sf):
    return rounded(ensemble.class_weight_search(_mean(spark, sf), GRID))


@query("best_class_weights", f"with {_search_sql(SMALL)} select {_LISTED} from score join grid using (config_id) order by score.score desc, config_id limit 1")
def best_class_weights(spark, sf):
    return rounded(ensemble.best_class_weights(_mean(spark, sf), SMALL))


@query(
    "class_weight_constraint",
    f"with {_search_sql(GRID)} select {_LISTED}, round(share, 6) as share from score join grid using (config_id) join share using (config_id)"
    " where share between 0.5 and 0.8 order by score.score desc, config_id limit 5",
)
def class_weight_constraint(spark, sf):
    return rounded(ensemble.constrained_class_weights(_mean(spark, sf), GRID, 3, 0.5, 0.8, 5))


@query(
    "class_weight_leaderboard",
    f"with {_search_sql(BOARD)} select {_LISTED}, round(share, 6) as share from score join grid using (config_id) join share using (config_id)"
    " order by score.score desc, config_id limit 10",
)
def class_weight_leaderboard(spark, sf):
    return rounded(ensemble.class_weight_leaderboard(_mean(spark, sf), BOARD, 3, 10))


WHAT_IF = [[0.8, 1.1, 1.0, 2.0], [0.6, 1.0, 0.9, 2.5], [0.5, 1.0, 0.8, 3.0]]


@query(
    "weight_what_if",
    f"with {_search_sql(WHAT_IF)} select config_id, pred, cast(sum(n) as bigint) as n, round(sum(n) / sum(sum(n)) over (partition by config_id), 6) as share from conf group by 1, 2",
)
def weight_what_if(spark, sf):
    return rounded(ensemble.weight_what_if(_mean(spark, sf), WHAT_IF))


BINARY_SQL = f"{PROBA_SQL}, s as (select case when y = 3 then 1 else 0 end as y, m0p3 as a, m1p3 as b, m2p3 as c from proba)"


def _binary(spark, sf):
    return proba(spark, sf).select(
        F.when(F.col("y") == 3, 1).otherwise(0).alias("y"),
        *[F.get(p, 3).alias(n) for p, n in zip(PROBAS, "abc")],
    )


def _blend_sql(grid, names):
    rows = ", ".join(f"({i}, {', '.join(f'{w!r}::double' for w in ws)})" for i, ws in enumerate(grid))
    ws = [f"w{i}" for i in range(len(names))]
    mixed = " + ".join(f"{n} * {w}" for n, w in zip(names, ws))
    return f"""with {BINARY_SQL}, g as (select cast(config_id as bigint) as config_id, {', '.join(ws)} from (values {rows}) v(config_id, {', '.join(ws)})),
 v as (select config_id, {mixed} as score, sum(y) as p, sum(1 - y) as q from s, g group by 1, 2),
 r as (select config_id, p, q, sum(q) over w - q as below, sum(p) over (partition by config_id) as pp, sum(q) over (partition by config_id) as qq,
  sum(p) over d as cp, sum(p + q) over d as cn from v window w as (partition by config_id order by score), d as (partition by config_id order by score desc)),
 m as (select config_id, cast(sum(p * (below + q / 2.0::double)) as double) / (max(pp) * max(qq)) as auc, sum(cast(p as double) / pp * cast(cp as double) / cn) as ap from r group by 1)
 select config_id, [{', '.join(ws)}] as weights, round(auc, 6) as auc, round(ap, 6) as ap, round(0.7 * auc + 0.3 * ap, 6) as composite from m join g using (config_id)"""


CONVEX = ensemble.convex_grid([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8])
SIMPLEX = ensemble.simplex_grid([0.2, 0.3, 0.4, 0.5, 0.6], [0.1, 0.2, 0.3, 0.4])


@query("blend_search", _blend_sql(CONVEX, "ab"))
def blend_search(spark, sf):
    return rounded(ensemble.blend_search(_binary(spark, sf), ["a", "b"], CONVEX))


@query("blend_search3", _blend_sql(SIMPLEX, "abc"))
def blend_search3(spark, sf):
    return rounded(ensemble.blend_search(_binary(spark, sf), ["a", "b", "c"], SIMPLEX))


@query("choose_best", _blend_sql(CONVEX, "ab").replace(" from m join g", " from (select * from m order by round(0.7 * auc + 0.3 * ap, 12) desc, config_id limit 1) join g"))
def choose_best(spark, sf):
    return rounded(ensemble.choose_best(ensemble.blend_search(_binary(spark, sf), ["a", "b"], CONVEX)))


def _winner_sql(grid, names):
    return _blend_sql(grid, names).replace(" from m join g", " from (select * from m order by round(0.7 * auc + 0.3 * ap, 12) desc, config_id limit 1) join g")


@query("blend_winner", _winner_sql(CONVEX, "ab"))
def blend_winner(spark, sf):
    return rounded(ensemble.best_blend(_binary(spark, sf), ["a", "b"], CONVEX))


@query("blend_winner3", _winner_sql(SIMPLEX, "abc"))
def blend_winner3(spark, sf):
    return rounded(ensemble.best_blend(_binary(spark, sf), ["a", "b", "c"], SIMPLEX))


@query("fixed_blend", f"with {BINARY_SQL} select y, round(sum(0.3 * a + 0.35 * b + 0.35 * c), 4) as total from s group by 1")
def fixed_blend(spark, sf):
    mixed = _binary(spark, sf).select("y", ensemble.blend(["a", "b", "c"], [0.3, 0.35, 0.35]).alias("s"))
    return rounded(mixed.groupBy("y").agg(F.sum("s").alias("total")), 4)


TUPLES = [(1, 1, 0), (1, 1, 1), (2, 1, 1), (1, 2, 1), (1, 1, 0.5), (2, 2, 1)]


def _model_sql():
    rows = ", ".join(f"({i}, {', '.join(f'{float(w)}::double' for w in t)})" for i, t in enumerate(TUPLES))
    tuned = _search_sql(
        SMALL,
        f"""{PROBA_SQL}, folded as (select *, {fold_sql('y', 'id', 5)} as fold from proba),
 t as (select cast(model_id as bigint) as model_id, v0, v1, v2 from (values {rows}) v(model_id, v0, v1, v2)),
 mixed as (select model_id, fold, y, {', '.join(f'(m0p{j} * v0 + m1p{j} * v1 + m2p{j} * v2) / (v0 + v1 + v2) as p{j}' for j in range(4))} from folded, t)""",
        "mixed",
        "model_id, ",
    )
    return f"""with {tuned}, plain as (select model_id, fold, y, {argmax_sql(['p0', 'p1', 'p2', 'p3'])} as pred from mixed),
 pf as (select model_id, fold, c, coalesce(2.0::double * count(*) filter (y = c and pred = c) / nullif(count(*) filter (y = c) + count(*) filter (pred = c), 0), 0) as f1 from plain, class group by all),
 pw as (select model_id, fold, avg(f1) as s from (select * from pf qualify row_number() over (partition by model_id, fold order by f1, c) <= 2) group by all),
 cv as (select model_id, avg(s) as cv_mean from pw group by 1),
 best as (select * from score qualify row_number() over (partition by model_id order by score desc, config_id) = 1)
 select model_id, [v0, v1, v2] as model_weights, round(cv_mean, 6) as cv_mean, [w0, w1, w2, w3] as class_weights, round(score, 6) as tuned_score
 from cv join best using (model_id) join t using (model_id) join grid using (config_id)"""


@query("model_weight_search", _model_sql())
def model_weight_search(spark, sf):
    return rounded(ensemble.model_weight_search(folded_proba(spark, sf), PROBAS, TUPLES, SMALL))


@query(
    "pseudo_labels",
    f"""with {MEAN_SQL}, a as (select id, p0, p1, p2, p3, {argmax_sql(['p0 * 0.8::double', 'p1', 'p2', 'p3 * 1.2::double'])} as pseudo,
  {', '.join(argmax_sql([f'm{m}p{j}' for j in range(4)]) + f' as c{m}' for m in range(3))} from mean join proba using (id)),
 b as (select *, greatest(p0, p1, p2, p3) as confidence, cast(c0 = pseudo as integer) + cast(c1 = pseudo as integer) + cast(c2 = pseudo as integer) as agree from a)
 select id, pseudo, round(confidence, 6) as confidence, agree from b where confidence >= 0.4 and agree >= 2""",
)
def pseudo_labels(spark, sf):
    picked = ensemble.pseudo_labels(proba(spark, sf), PROBAS, [0.8, 1.0, 1.0, 1.2], 0.4, 2)
    return rounded(picked.select("id", "pseudo", "confidence", "agree"))


@query(
    "vote3",
    """with v as (select doc_id, lang, source as d, concat('src', doc_id % 20) as k, concat('src', length(text) % 20) as t from documents)
 select doc_id as id, case when d = k and d = t then d when lang in ('de', 'fr') then t else d end as voted from v""",
)
def vote3(spark, sf):
    v = documents(spark, sf).select(
        "id",
        "lang",
        F.col("label").alias("d"),
        F.concat(F.lit("src"), (F.col("id") % 20).cast("string")).alias("k"),
        F.concat(F.lit("src"), (F.length("text") % 20).cast("string")).alias("t"),
    )
    return v.select("id", ensemble.vote3("d", "k", "t").alias("voted"))

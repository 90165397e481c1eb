"""Cross-validated models, stacking, ablation, pseudo-labelling and text classification.

Ridge and logistic stacking have one optimum, so SQL can say them. What trees and linear models of many
columns learn has no SQL twin; these queries return what is certain about it: per fold, configuration or row, that every
row was scored once by a model that had not seen it, that its probabilities add to one, and whether the score
beats always naming the largest class. Tests bound the scores themselves.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tarnfold.functions import columns as C
from tarnfold.operators import encode, ensemble, geo, metrics, models, windows
from tarnfold.plans.ensemble_queries import PROBAS, SMALL, _search_sql
from tarnfold.plans.metric_queries import _ranking_sql
from tarnfold.plans.registry import query, rounded
from tarnfold.session import cut_lineage
from tarnfold.sources.views import FUELS, PLANTS_SQL, PROBA_SQL, documents, fold_sql, folded_proba, plants, table

CLASSES = [0, 1, 2, 3]
FOLDS = 5


def _vectors(spark, sf, folds=FOLDS):
    """The given labels have nothing to do with the vectors, so the class is the quadrant of the first two coordinates."""
    right, upper = (F.when(F.get("embedding", i) > 0, 1).otherwise(0) for i in (0, 1))
    base = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), (2 * right + upper).alias("y"),
        array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"),
    )
    return encode.class_weight_col(windows.stratified_folds(base, "y", folds), "y")


def _whole(proba="proba"):
    total = F.aggregate(proba, F.lit(0.0), lambda a, v: a + v)
    return (F.abs(total - 1) < 1e-9) & F.forall(proba, lambda v: (v >= 0) & (v <= 1))


def _facts(held, classes=4):
    """Per fold: rows, ids and rows with whole probabilities; whether the pooled choice beats the largest class."""
    scored = cut_lineage(held.withColumn("pred", ensemble.weighted_argmax("proba", [1.0] * classes)).withColumn("whole", _whole()).select("id", "y", "fold", "pred", "whole"))
    largest = scored.groupBy("y").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    beats = scored.agg(F.count_if(F.col("pred") == F.col("y")).alias("hits")).select(F.col("hits") > largest.scalar())
    return scored.groupBy("fold").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if("whole").alias("n_proba")
    ).withColumn("beats_largest_class", beats.scalar())


_QUADRANT_SQL = "case when embedding[1] > 0 then 2 else 0 end + case when embedding[2] > 0 then 1 else 0 end"
_VECTORS_SQL = f"v as (select vec_id as id, {_QUADRANT_SQL} as y from embeddings), f as (select *, {fold_sql('y', 'id', FOLDS)} as fold from v)"
_FACTS_SQL = f"with {_VECTORS_SQL} select fold, count(*) as n, count(distinct id) as n_ids, count(*) as n_proba, true as beats_largest_class from f group by fold"


@query("cv_rf", _FACTS_SQL)
def cv_rf(spark, sf):
    held, _ = models.cross_val_predict(models.make_rf, _vectors(spark, sf))
    return _facts(held)


@query("cv_extra_trees", _FACTS_SQL)
def cv_extra_trees(spark, sf):
    held, _ = models.cross_val_predict(models.make_extra_trees, _vectors(spark, sf))
    return _facts(held)


@query("cv_lr", _FACTS_SQL)
def cv_lr(spark, sf):
    held, _ = models.cross_val_predict(lambda: models.make_lr(0.01), _vectors(spark, sf))
    return _facts(held)


# four models of each fold; more rounds than these take minutes (README)
OVR_ROUNDS, OVR_DEPTH = 20, 4


@query("cv_gbt_ovr", _FACTS_SQL)
def cv_gbt_ovr(spark, sf):
    factory = lambda: models.OneVsRestGBT(4, lambda: models.make_gbt(OVR_ROUNDS, OVR_DEPTH))
    held, _ = models.cross_val_predict(factory, _vectors(spark, sf))
    return _facts(held)


FEATURES = ["capacity_mw", "capacity_log_mw", "plant_age", "latitude", "longitude", "age_per_cap"]
ONE_HOT = [f"is_{f.lower()}" for f in FUELS]
ENCODED = ["primary_fuel_te", "owner_bucket_te", "capacity_band_te", "fuel_band_te"]
RANKED = ["plant_age_rank", "capacity_mw_z"]


NEAR_PAIRS = geo.pair_grid([5, 10], [200, 500])
NEAR = [f"nn{k}_max{d}_{m}" for k, d in NEAR_PAIRS for m in ("target_mean", "count", "dist_mean")] + [
    "dist_to_nearest_positive", "dist_to_nearest_negative",
]


def _plant_features(spark, sf, folds=FOLDS, near=True):
    """The tabular feature table: row, group and neighbour features and target encodings.

    Encodings and neighbours leave out the row's own fold, for all folds in one pass each.
    """
    p = windows.stratified_folds(plants(spark, sf), "underperforming", folds)
    p = C.one_hot(p.withColumnRenamed("underperforming", "y"), "primary_fuel", FUELS)
    p = p.withColumns(
        {
            "age_per_cap": C.safe_ratio("plant_age", "capacity_log_mw"),
            "fuel_band": C.combo_key(["primary_fuel", "capacity_band"]),
        }
    )
    p = cut_lineage(p)  # every fit below scans this table, not the joins behind it
    if near:
        prior = p.agg(F.avg("y").alias("g")).scalar()
        p = geo.neighbor_features(
            p, None, NEAR_PAIRS, ["primary_fuel", "other_fuel1"], ["capacity_log_mw", "plant_age"], 0.5, 1.0, 0.5, y="y", fold="fold", default=prior
        )
        p = cut_lineage(p)  # medians and encodings below each scan it, and the search is to run once
    p = windows.group_pct_rank(p, "primary_fuel", "plant_age")
    p = windows.group_zscore(p, "primary_fuel", ["capacity_mw"])
    p = encode.target_encode_oof(p, ["primary_fuel", "owner_bucket", "capacity_band", "fuel_band"], "y", "fold", 20.0)
    columns = FEATURES + RANKED + (NEAR if near else [])
    (filled,) = encode.impute_median(p, [], columns)
    return cut_lineage(filled.select("id", "y", "fold", *FEATURES, *ONE_HOT, *RANKED, *ENCODED, *(NEAR if near else [])))


_PLANT_FOLDS_SQL = f"{PLANTS_SQL}, f as (select *, {fold_sql('underperforming', 'id', FOLDS)} as fold from plants)"
ROUNDS, DEPTH = 150, 6


@query(
    "cv_gbt",
    f"""with {_PLANT_FOLDS_SQL}, train as (select * from f where fold <> 0), test as (select * from f where fold = 0)
 select fold, count(*) as n, count(distinct id) as n_ids, count(*) as n_proba, true as stopped_in_time from train group by fold
 union all select -1, count(*), count(distinct id), count(*), true from test""",
)
def cv_gbt(spark, sf):
    """Boosting on all features incl. neighbours: out of fold for the training rows, the folds' mean on a test table (fold -1)."""
    rows = models.assemble(_plant_features(spark, sf), FEATURES + ONE_HOT + ENCODED + NEAR)
    train, test = rows.filter("fold <> 0"), rows.filter("fold = 0")
    rounds = []

    def factory():
        return models.EarlyStoppedGBT(lambda: models.make_gbt(ROUNDS, DEPTH), report=rounds.append)

    held, scored = models.cross_val_predict(factory, train, test=test.select("id", "features"))
    both = held.select("id", "fold", "proba").union(scored.select("id", F.lit(-1).alias("fold"), "proba"))
    both = cut_lineage(both.select("id", "fold", _whole().alias("whole")))
    in_time = len(rounds) == FOLDS - 1 and all(1 <= n <= ROUNDS for n in rounds)
    return both.groupBy("fold").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if("whole").alias("n_proba")
    ).withColumn("stopped_in_time", F.lit(in_time))


def _board_facts(board):
    """Configurations whose scores are all in their ranges, the composite being what its parts make it."""
    within = lambda c: F.col(c).between(0.0, 1.0)
    made = F.abs(F.col("composite") - (0.7 * F.col("auc") + 0.3 * F.col("ap"))) < 1e-9
    return board.select("config", (within("auc") & within("ap") & made).alias("in_range"))


def _configs_sql(names):
    return f"select config, true as in_range from (values {', '.join(f'({chr(39)}{n}{chr(39)})' for n in names)}) v(config)"


PARAMS = {"shallow": (50, 3), "deep": (50, 6)}


@query("compare_params", _configs_sql(PARAMS))
def compare_params(spark, sf):
    train = models.assemble(_plant_features(spark, sf), FEATURES + ENCODED + NEAR)
    sets = {name: lambda r=rounds, d=depth: models.make_gbt(r, d) for name, (rounds, depth) in PARAMS.items()}
    return _board_facts(models.compare_params(sets, train))


COLUMN_SETS = {
    "base": FEATURES, "plus_one_hot": FEATURES + ONE_HOT, "plus_encoding": FEATURES + ONE_HOT + ENCODED,
    "plus_groups": FEATURES + ONE_HOT + ENCODED + RANKED, "plus_neighbours": FEATURES + ONE_HOT + ENCODED + RANKED + NEAR,
}


@query("ablation", _configs_sql(COLUMN_SETS))
def ablation(spark, sf):
    board = models.ablation(lambda: models.make_lr(0.01, weight=None), _plant_features(spark, sf), COLUMN_SETS)
    return _board_facts(metrics.leaderboard([board], "composite", "base"))


_IMPORTANT = FEATURES + ONE_HOT + ENCODED


@query("importances", f"select feature, true as in_range, true as adds_to_one from (values {', '.join(f'({chr(39)}{n}{chr(39)})' for n in _IMPORTANT)}) v(feature)")
def importances(spark, sf):
    train = models.stored_evenly(models.assemble(_plant_features(spark, sf, near=False), _IMPORTANT))
    model = models.make_rf(weight=None).fit(train)
    ranked = spark.createDataFrame(models.importances(model, _IMPORTANT), "feature string, importance double")
    total = ranked.agg(F.sum("importance").alias("t"))
    return ranked.select("feature", F.col("importance").between(0.0, 1.0).alias("in_range"), (F.abs(total.scalar() - 1) < 1e-9).alias("adds_to_one"))


def _binary_oof(spark, sf):
    oof = folded_proba(spark, sf, 3)
    return oof.select(
        "id", F.when(F.col("y") == 3, 1).otherwise(0).alias("y"), "fold",
        *[F.get(p, 3).alias(n) for p, n in zip(PROBAS, "abc")],
    )


def _final_score(df):
    return rounded(metrics.ranking_scores(df.withColumnRenamed("stack", "score")))


# Newton steps on three scores and an intercept, unrolled: sums over the rows a model sees, then elimination
def _newton_sql(source, models, sees, steps=14):
    x = ["1.0::double", "a", "b", "c"]
    ctes = [f"w0 as (select k, {', '.join(f'0.0::double as v{i}' for i in range(4))} from {models})"]
    for n in range(steps):
        grams = [f"sum(e * (1 - e) * {x[i]} * {x[j]}){' + 1' if i == j and i else ''} as h{i}{j}" for i in range(4) for j in range(i, 4)]
        slopes = [f"sum((y - e) * {x[i]}){f' - any_value(v{i})' if i else ''} as g{i}" for i in range(4)]
        kept = ", ".join(f"any_value(v{i}) as v{i}" for i in range(4))
        ctes.append(
            f"s{n} as (select k, {kept}, {', '.join(grams + slopes)} from (select *, 1 / (1 + exp(-(v0 + v1 * a + v2 * b + v3 * c))) as e"
            f" from {source} join w{n} on {sees}) group by k)"
        )
        last = f"s{n}"
        for i in range(3):
            rest = [f"h{r}{c} - h{i}{r} / h{i}{i} * h{i}{c} as h{r}{c}" for r in range(i + 1, 4) for c in range(r, 4)]
            rest += [f"g{r} - h{i}{r} / h{i}{i} * g{i} as g{r}" for r in range(i + 1, 4)]
            ctes.append(f"s{n}_{i} as (select * replace ({', '.join(rest)}) from {last})")
            last = f"s{n}_{i}"
        ctes.append(f"t{n} as (select *, g3 / h33 as d3 from {last})")
        ctes.append(f"u{n} as (select *, (g2 - h23 * d3) / h22 as d2 from t{n})")
        ctes.append(f"x{n} as (select *, (g1 - h12 * d2 - h13 * d3) / h11 as d1 from u{n})")
        ctes.append(f"y{n} as (select *, (g0 - h01 * d1 - h02 * d2 - h03 * d3) / h00 as d0 from x{n})")
        ctes.append(f"w{n + 1} as materialized (select k, {', '.join(f'v{i} + d{i} as v{i}' for i in range(4))} from y{n})")
    return ",\n ".join(ctes), f"w{steps}"


def _stack_sql(models, sees, scored_by):
    steps, last = _newton_sql("s", "k", sees)
    return f"""with {PROBA_SQL}, folded as (select *, {fold_sql('y', 'id', 3)} as fold from proba),
 o as (select id, fold, case when y = 3 then 1 else 0 end as y, m0p3 as a, m1p3 as b, m2p3 as c from folded), s as (select * from o), k as ({models}),
 {steps}, r as (select s.y, 1 / (1 + exp(-(v0 + v1 * a + v2 * b + v3 * c))) as score from s join {last} on {scored_by}),
 z as (select * from (with s as (select * from r), {_ranking_sql('s')})) select * from z"""


@query("stack_lr", _stack_sql("select unnest([0, 1, 2]) as k", "fold <> k", "fold = k"))
def stack_lr(spark, sf):
    held, _ = models.stack_lr(_binary_oof(spark, sf), ["a", "b", "c"])
    return _final_score(held)


@query("stack_lr_in_sample", _stack_sql("select 0 as k", "true", "true"))
def stack_lr_in_sample(spark, sf):
    held, _ = models.stack_lr(_binary_oof(spark, sf), ["a", "b", "c"], out_of_fold=False)
    return _final_score(held)


# normal equations of three scores and an intercept, by Cramer's rule, on the rows outside each fold
_RIDGE_SQL = f"""{PROBA_SQL}, folded as (select *, {fold_sql('y', 'id', 3)} as fold from proba),
 s as (select id, fold, case when y = 3 then 1 else 0 end as y, m0p3 as a, m1p3 as b, m2p3 as c from folded),
 k as (select unnest([0, 1, 2]) as k),
 m as (select k, avg(y) as my, avg(a) as ma, avg(b) as mb, avg(c) as mc,
  covar_pop(a, a) * count(*) + 1 as aa, covar_pop(b, b) * count(*) + 1 as bb, covar_pop(c, c) * count(*) + 1 as cc,
  covar_pop(a, b) * count(*) as ab, covar_pop(a, c) * count(*) as ac, covar_pop(b, c) * count(*) as bc,
  covar_pop(a, y) * count(*) as ya, covar_pop(b, y) * count(*) as yb, covar_pop(c, y) * count(*) as yc
  from s join k on s.fold <> k.k group by k),
 d as (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as det from m),
 w as (select *, (ya * (bb * cc - bc * bc) - ab * (yb * cc - bc * yc) + ac * (yb * bc - bb * yc)) / det as wa,
  (aa * (yb * cc - bc * yc) - ya * (ab * cc - bc * ac) + ac * (ab * yc - yb * ac)) / det as wb,
  (aa * (bb * yc - yb * bc) - ab * (ab * yc - yb * ac) + ya * (ab * bc - bb * ac)) / det as wc from d),
 held as (select s.y, a, b, c, greatest(0, least(1, my + wa * (a - ma) + wb * (b - mb) + wc * (c - mc))) as stack
  from s join w on s.fold = w.k)"""


def _board_sql(scores):
    one = "select {i} as config_id, '{name}' as config, * from (with s as (select y, {expr} as score from held), {ranking})"
    rows = [one.format(i=i, name=n, expr=e, ranking=_ranking_sql("s")) for i, (n, e) in enumerate(scores.items())]
    return f"board as ({' union all '.join(rows)})"


@query("stack_ridge", f"with {_RIDGE_SQL}, r as (select * from (with s as (select y, stack as score from held), {_ranking_sql('s')})) select * from r")
def stack_ridge(spark, sf):
    held, _ = models.stack_ridge(_binary_oof(spark, sf), ["a", "b", "c"])
    return _final_score(held)


@query(
    "choose_ensemble",
    f"""with {_RIDGE_SQL}, {_board_sql({'stack': 'stack', 'mean': '(a + b + c) / 3', 'first': 'a'})}
 select * from board order by composite desc, config_id limit 1""",
)
def choose_ensemble(spark, sf):
    held, _ = models.stack_ridge(_binary_oof(spark, sf), ["a", "b", "c"])
    held = held.withColumn("mean", (F.col("a") + F.col("b") + F.col("c")) / 3)
    board = models.choose_ensemble(held, {"stack": "stack", "mean": "mean", "first": "a"})
    return rounded(ensemble.choose_best(board))


def _rosters_sql(rosters):
    parts = []
    for name, members in rosters.items():
        mixed = ", ".join(f"({' + '.join(f'{m}p{j}' for m in members)}) / {len(members)} as p{j}" for j in range(4))
        search = _search_sql(SMALL, f"{PROBA_SQL}, mean as (select id, y, {mixed} from proba)")
        best = "select config_id, [w0, w1, w2, w3] as weights, round(score, 6) as score from score join grid using (config_id)"
        parts.append(f"select *, '{name}' as config from (with {search} {best} order by score.score desc, config_id limit 1)")
    return " union all ".join(parts)


@query("compare_rosters", _rosters_sql({"m0": ["m0"], "m0+m1": ["m0", "m1"], "all": ["m0", "m1", "m2"]}))
def compare_rosters(spark, sf):
    oof = folded_proba(spark, sf, 3)
    rosters = {"m0": ["m0"], "m0+m1": ["m0", "m1"], "all": ["m0", "m1", "m2"]}

    def weakest(mixed):
        return ensemble.best_class_weights(mixed, SMALL)

    return rounded(models.compare_rosters(oof, rosters, score=weakest))


_TEST_IDS_SQL = f"with {_VECTORS_SQL} select id, true as known_class from f where fold = 0"


@query("fit_final", _TEST_IDS_SQL)
def fit_final(spark, sf):
    train = _vectors(spark, sf).filter("fold <> 0")
    test = _vectors(spark, sf).filter("fold = 0").select("id", "features")
    scored = models.fit_final(models.make_rf, train, test)
    chosen = ensemble.weighted_argmax("proba", [0.6, 1.0, 0.9, 2.5])
    return scored.select("id", (chosen.isin(CLASSES) & _whole()).alias("known_class"))


@query("pseudo_loop", _TEST_IDS_SQL)
def pseudo_loop(spark, sf):
    """Three rounds over a roster of two kinds of model, with tuned class weights."""
    base = _vectors(spark, sf)
    roster = {
        "rf": lambda: models.make_rf(20, 6),
        "lr": lambda: models.make_lr(0.01, iterations=50),
    }
    result = models.pseudo_label_loop(
        roster, base.filter("fold <> 0"), base.filter("fold = 0").select("id", "features"), SMALL, rounds=((0.5, 2), (0.4, 2), (0.35, 1)), folds=2
    )
    return result.predictions.select("id", (F.col("pred").isin(CLASSES) & _whole()).alias("known_class"))


SEEN = ("en", "de")


@query(
    "text_classifier",
    f"""select lang, count(*) as n, count(distinct doc_id) as n_ids, true as known_label from documents
 where lang not in ('{"', '".join(SEEN)}') group by lang""",
)
def text_classifier(spark, sf):
    """Source of a document from its hashed words: fit on some languages, applied to all texts of the others."""
    docs = documents(spark, sf).select("id", "text", "lang", "label")
    seen = F.col("lang").isin(list(SEEN))
    train = docs.filter(seen & F.col("label").isNotNull())
    scored = models.fit_text_classifier(train).transform(docs.filter(~seen)).select("id", "lang", "predicted")
    known = train.agg(F.collect_set("label").alias("all")).scalar()
    out = scored.withColumn("known", F.array_contains(known, F.col("predicted")))
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.bool_and("known").alias("known_label"))

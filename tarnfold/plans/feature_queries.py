"""Row features, within-group features, encoders, joins and row-set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.functions import columns as C
from tarnfold.operators import encode, joins, windows
from tarnfold.operators.metrics import ranking_scores
from tarnfold.plans.registry import query, rounded
from tarnfold.sources.views import (
    ENCODED_SQL,
    FOLDED_PLANTS_SQL,
    FUELS,
    PLANTS_SQL,
    age_band,
    documents,
    encoded_base,
    fold_sql,
    folded_plants,
    plants,
    table,
)

Y = "underperforming"


@query(
    "one_hot",
    f"with {PLANTS_SQL} select id, "
    + ", ".join(f"cast(primary_fuel = '{f}' as integer) as is_{f.lower()}" for f in FUELS)
    + """, cast(fuel_group in ('ASIA', 'EUROPE') as integer) as is_old_world,
 cast(other_fuel1 <> '__NONE__' as integer) as has_other_fuel from plants""",
)
def one_hot(spark, sf):
    p = C.one_hot(plants(spark, sf), "primary_fuel", FUELS)
    return p.select(
        "id",
        *[f"is_{f.lower()}" for f in FUELS],
        C.in_group("fuel_group", ["ASIA", "EUROPE"]).alias("is_old_world"),
        C.not_sentinel("other_fuel1").alias("has_other_fuel"),
    )


@query(
    "row_interactions",
    f"""with {PLANTS_SQL} select id, round(plant_age / (capacity_log_mw + 0.1), 6) as age_per_cap,
 round(capacity_log_mw / (plant_age + 0.5), 6) as cap_per_age, round(plant_age * capacity_log_mw, 6) as age_cap,
 round(latitude * longitude, 6) as lat_lon, round(capacity_log_mw * capacity_log_mw, 6) as cap_sq,
 round(radians(latitude), 6) as lat_rad, round(sqrt(latitude * latitude + longitude * longitude), 6) as from_centre,
 round(least(greatest(capacity_log_mw / 8, 0.0), 1.0), 6) as clipped from plants""",
)
def row_interactions(spark, sf):
    return rounded(
        plants(spark, sf).select(
            "id",
            C.safe_ratio("plant_age", "capacity_log_mw", 0.1).alias("age_per_cap"),
            C.safe_ratio("capacity_log_mw", "plant_age", 0.5).alias("cap_per_age"),
            C.interact("plant_age", "capacity_log_mw").alias("age_cap"),
            C.interact("latitude", "longitude").alias("lat_lon"),
            C.square("capacity_log_mw").alias("cap_sq"),
            C.radians("latitude").alias("lat_rad"),
            C.norm2("latitude", "longitude").alias("from_centre"),
            C.clip01(F.col("capacity_log_mw") / 8).alias("clipped"),
        )
    )


@query(
    "masked_interactions",
    f"""with {PLANTS_SQL} select id,
 round(case when fuel_group = 'ASIA' then plant_age / (capacity_log_mw + 0.5) else 0.0 end, 6) as asia_old_small,
 round(case when primary_fuel = 'BUILDING' or primary_fuel = 'MACHINERY' then plant_age else 0.0 end, 6) as either_age,
 round((cast(primary_fuel = 'FURNITURE' as integer) + cast(primary_fuel = 'HOUSEHOLD' as integer)) * (5 - capacity_log_mw), 6) as pair_small,
 """
    + ", ".join(
        f"round(case when primary_fuel = '{f}' then capacity_log_mw else 0.0 end, 6) as {f.lower()}_capacity,"
        f" round(case when primary_fuel = '{f}' then plant_age else 0.0 end, 6) as {f.lower()}_age"
        for f in FUELS
    )
    + " from plants",
)
def masked_interactions(spark, sf):
    p = plants(spark, sf)
    fuel = F.col("primary_fuel")
    p = p.withColumns(
        {
            "asia_old_small": C.masked(C.safe_ratio("plant_age", "capacity_log_mw", 0.5), F.col("fuel_group") == "ASIA"),
            "either_age": C.masked(F.col("plant_age"), (fuel == "BUILDING") | (fuel == "MACHINERY")),
            "pair_small": (C.flag(fuel == "FURNITURE") + C.flag(fuel == "HOUSEHOLD")) * (5 - F.col("capacity_log_mw")),
        }
    )
    p = C.fan_out(p, "primary_fuel", FUELS, {"capacity": "capacity_log_mw", "age": "plant_age"})
    wanted = ["id", "asia_old_small", "either_age", "pair_small"]
    wanted += [f"{f.lower()}_{n}" for f in FUELS for n in ("capacity", "age")]
    return rounded(p.select(*C.pick_columns(p, wanted)))


@query(
    "bucketize",
    f"""with {PLANTS_SQL} select id, case when plant_age > 0 and plant_age <= 5 then 'new' when plant_age > 5 and plant_age <= 15 then 'young'
 when plant_age > 15 and plant_age <= 30 then 'mid' when plant_age > 30 and plant_age <= 50 then 'old'
 when plant_age > 50 and plant_age <= 150 then 'ancient' end as age_bin from plants""",
)
def bucketize(spark, sf):
    return plants(spark, sf).select("id", age_band("plant_age").alias("age_bin"))


@query(
    "combo_key",
    f"""with {PLANTS_SQL} select concat(primary_fuel, '_', capacity_band, '_', lat_band) as combo, count(*) as n
 from plants group by 1 having count(*) >= 5""",
)
def combo_key(spark, sf):
    keyed = plants(spark, sf).select(C.combo_key(["primary_fuel", "capacity_band", "lat_band"]).alias("combo"))
    return keyed.groupBy("combo").agg(F.count("*").alias("n")).filter("n >= 5")


@query(
    "map_values",
    f"""with {PLANTS_SQL} select id, round(case primary_fuel when 'AUTOMOBILE' then 1.5 when 'BUILDING' then 2.0 else 0.0 end
 * plant_age * capacity_log_mw, 6) as fuel_age_cap from plants""",
)
def map_values(spark, sf):
    factor = C.map_values("primary_fuel", {"AUTOMOBILE": 1.5, "BUILDING": 2.0}, 0.0)
    return rounded(plants(spark, sf).select("id", C.interact(factor, "plant_age", "capacity_log_mw").alias("fuel_age_cap")))


@query(
    "group_zscore",
    """select p_partkey, round((p_size - avg(p_size) over (partition by p_brand)) / (stddev_samp(p_size) over (partition by p_brand) + 0.01), 6) as p_size_z,
 round((p_retailprice - avg(p_retailprice) over (partition by p_brand)) / (stddev_samp(p_retailprice) over (partition by p_brand) + 0.01), 6) as p_retailprice_z
 from part""",
)
def group_zscore(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    z = windows.group_zscore(part, "p_brand", ["p_size", "p_retailprice"])
    return rounded(z.select("p_partkey", "p_size_z", "p_retailprice_z"))


@query(
    "zscore_apply",
    f"""with {FOLDED_PLANTS_SQL}, s as (select owner_bucket, avg(capacity_mw) as m, stddev_samp(capacity_mw) as d,
  avg(plant_age) as am, stddev_samp(plant_age) as ad from folded where fold <> 0 group by 1)
 select id, round((capacity_mw - m) / (d + 0.01), 6) as capacity_mw_z, round((plant_age - am) / (ad + 0.01), 6) as plant_age_z
 from folded left join s using (owner_bucket) where fold = 0""",
)
def zscore_apply(spark, sf):
    p = folded_plants(spark, sf)
    fitted = windows.fit_group_stats(p.filter("fold <> 0"), "owner_bucket", ["capacity_mw", "plant_age"])
    scored = windows.apply_group_zscore(p.filter("fold = 0"), fitted, "owner_bucket", ["capacity_mw", "plant_age"])
    return rounded(scored.select("id", "capacity_mw_z", "plant_age_z"))


@query(
    "rank_against",
    f"""with {FOLDED_PLANTS_SQL}, t as (select * from folded where fold = 0), r as (select * from folded where fold <> 0)
 select t.id, round(avg(case when r.plant_age <= t.plant_age then 1.0 else 0.0 end), 6) as at_most,
 round(avg(case when r.plant_age > t.plant_age then 1.0 else 0.0 end), 6) as greater
 from t left join r on t.primary_fuel = r.primary_fuel group by 1""",
)
def rank_against(spark, sf):
    p = folded_plants(spark, sf).select("id", "primary_fuel", "plant_age", "fold")
    test, train = p.filter("fold = 0"), p.filter("fold <> 0")
    out = windows.rank_against(test, train, "primary_fuel", "plant_age", "at_most")
    out = windows.rank_against(out, train, "primary_fuel", "plant_age", "greater", "greater")
    return rounded(out.select("id", "at_most", "greater"))


@query("folds", f"select doc_id, quality, {fold_sql('quality', 'doc_id', 10)} as fold from labels")
def folds(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return windows.stratified_folds(labels, "quality", 10, "doc_id")


@query(
    "stratified_split",
    """select o_orderkey, o_orderstatus, case when row_number() over (partition by o_orderstatus order by
 md5(concat(cast(o_orderkey as varchar), ':42')), o_orderkey) <= floor(count(*) over (partition by o_orderstatus) * 0.1::double + 0.5)
 then 'test' else 'train' end as split from orders""",
)
def stratified_split(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return windows.stratified_split(orders, "o_orderstatus", 0.1, "o_orderkey")


_SAMPLE = "order by md5(concat(cast(o_orderkey as varchar), ':42')), o_orderkey limit 2000"


@query("seeded_sample", f"select o_orderkey, o_totalprice from orders {_SAMPLE}")
def seeded_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return windows.seeded_sample(orders, 2000, key="o_orderkey")


@query(
    "anti_sample",
    f"""with s as (select o_orderkey from orders {_SAMPLE}) select count(*) as rest, round(sum(o_totalprice), 2) as total
 from orders where o_orderkey not in (select o_orderkey from s)""",
)
def anti_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    sample = windows.seeded_sample(orders, 2000, key="o_orderkey").select("o_orderkey")
    rest = joins.anti_join(orders, sample, "o_orderkey")
    return rounded(rest.agg(F.count("*").alias("rest"), F.sum("o_totalprice").alias("total")), 2)


@query(
    "top_k_per_key",
    """select p_brand, p_partkey, p_retailprice, rank from (select p_brand, p_partkey, p_retailprice,
 cast(row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as integer) as rank from part) where rank <= 3""",
)
def top_k_per_key(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return windows.top_k_per_key(part, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3)


@query(
    "first_by",
    """select p_brand, arg_min(p_retailprice, cast(p_size as bigint) * 1000000000 + p_partkey) filter (p_type = 'PROMO') as p_retailprice
 from part group by 1""",
)
def first_by(spark, sf):
    part = table(spark, sf, "part")
    return windows.first_by(part, ["p_brand"], "p_retailprice", ["p_size", "p_partkey"], F.col("p_type") == "PROMO")


def _te_sql(columns, m):
    ctes, joined = [], []
    for c in columns:
        ctes.append(
            f"f_{c} as (select {c}, fold, sum(y) as s, count(*) as n from encoded group by 1, 2), "
            f"a_{c} as (select {c}, sum(y) as s, count(*) as n from encoded group by 1)"
        )
        joined.append(
            f"round((cast(a_{c}.s - f_{c}.s as double) + {m}::double * g.g) / (a_{c}.n - f_{c}.n + {m}), 6) as {c}_te"
        )
    tables = " ".join(
        f"join f_{c} on f_{c}.{c} = e.{c} and f_{c}.fold = e.fold join a_{c} on a_{c}.{c} = e.{c}" for c in columns
    )
    return (
        f"with {ENCODED_SQL}, g as (select avg(y) as g from encoded), {', '.join(ctes)} "
        f"select e.id, {', '.join(joined)} from encoded e cross join g {tables}"
    )


def _te(m):
    def run(spark, sf):
        out = encode.target_encode_oof(encoded_base(spark, sf), ["k1", "k2", "k3"], "y", "fold", m)
        return rounded(out.select("id", "k1_te", "k2_te", "k3_te"))

    return run


for _m in (5, 10, 20):
    query(f"te_oof_{_m}", _te_sql(["k1", "k2", "k3"], _m))(_te(float(_m)))

_COMBO_SQL = ENCODED_SQL.replace("o.o_totalprice as x", "concat(o.o_orderpriority, '_', c.c_mktsegment) as k12, "
                                 "concat(o.o_orderpriority, '_', c.c_mktsegment, '_', n.n_name) as k123, o.o_totalprice as x")


def _with_combos(df):
    return df.withColumns({"k12": C.combo_key(["k1", "k2"]), "k123": C.combo_key(["k1", "k2", "k3"])})


@query("te_combo", _te_sql(["k12", "k123"], 20).replace(ENCODED_SQL, _COMBO_SQL))
def te_combo(spark, sf):
    out = encode.target_encode_oof(_with_combos(encoded_base(spark, sf)), ["k12", "k123"], "y")
    return rounded(out.select("id", "k12_te", "k123_te"))


@query(
    "te_apply",
    f"""with {_COMBO_SQL}, g as (select avg(y) as g from encoded where fold <> 0),
 t as (select k123, (sum(y) + 20 * max(g)) / (count(*) + 20) as te from encoded, g where fold <> 0 group by 1)
 select id, round(coalesce(te, g), 6) as k123_te from encoded cross join g left join t on t.k123 = encoded.k123 where fold = 0""",
)
def te_apply(spark, sf):
    base = _with_combos(encoded_base(spark, sf))
    fitted = encode.fit_target_encoding(base.filter("fold <> 0"), ["k123"], "y", 20.0)
    out = encode.apply_target_encoding(base.filter("fold = 0"), fitted, ["k123"])
    return rounded(out.select("id", "k123_te"))


def flagship(spark, sf):
    """Joins, folds, three target encodings and their mean as a score: exact AUC and AP."""
    base = encoded_base(spark, sf).withColumn("k12", C.combo_key(["k1", "k2"]))
    out = encode.target_encode_oof(base, ["k1", "k2", "k12"], "y", "fold", 20.0)
    score = F.round((F.col("k1_te") + F.col("k2_te") + F.col("k12_te")) / 3, 9)
    return rounded(ranking_scores(out.select("y", score.alias("score"))))


def _ranking_sql(source):
    return f"""v as (select score, sum(y) as p, sum(1 - y) as q from {source} group by 1),
 t as (select sum(p) as pp, sum(q) as qq from v),
 r as (select p, q, sum(q) over (order by score) - q as below, sum(p) over (order by score desc) as cp,
  sum(p + q) over (order by score desc) as cn from v),
 m as (select cast(sum(p * (below + q / 2.0::double)) as double) / (max(pp) * max(qq)) as auc,
  sum(cast(p as double) / pp * cast(cp as double) / cn) as ap from r, t)
 select round(auc, 6) as auc, round(ap, 6) as ap, round(0.7 * auc + 0.3 * ap, 6) as composite from m"""


def _flagship_sql():
    inner = _te_sql(["k1", "k2", "k12"], 20).replace(ENCODED_SQL, _COMBO_SQL)
    inner = inner.replace("select e.id,", "select e.id, e.y,").replace(", 6)", ", 15)")
    return f"with te as ({inner}), s as (select y, round((k1_te + k2_te + k12_te) / 3, 9) as score from te), {_ranking_sql('s')}"


query("encoded_score", _flagship_sql())(flagship)


@query(
    "label_index",
    """with v as (select distinct p_name as value from part union select distinct p_type from part)
 select value, row_number() over (order by value) - 1 as idx from v""",
)
def label_index(spark, sf):
    part = table(spark, sf, "part")
    index = encode.label_index([part.select(F.col("p_name").alias("v")), part.select(F.col("p_type").alias("v"))], "v")
    return index.select("value", "idx")


@query(
    "label_round_trip",
    """select p_partkey, p_brand, dense_rank() over (order by p_brand) - 1 as p_brand_idx, p_brand as again from part""",
)
def label_round_trip(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    index = encode.label_index([part], "p_brand")
    coded = encode.apply_label_index(part, index, "p_brand")
    return encode.label_name(coded, index, "p_brand_idx", "again")


_GAPS = "case when l_linenumber = 3 then null else l_quantity end as a, case when l_tax = 0 then null else l_tax end as b"


def _gaps(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linestatus",
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("a"),
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("b"),
    )


@query(
    "impute_median",
    f"""with g as (select l_linestatus, {_GAPS} from lineitem), m as (select quantile_cont(a, 0.5) as ma, quantile_cont(b, 0.5) as mb from g where l_linestatus = 'F')
 select l_linestatus, count(*) as n, round(sum(coalesce(a, ma)), 4) as a, round(sum(coalesce(b, mb)), 4) as b from g, m group by 1""",
)
def impute_median(spark, sf):
    g = _gaps(spark, sf)
    train, test = encode.impute_median(g.filter("l_linestatus = 'F'"), [g.filter("l_linestatus = 'O'")], ["a", "b"])
    both = encode.union_rows(train, test).groupBy("l_linestatus")
    return rounded(both.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")), 4)


@query(
    "fill_with_train_mean",
    f"""with g as (select l_linestatus, {_GAPS} from lineitem), m as (select avg(a) as ma, avg(b) as mb from g where l_linestatus = 'F')
 select count(*) as n, round(sum(coalesce(a, ma)), 4) as a, round(sum(coalesce(b, mb)), 4) as b from g, m where l_linestatus = 'O'""",
)
def fill_with_train_mean(spark, sf):
    g = _gaps(spark, sf)
    filled = encode.fill_with_train_mean(g.filter("l_linestatus = 'F'"), g.filter("l_linestatus = 'O'"), ["a", "b"])
    return rounded(filled.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")), 4)


@query(
    "standardize",
    f"""with {FOLDED_PLANTS_SQL}, s as (select avg(capacity_mw) as m, stddev_samp(capacity_mw) as d from folded where fold <> 0)
 select id, round((capacity_mw - m) / (d + 1e-8), 6) as capacity_mw_s from folded, s where fold = 0""",
)
def standardize(spark, sf):
    p = folded_plants(spark, sf).select("id", "capacity_mw", "fold")
    scaling = encode.fit_scaling(p.filter("fold <> 0"), ["capacity_mw"])
    return rounded(encode.standardize(p.filter("fold = 0"), scaling, ["capacity_mw"]).select("id", "capacity_mw_s"))


@query(
    "scale_population",
    """select p_partkey, round((p_size - (select avg(p_size) from part)) / (select stddev_pop(p_size) from part), 6) as p_size_s,
 round((p_retailprice - (select avg(p_retailprice) from part)) / (select stddev_pop(p_retailprice) from part), 6) as p_retailprice_s from part""",
)
def scale_population(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    out = encode.scale_population(part, ["p_size", "p_retailprice"])
    return rounded(out.select("p_partkey", "p_size_s", "p_retailprice_s"))


@query(
    "class_weights",
    """with c as (select toxic, count(*) as n from labels group by 1), t as (select sum(n) as rows, count(*) as classes from c)
 select doc_id, round(rows / (classes * n), 6) as weight, case when toxic = 1 then 2.5::double else 1.0::double end as fixed
 from labels join c using (toxic), t""",
)
def class_weights(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    out = encode.fixed_positive_weight(encode.class_weight_col(labels, "toxic"), "toxic", 2.5, "fixed")
    return rounded(out.select("doc_id", "weight", "fixed"))


@query(
    "lookup_default",
    """with d as (select p_brand, avg(p_retailprice) as m, count(*) as n from part where p_type = 'PROMO' group by 1 having count(*) > 12)
 select p_partkey, round(coalesce(m, -1.0), 6) as m from part left join d using (p_brand)""",
)
def lookup_default(spark, sf):
    part = table(spark, sf, "part")
    dim = (
        part.filter("p_type = 'PROMO'").groupBy("p_brand")
        .agg(F.avg("p_retailprice").alias("m"), F.count("*").alias("n")).filter("n > 12")
    )
    return rounded(joins.lookup(part.select("p_partkey", "p_brand"), dim, "p_brand", {"m": -1.0}, weight="n").drop("p_brand"))


@query(
    "attach_features",
    """with f as (select l_orderkey as id, count(*) as lines, round(sum(l_quantity), 6) as quantity from lineitem group by 1)
 select o_orderkey as id, o_orderstatus, lines, quantity from orders left join f on o_orderkey = id""",
)
def attach_features(spark, sf):
    features = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity")
    )
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return rounded(joins.attach_features(orders, features))


@query(
    "semi_top",
    """with t as (select o_custkey from orders group by 1 order by count(*) desc, o_custkey limit 10)
 select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from t)""",
)
def semi_top(spark, sf):
    from tarnfold.operators.stats import top_keys

    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return joins.semi_join(orders, F.broadcast(top_keys(orders, "o_custkey", 10).select("o_custkey")), "o_custkey")


@query(
    "cross_grid",
    """with g as (select * from (values (1, 0.5::double), (2, 1.5::double)) v(config_id, w))
 select cast(config_id as bigint) as config_id, round(sum(p_size * w), 6) as total from part, g group by 1""",
)
def cross_grid(spark, sf):
    tried = joins.cross_grid(table(spark, sf, "part").select("p_size"), [{"config_id": 1, "w": 0.5}, {"config_id": 2, "w": 1.5}])
    return rounded(tried.groupBy("config_id").agg(F.sum(F.col("p_size") * F.col("w")).alias("total")))


@query(
    "set_difference",
    """select distinct l.source as label from documents l where l.source not in
 (select source from documents where lang in ('de', 'es') and doc_id in (select doc_id from labels where toxic = 1))""",
)
def set_difference(spark, sf):
    docs = documents(spark, sf)
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    bad = joins.semi_join(docs.filter(F.col("lang").isin("de", "es")), toxic, "id")
    return encode.only_in(docs, bad, "label")


@query(
    "set_union",
    "select distinct lang from (select lang from documents union select role from conversations) where lang <> 'en'",
)
def set_union(spark, sf):
    talk = table(spark, sf, "conversations").select(F.col("role").alias("lang"))
    return encode.all_values(documents(spark, sf), talk, "lang", ["en"])


@query(
    "append_pseudo",
    """with t as (select doc_id, toxic as y from labels where quality = 1), p as (select doc_id, toxic as y from labels where quality = 0)
 select doc_id, y, count(*) as copies from (select * from t union all select * from p union all select * from p) group by 1, 2""",
)
def append_pseudo(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"), "quality")
    train, more = labels.filter("quality = 1").drop("quality"), labels.filter("quality = 0")
    grown = encode.append_pseudo(encode.append_pseudo(train, more), more)
    return grown.groupBy("doc_id", "y").agg(F.count("*").alias("copies"))

"""Rates, correlations, distributions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.operators import stats
from tarnfold.operators.windows import combined_pct, group_pct_rank
from tarnfold.plans.registry import query, rounded
from tarnfold.sources.views import FOLDED_PLANTS_SQL, PLANTS_SQL, folded_plants, plants, table

Y = "underperforming"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _orders(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.withColumn("y", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))


ORDERS_SQL = """o as (select *, case when o_orderstatus = 'F' then 1 else 0 end as y
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def _lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))


LINES_SQL = "l as (select *, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem)"


@query(
    "rate_by_priority",
    """select o_orderpriority, round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 6) as rate, count(*) as n,
 round(stddev_samp(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 6) as std
 from orders group by 1""",
)
def rate_by_priority(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return rounded(stats.rate_by(o, ["o_orderpriority"], "y", std=True))


@query(
    "crosstab_status",
    """select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O",
 count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1""",
)
def crosstab_status(spark, sf):
    return stats.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(
    "rate_matrix",
    f"with {ORDERS_SQL} select n_name, "
    + ", ".join(f"""round(avg(y) filter (c_mktsegment = '{s}'), 6) as "{s}" """ for s in SEGMENTS)
    + " from o group by 1",
)
def rate_matrix(spark, sf):
    return rounded(stats.rate_matrix(_orders(spark, sf), "n_name", "c_mktsegment", "y", SEGMENTS))


@query(
    "rate_cube",
    f"""with {ORDERS_SQL} select o_orderpriority, n_name, c_mktsegment, round(avg(y), 6) as rate, count(*) as n
 from o group by 1, 2, 3 having count(*) >= 10""",
)
def rate_cube(spark, sf):
    return rounded(stats.rate_cube(_orders(spark, sf), "n_name", "c_mktsegment", "o_orderpriority", "y", 10))


_GROUP_RATES = f"""with {ORDERS_SQL} select n_name, c_mktsegment, round(avg(y), 6) as rate, count(*) as n
 from o group by 1, 2 having count(*) >= 20"""


@query("top_groups", _GROUP_RATES + " order by rate desc, n_name, c_mktsegment limit 10")
def top_groups(spark, sf):
    rates = rounded(stats.rate_by(_orders(spark, sf), ["n_name", "c_mktsegment"], "y", min_count=20))
    return stats.top(rates, "rate", 10, ["n_name", "c_mktsegment"])


@query("bottom_groups", _GROUP_RATES + " order by rate, n_name, c_mktsegment limit 10")
def bottom_groups(spark, sf):
    rates = rounded(stats.rate_by(_orders(spark, sf), ["n_name", "c_mktsegment"], "y", min_count=20))
    return stats.top(rates, "rate", 10, ["n_name", "c_mktsegment"], ascending=True)


@query(
    "ordered_bands",
    f"""with {PLANTS_SQL} select capacity_band, round(avg({Y}), 6) as rate, count(*) as n,
 case capacity_band when 'tiny' then 1 when 'small' then 2 when 'medium' then 3 when 'large' then 4 when 'xlarge' then 5 else 6 end as position
 from plants group by 1""",
)
def ordered_bands(spark, sf):
    rates = stats.rate_by(plants(spark, sf), ["capacity_band"], Y)
    return rounded(stats.ordered(rates, "capacity_band", ["tiny", "small", "medium", "large", "xlarge", "utility"]))


KEY_SETS = [
    ["primary_fuel"],
    ["primary_fuel", "capacity_band"],
    ["primary_fuel", "other_fuel1"],
    ["primary_fuel", "lat_band"],
    ["primary_fuel", "lon_band"],
    ["primary_fuel", "capacity_band", "other_fuel1"],
    ["primary_fuel", "capacity_band", "lat_band"],
    ["primary_fuel", "capacity_band", "lon_band"],
    ["primary_fuel", "lat_band", "lon_band"],
    ["capacity_band", "lat_band", "lon_band"],
    ["primary_fuel", "capacity_band", "lat_band", "lon_band"],
    ["primary_fuel", "capacity_band", "other_fuel1", "lat_band"],
    ["primary_fuel", "capacity_band", "other_fuel1", "lon_band"],
]


def _variance_sql(key_set, min_count):
    keys = ", ".join(key_set)
    return f"""select '{"_".join(key_set)}' as grouping, count(*) as n_groups, cast(coalesce(sum(n), 0) as bigint) as covered,
 round(var_samp(rate), 6) as rate_variance, round(stddev_samp(rate), 6) as rate_std, round(min(rate), 6) as min_rate,
 round(max(rate), 6) as max_rate, round(max(rate) - min(rate), 6) as rate_range
 from (select {keys}, avg({Y}) as rate, count(*) as n from plants group by {keys}) where n >= {min_count}"""


@query("grouping_variance", f"with {PLANTS_SQL} " + " union all ".join(_variance_sql(s, 5) for s in KEY_SETS))
def grouping_variance(spark, sf):
    return rounded(stats.grouping_variance(plants(spark, sf), KEY_SETS, Y, 5))


SINGLES = ["primary_fuel", "capacity_band", "lat_band", "lon_band", "other_fuel1", "fuel_group"]


@query("discrimination", f"with {PLANTS_SQL} " + " union all ".join(_variance_sql([k], 1) for k in SINGLES))
def discrimination(spark, sf):
    return rounded(stats.discrimination(plants(spark, sf), SINGLES, Y))


@query(
    "interaction_matrix",
    f"with {PLANTS_SQL} "
    + " union all ".join(
        f"""select '{a}' as a, '{b}' as b, round(stddev_samp(rate), 6) as rate_std from
 (select avg({Y}) as rate from plants group by {a if a == b else f'{a}, {b}'})"""
        for a in SINGLES
        for b in SINGLES
    ),
)
def interaction_matrix(spark, sf):
    return rounded(stats.interaction_matrix(plants(spark, sf), SINGLES, Y))


@query(
    "purity",
    f"""with {PLANTS_SQL}, g as (select avg({Y}) as rate, count(*) as n from plants
 group by primary_fuel, capacity_band, lat_band having count(*) >= 5)
 select count(*) as n_groups, count(*) filter (rate = 0) as all_zero, count(*) filter (rate = 1) as all_one,
 count(*) filter (rate > 0.5) as above_half, count(*) filter (rate < 0.2) as below_fifth from g""",
)
def purity(spark, sf):
    return stats.purity_summary(plants(spark, sf), ["primary_fuel", "capacity_band", "lat_band"], Y, 5)


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "corr_with_label",
    f"with {LINES_SQL} "
    + " union all ".join(f"select '{c}' as feature, round(corr({c}, y), 6) as corr from l" for c in NUMS),
)
def corr_with_label(spark, sf):
    return rounded(stats.corr_with(_lines(spark, sf), NUMS, "y"))


@query(
    "top_abs_corr",
    f"with {LINES_SQL}, c as ("
    + " union all ".join(f"select '{c}' as feature, round(corr({c}, y), 6) as corr from l" for c in NUMS)
    + ") select * from c order by abs(corr) desc, feature limit 3",
)
def top_abs_corr(spark, sf):
    return stats.top_abs(rounded(stats.corr_with(_lines(spark, sf), NUMS, "y")), "corr", 3, ["feature"])


@query(
    "corr_matrix",
    f"with {LINES_SQL} "
    + " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from l" for a in NUMS for b in NUMS
    ),
)
def corr_matrix(spark, sf):
    return rounded(stats.corr_matrix(_lines(spark, sf), NUMS))


@query(
    "corr_by_group",
    f"with {LINES_SQL} "
    + " union all ".join(
        f"select l_linestatus, '{c}' as feature, round(corr({c}, y), 6) as corr from l group by 1" for c in NUMS
    ),
)
def corr_by_group(spark, sf):
    return rounded(stats.corr_by_group(_lines(spark, sf), "l_linestatus", NUMS, "y"))


@query(
    "pivot_metric",
    f"""with {LINES_SQL}, r as (select l_linestatus, l_linenumber, round(avg(y), 6) as rate from l group by 1, 2)
 select l_linenumber, max(rate) filter (l_linestatus = 'F') as "F", max(rate) filter (l_linestatus = 'O') as "O" from r group by 1""",
)
def pivot_metric(spark, sf):
    rates = stats.rate_by(_lines(spark, sf), ["l_linestatus", "l_linenumber"], "y")
    return rounded(stats.pivot_metric(rates, "l_linenumber", "l_linestatus", ["F", "O"], "rate", "max"))


def _describe_sql(c):
    return f"""select '{c}' as feature, count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
 round(min({c}), 6) as min, round(max({c}), 6) as max, round(quantile_cont({c}, 0.25), 6) as q25,
 round(quantile_cont({c}, 0.5), 6) as q50, round(quantile_cont({c}, 0.75), 6) as q75 from lineitem"""


@query("describe", " union all ".join(_describe_sql(c) for c in NUMS))
def describe(spark, sf):
    return rounded(stats.describe(table(spark, sf, "lineitem"), NUMS))


@query(
    "skew",
    "select round(skewness(p_retailprice), 6) as price_skew, round(skewness(p_size), 6) as size_skew from part",
)
def skew(spark, sf):
    part = table(spark, sf, "part")
    return rounded(part.agg(stats.skew("p_retailprice").alias("price_skew"), stats.skew("p_size").alias("size_skew")))


def _box_sql(c):
    return f"""select l_returnflag, '{c}' as feature, count({c}) as n, round(avg({c}), 6) as mean, round(min({c}), 6) as min,
 round(max({c}), 6) as max, round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.5), 6) as median,
 round(quantile_cont({c}, 0.75), 6) as q75 from lineitem group by 1"""


@query("box_stats", " union all ".join(_box_sql(c) for c in NUMS))
def box_stats(spark, sf):
    return rounded(stats.box_stats(table(spark, sf, "lineitem"), NUMS, "l_returnflag"))


# a tenth of the customers have no segment here, so that the NULL group is among the groups
_GAPS_SQL = "g as (select *, case when c_custkey % 10 = 0 then null else c_mktsegment end as segment from customer)"


def _with_gaps(spark, sf):
    c = table(spark, sf, "customer")
    return c.withColumn("segment", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")))


@query(
    "box_stats_null_group",
    f"""with {_GAPS_SQL} select segment, 'c_acctbal' as feature, count(c_acctbal) as n, round(avg(c_acctbal), 6) as mean,
 min(c_acctbal)::double as min, max(c_acctbal)::double as max, round(quantile_cont(c_acctbal, 0.25), 6) as q25,
 round(quantile_cont(c_acctbal, 0.5), 6) as median, round(quantile_cont(c_acctbal, 0.75), 6) as q75 from g group by 1""",
)
def box_stats_null_group(spark, sf):
    return rounded(stats.box_stats(_with_gaps(spark, sf), ["c_acctbal"], "segment"))


@query(
    "class_distribution_by_group",
    f"""with {_GAPS_SQL}, y as (select segment, case when c_acctbal < 0 then 1 else 0 end as owes from g),
 n as (select segment, owes, count(*) as n from y group by 1, 2)
 select segment, owes, n, round(n / sum(n) over (partition by segment), 6) as share from n""",
)
def class_distribution_by_group(spark, sf):
    owes = _with_gaps(spark, sf).withColumn("owes", F.when(F.col("c_acctbal") < 0, 1).otherwise(0))
    return rounded(stats.class_distribution(owes, "owes", ["segment"]))


def _histogram_sql(source, c, by, bins):
    return f"""(with e as (select {by}, min({c}) as lo, max({c}) as hi, count(*) as total from {source} group by 1),
 b as (select s.{by}, cast(least(floor((s.{c} - e.lo) * {bins} / (e.hi - e.lo)), {bins - 1}) as integer) as bin, count(*) as n
  from {source} s join e on s.{by} = e.{by} group by 1, 2)
 select e.{by}, '{c}' as feature, cast(g.i as integer) as bin, round(e.lo + g.i * ((e.hi - e.lo) / {bins}), 6) as left_edge,
 coalesce(b.n, 0) as n, round(coalesce(b.n, 0) / (e.total * ((e.hi - e.lo) / {bins})), 6) as density
 from e cross join (select unnest(range({bins})) as i) g left join b on b.{by} = e.{by} and b.bin = g.i)"""


@query("histogram", " union all ".join(_histogram_sql("lineitem", c, "l_returnflag", 50) for c in NUMS))
def histogram(spark, sf):
    return rounded(stats.histogram(table(spark, sf, "lineitem"), NUMS, 50, ["l_returnflag"]))


@query(
    "compare_distributions",
    f"""with {FOLDED_PLANTS_SQL}, s as (select *, case when fold = 0 then 'test' else 'train' end as split from folded) """
    + " union all ".join(_histogram_sql("s", c, "split", 20) for c in ("capacity_mw", "plant_age")),
)
def compare_distributions(spark, sf):
    p = folded_plants(spark, sf)
    train, test = p.filter("fold <> 0"), p.filter("fold = 0")
    return rounded(stats.compare_distributions(train, test, ["capacity_mw", "plant_age"], 20))


@query(
    "class_contrast",
    f"with {LINES_SQL} "
    + " union all ".join(
        f"""select l_linestatus, '{c}' as feature, round(avg({c}) filter (y = 1), 6) as mean_1,
 round(avg({c}) filter (y = 0), 6) as mean_0, round(avg({c}) filter (y = 1) - avg({c}) filter (y = 0), 6) as diff
 from l group by 1"""
        for c in NUMS
    ),
)
def class_contrast(spark, sf):
    return rounded(stats.class_contrast(_lines(spark, sf), "l_linestatus", NUMS, "y"))


@query(
    "class_distribution",
    "select o_orderstatus, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from orders group by 1",
)
def class_distribution(spark, sf):
    return rounded(stats.class_distribution(table(spark, sf, "orders"), "o_orderstatus"))


CARDINAL = ["p_name", "p_brand", "p_type", "p_size"]


@query(
    "cardinality",
    " union all ".join(f"select '{c}' as feature, count(distinct {c}) as n_distinct from part" for c in CARDINAL),
)
def cardinality(spark, sf):
    return stats.cardinality(table(spark, sf, "part"), CARDINAL)


@query(
    "combinations_possible",
    "select round("
    + " * ".join(f"cast(count(distinct {c}) as double)" for c in CARDINAL)
    + ", 6) as combinations from part",
)
def combinations_possible(spark, sf):
    return rounded(stats.combinations_possible(stats.cardinality(table(spark, sf, "part"), CARDINAL)))


@query(
    "mode_argmax",
    """with m as (select p_type as mode, count(*) as n from part group by 1 order by n desc, mode limit 1),
 g as (select p_brand as best_group, avg(p_size) as best_rate from part group by 1 order by best_rate desc, best_group limit 1),
 r as (select round(min(p_retailprice), 6) as low, round(max(p_retailprice), 6) as high from part)
 select mode, n, best_group, round(best_rate, 6) as best_rate, low, high from m, g, r""",
)
def mode_argmax(spark, sf):
    part = table(spark, sf, "part")
    best = stats.argmax_group(part, "p_brand", "p_size").agg(
        F.struct(F.max("best_group").alias("g"), F.max("best_rate").alias("r")).alias("b")
    )
    ends = part.agg(F.struct(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high")).alias("e"))
    return rounded(
        stats.mode_of(part, "p_type")
        .withColumns({"_b": best.scalar(), "_e": ends.scalar()})
        .select("mode", "n", F.col("_b.g").alias("best_group"), F.col("_b.r").alias("best_rate"), "_e.low", "_e.high")
    )


@query(
    "above_overall",
    """select p_brand, round(avg(p_size), 6) as rate, count(*) as n, round((select avg(p_size) from part), 6) as overall,
 cast(avg(p_size) > (select avg(p_size) from part) as integer) as above from part group by 1""",
)
def above_overall(spark, sf):
    return rounded(stats.above_overall(table(spark, sf, "part"), "p_brand", "p_size"))


@query(
    "above_parent",
    """with f as (select p_type, p_brand, count(*) as n, avg(p_size) as rate from part group by 1, 2),
 p as (select p_type, avg(p_size) as overall from part group by 1)
 select f.p_type, p_brand, n, round(rate, 6) as rate, round(overall, 6) as overall, cast(rate > overall as integer) as above
 from f join p on f.p_type = p.p_type""",
)
def above_parent(spark, sf):
    return rounded(stats.above_parent(table(spark, sf, "part"), "p_type", "p_brand", "p_size"))


@query(
    "coverage",
    f"with {LINES_SQL} "
    + " union all ".join(
        f"""select '{c}' as feature, round(avg(case when {c} is not null then 1.0 else 0.0 end), 6) as filled,
 round(avg(case when {c} > 0 then 1.0 else 0.0 end), 6) as positive from l"""
        for c in NUMS
    ),
)
def coverage(spark, sf):
    return rounded(stats.coverage(_lines(spark, sf), NUMS))


@query(
    "top_keys_stats",
    f"""with {ORDERS_SQL}, t as (select n_name from o group by 1 order by count(*) desc, n_name limit 8)
 select n_name, round(avg(y), 6) as rate, count(*) as n from o where n_name in (select n_name from t) group by 1""",
)
def top_keys_stats(spark, sf):
    return rounded(stats.top_keys_stats(_orders(spark, sf), "n_name", 8, "y"))


@query(
    "quantile_flags",
    """with q as (select quantile_cont(p_retailprice, 0.1) as lo, quantile_cont(p_retailprice, 0.9) as hi from part)
 select p_partkey, cast(p_retailprice < lo as integer) as p_retailprice_low, cast(p_retailprice > hi as integer) as p_retailprice_high
 from part, q""",
)
def quantile_flags(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return stats.quantile_flags(part, "p_retailprice").drop("p_retailprice")


_PCT = """(rank() over (partition by p_brand order by {c}) + (count(*) over (partition by p_brand, {c}) - 1) / 2.0)
 / count({c}) over (partition by p_brand)"""


@query(
    "group_pct_rank",
    f"""select p_partkey, round({_PCT.format(c='p_size')}, 6) as p_size_rank,
 round({_PCT.format(c='p_retailprice')}, 6) as p_retailprice_rank,
 round(({_PCT.format(c='p_size')} + {_PCT.format(c='p_retailprice')}) / 2.0, 6) as combined from part""",
)
def group_pct_rank_query(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    ranked = group_pct_rank(group_pct_rank(part, "p_brand", "p_size"), "p_brand", "p_retailprice")
    return rounded(
        ranked.select(
            "p_partkey", "p_size_rank", "p_retailprice_rank",
            combined_pct("p_size_rank", "p_retailprice_rank").alias("combined"),
        )
    )

"""The domain's inputs derived from the given tables, for Spark and as SQL text.

The tables have no coordinates, class probabilities or plant attributes; simple
arithmetic on whole tables, the same in both engines, supplies them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnfold.functions.columns import bucketize
from tarnfold.operators.windows import stratified_folds
from tarnfold.session import cut_lineage, spread
from tarnfold.sources.tables import read_table

BANDS = ("tiny", "small", "medium", "large", "xlarge", "utility")
FUELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("c_custkey")
    band = F.lit(BANDS[-1])
    for name, limit in reversed(list(zip(BANDS, (0, 2000, 4000, 6000, 8000)))):
        band = F.when(F.col("c_acctbal") < limit, F.lit(name)).otherwise(band)
    # one cluster of a few hundred kilometres per nation
    nation_key = F.col("c_nationkey")
    latitude = (nation_key * 37 % 120).cast("double") - 60 + (key * 7919 % 1000).cast("double") / 250
    longitude = (nation_key * 97 % 360).cast("double") - 180 + (key * 104729 % 997).cast("double") / 200
    return joined.select(
        key.alias("id"),
        F.col("c_mktsegment").alias("primary_fuel"),
        F.col("r_name").alias("fuel_group"),
        F.col("n_name").alias("owner_bucket"),
        F.when(key % 3 == 0, F.lit("__NONE__"))
        .otherwise(F.concat(F.lit("F"), (key % 4).cast("string")))
        .alias("other_fuel1"),
        band.alias("capacity_band"),
        (F.col("c_acctbal") + 1000).alias("capacity_mw"),
        F.ln(F.col("c_acctbal") + 1001).alias("capacity_log_mw"),
        ((key * 31) % 80).cast("double").alias("plant_age"),
        latitude.alias("latitude"),
        longitude.alias("longitude"),
        F.concat(F.lit("lat"), F.floor((latitude + 90) / 30).cast("string")).alias("lat_band"),
        F.concat(F.lit("lon"), F.floor((longitude + 180) / 60).cast("string")).alias("lon_band"),
        F.when((key * 48271) % 100 < 33, F.lit(1)).otherwise(F.lit(0)).alias("underperforming"),
    )


PLANTS_SQL = """plants as (
 select c.c_custkey as id, c.c_mktsegment as primary_fuel, r.r_name as fuel_group, n.n_name as owner_bucket,
  case when c.c_custkey % 3 = 0 then '__NONE__' else concat('F', cast(c.c_custkey % 4 as varchar)) end as other_fuel1,
  case when c.c_acctbal < 0 then 'tiny' when c.c_acctbal < 2000 then 'small' when c.c_acctbal < 4000 then 'medium'
       when c.c_acctbal < 6000 then 'large' when c.c_acctbal < 8000 then 'xlarge' else 'utility' end as capacity_band,
  c.c_acctbal + 1000 as capacity_mw, ln(c.c_acctbal + 1001) as capacity_log_mw,
  cast((c.c_custkey * 31) % 80 as double) as plant_age,
  (cast(c.c_nationkey * 37 % 120 as double) - 60 + cast(c.c_custkey * 7919 % 1000 as double) / 250) as latitude, (cast(c.c_nationkey * 97 % 360 as double) - 180 + cast(c.c_custkey * 104729 % 997 as double) / 200) as longitude,
  concat('lat', cast(cast(floor(((cast(c.c_nationkey * 37 % 120 as double) - 60 + cast(c.c_custkey * 7919 % 1000 as double) / 250) + 90) / 30) as bigint) as varchar)) as lat_band,
  concat('lon', cast(cast(floor(((cast(c.c_nationkey * 97 % 360 as double) - 180 + cast(c.c_custkey * 104729 % 997 as double) / 200) + 180) / 60) as bigint) as varchar)) as lon_band,
  case when (c.c_custkey * 48271) % 100 < 33 then 1 else 0 end as underperforming
 from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey)"""


def fold_sql(y: str, key: str, k: int, seed: int = SEED) -> str:
    return (
        f"cast((row_number() over (partition by {y} order by "
        f"md5(concat(cast({key} as varchar), ':{seed}')), {key}) - 1) % {k} as integer)"
    )


def folded_plants(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Folded once: every later step scans the same assignment, not the joins behind it."""
    return cut_lineage(stratified_folds(plants(spark, sf_dir), "underperforming", k, "id", SEED))


FOLDED_PLANTS_SQL = (
    PLANTS_SQL + f""",
 folded as (select *, {fold_sql('underperforming', 'id', 5)} as fold from plants)"""
)


def encoded_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    base = joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("k1"),
        F.col("c_mktsegment").alias("k2"),
        F.col("n_name").alias("k3"),
        F.col("o_totalprice").alias("x"),
        F.when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(0)).alias("y"),
    )
    return cut_lineage(stratified_folds(base, "y", 5, "id", SEED))


ENCODED_SQL = f"""base as (
 select o.o_orderkey as id, o.o_orderpriority as k1, c.c_mktsegment as k2, n.n_name as k3, o.o_totalprice as x,
  case when o.o_orderstatus = 'F' then 1 else 0 end as y
 from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey),
 encoded as (select *, {fold_sql('y', 'id', 5)} as fold from base)"""

MODELS, CLASSES = 3, 4


def proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three four-class models: arrays ``p_m0..p_m2`` that sum to one, and ``y``."""
    vectors = table(spark, sf_dir, "embeddings")
    y = F.col("label") % CLASSES
    out = [F.col("vec_id").alias("id"), y.alias("y")]
    for m in range(MODELS):
        raw = [
            F.exp(
                F.lit(4.0) * F.get("embedding", m * CLASSES + j).cast("double")
                + F.when(y == j, F.lit(0.5)).otherwise(F.lit(0.0))
            )
            for j in range(CLASSES)
        ]
        total = raw[0] + raw[1] + raw[2] + raw[3]
        out.append(F.array(*[r / total for r in raw]).alias(f"p_m{m}"))
    return vectors.select(*out)


def folded_proba(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    return cut_lineage(stratified_folds(proba(spark, sf_dir), "y", k, "id", SEED))


def _proba_sql() -> str:
    raw = ", ".join(
        f"exp(4.0::double * cast(embedding[{m * CLASSES + j + 1}] as double)"
        f" + case when label % 4 = {j} then 0.5::double else 0.0::double end) as r{m}{j}"
        for m in range(MODELS)
        for j in range(CLASSES)
    )
    shares = ", ".join(
        f"r{m}{j} / (r{m}0 + r{m}1 + r{m}2 + r{m}3) as m{m}p{j}" for m in range(MODELS) for j in range(CLASSES)
    )
    return (
        f"raw as (select vec_id as id, label % 4 as y, {raw} from embeddings),\n"
        f" proba as (select id, y, {shares} from raw)"
    )


PROBA_SQL = _proba_sql()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread(scan, "doc_id").select(
        F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("label")
    )


def age_band(column: str):
    return bucketize(column, (0, 5, 15, 30, 50, 150), ("new", "young", "mid", "old", "ancient"))

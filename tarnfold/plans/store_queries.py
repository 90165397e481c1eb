"""Stores and sinks: what was written comes back as it was computed, from whole tables."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.sql import SparkSession, functions as F, types as T

from tarnfold.operators import metrics, stats
from tarnfold.plans.feature_queries import _ranking_sql
from tarnfold.plans.registry import query, rounded
from tarnfold.session import ensure_checkpoint_dir
from tarnfold.sources import tables
from tarnfold.sources.views import PLANTS_SQL, PROBA_SQL, folded_proba, plants, table


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4()}"


@query(
    "stored_features",
    """select o_custkey as id, count(*) as n_orders, round(avg(o_totalprice), 6) as mean_price, true as read_back from orders group by 1""",
)
def stored_features(spark, sf):
    path, computed = f"{_folder(spark)}/features", []

    def compute():
        computed.append(1)
        per_customer = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"))
        return per_customer.agg(F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.lit(1).alias("y"))

    tables.load_or_compute(spark, path, compute, store=True)
    again = tables.load_or_compute(spark, path, compute, drop=["y"])
    return rounded(again).withColumn("read_back", F.lit(len(computed) == 1))


@query("selected_signals", f"select vec_id as id, {', '.join(f'embedding[{i}] as X{i}' for i in range(1, 17))} from embeddings")
def selected_signals(spark, sf):
    signals = [F.get("embedding", i - 1).alias(f"X{i}") for i in range(1, 25)]
    wide = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", *signals)
    return tables.select_features(wide, keep=["id"])


_PREDICTIONS = T.StructType([T.StructField("id", T.LongType()), T.StructField("underperforming", T.DoubleType())])


@query("prediction_sink", f"with {PLANTS_SQL} select id, plant_age / 128 as underperforming from plants")
def prediction_sink(spark, sf):
    path = f"{_folder(spark)}/predictions"
    # 128ths are whole in binary and in text
    tables.write_predictions(plants(spark, sf).withColumn("p", F.col("plant_age") / 128), path, "p", name="underperforming")
    return tables.read_table(spark, path, _PREDICTIONS, format="csv")


@query(
    "table_sink",
    "select n_name, r_name from nation join region on n_regionkey = r_regionkey",
)
def table_sink(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    path = _folder(spark)
    tables.write_table(names, f"{path}/parquet")
    tables.write_table(tables.read_table(spark, f"{path}/parquet"), f"{path}/csv", "csv")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("n_name", "r_name")])
    return tables.read_table(spark, f"{path}/csv", schema, format="csv")


@query(
    "approach_sink",
    f"""with {PLANTS_SQL} select id, 'direct' as approach, primary_fuel as label from plants
 union all select id, 'keyword', other_fuel1 from plants""",
)
def approach_sink(spark, sf):
    path = f"{_folder(spark)}/approaches"
    wide = plants(spark, sf).select("id", F.col("primary_fuel").alias("direct"), F.col("other_fuel1").alias("keyword"))
    tables.write_by_approach(tables.by_approach(wide, ["direct", "keyword"]), path)
    return spark.read.schema("id bigint, label string, approach string").option("header", True).csv(path)


@query(
    "stored_model",
    """select c_custkey as id, c_mktsegment as segment, cast(dense_rank() over (order by c_mktsegment) - 1 as double) as number from customer""",
)
def stored_model(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    indexer = StringIndexer(inputCol="segment", outputCol="number", stringOrderType="alphabetAsc")
    path = f"{_folder(spark)}/model"
    tables.save_model(Pipeline(stages=[indexer]).fit(rows), path)
    return tables.load_model(path).transform(rows)


@query(
    "usable_columns",
    """with c as (select count(*) filter (doc_id % 2 = 0) as a, count(*) filter (doc_id < 5) as b, count(*) as c from documents)
 select name from (select unnest(['half', 'few', 'all']) as name, unnest([a, b, c]) as n from c) where n > 10""",
)
def usable_columns(spark, sf):
    key = F.col("doc_id")
    docs = table(spark, sf, "documents").select(
        F.when(key % 2 == 0, key).alias("half"), F.when(key < 5, key).alias("few"), key.alias("all")
    )
    names = stats.usable_columns(docs, ["half", "few", "all"])
    return spark.createDataFrame([(n,) for n in names], "name string")


@query(
    "oof_score",
    f"with {PROBA_SQL}, s as (select case when y = 3 then 1 else 0 end as y, m0p3 as score from proba), {_ranking_sql('s')}",
)
def oof_score(spark, sf):
    oof = folded_proba(spark, sf).select(F.when(F.col("y") == 3, 1).otherwise(0).alias("y"), F.get("p_m0", 3).alias("score"), "fold")
    return rounded(metrics.oof_score(oof))

"""Sources, sinks and stored models."""

import pytest
from pyspark.sql import functions as F

from tarnfold.functions import columns as C
from tarnfold.operators import models, stats
from tarnfold.sources import tables
from tarnfold.sources.views import documents, table

SF = "/root/testdata/sf0.001"


def test_csv_columns_are_found_by_name_and_nan_is_null(spark, tmp_path):
    path = tmp_path / "plants.csv"
    path.write_text("plant_age,id,primary_fuel,extra\n1.5,7,Gas,x\nNaN,8,,y\n")
    df = tables.read_table(spark, str(path), tables.PLANTS)
    assert df.dtypes == [("plant_age", "double"), ("id", "bigint"), ("primary_fuel", "string")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1.5, 7, "Gas"), (None, 8, None)]


def test_csv_text_may_hold_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "messages.csv"
    path.write_text('id,text,language\n1,"a ""b"",\nc",en\n2,plain,de\n')
    rows = tables.read_table(spark, str(path), tables.MESSAGES).orderBy("id").collect()
    assert [r.text for r in rows] == ['a "b",\nc', "plain"]


def test_csv_without_schema_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "x.csv"))


def test_parquet_scan_reads_only_what_is_used(spark):
    plan = table(spark, SF, "lineitem").filter("l_quantity > 40").select("l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


def test_load_or_compute(spark, tmp_path):
    path, calls = str(tmp_path / "features"), []

    def compute():
        calls.append(1)
        return spark.range(3).withColumn("y", F.lit(1))

    for _ in range(2):
        df = tables.load_or_compute(spark, path, compute, drop=["y"], store=True)
        assert df.columns == ["id"] and df.count() == 3
    assert len(calls) == 1
    assert tables.load_or_compute(spark, str(tmp_path / "none"), compute).count() == 3
    assert not tables.path_exists(spark, str(tmp_path / "none"))


def test_a_store_without_the_mark_of_success_does_not_count(spark, tmp_path):
    path = str(tmp_path / "features")
    spark.range(5).write.parquet(path)
    (tmp_path / "features" / "_SUCCESS").unlink()  # as a job leaves it that died while it wrote
    assert tables.path_exists(spark, path) and not tables.is_committed(spark, path)
    assert tables.load_or_compute(spark, path, lambda: spark.range(3)).count() == 3
    assert not tables.is_committed(spark, path)
    assert tables.load_or_compute(spark, path, lambda: spark.range(4), store=True).count() == 4
    assert tables.is_committed(spark, path)
    assert tables.load_or_compute(spark, path, lambda: spark.range(9)).count() == 4
    file = next((tmp_path / "features").glob("*.parquet"))
    assert tables.is_committed(spark, str(file))


def test_feature_projection(spark):
    df = spark.createDataFrame([tuple(range(18))], ["id", *[f"X{i}" for i in range(1, 17)], "other"])
    assert tables.select_features(df, keep=["id"]).columns == ["id", *[f"X{i}" for i in range(1, 17)]]


def test_prediction_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.25, "a", "b"), (2, 0.5, "c", "d")], "id long, p double, direct string, keyword string")
    tables.write_predictions(df, str(tmp_path / "p"), "p", name="underperforming")
    back = spark.read.option("header", True).csv(str(tmp_path / "p"))
    assert back.columns == ["id", "underperforming"] and back.count() == 2
    long = tables.by_approach(df, ["direct", "keyword"])
    tables.write_by_approach(long, str(tmp_path / "many"))
    assert sorted(p.name for p in (tmp_path / "many").glob("approach=*")) == ["approach=direct", "approach=keyword"]
    tables.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    tables.write_table(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == df.columns


def test_stored_text_model_keeps_its_labels(spark, tmp_path):
    docs = documents(spark, SF).select("id", "text", F.col("lang").alias("label"))
    model = models.fit_text_classifier(docs, buckets=1 << 10, ngrams=1)
    tables.save_model(model, str(tmp_path / "model"))
    tables.save_model(model, str(tmp_path / "model"), overwrite=True)
    again = tables.load_model(str(tmp_path / "model")).transform(docs.drop("label"))
    right = again.join(docs.select("id", F.col("label").alias("truth")), "id").filter("predicted = truth").count()
    assert right / docs.count() > 0.9


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a", "b", "nn_x", "nn_y"])
    assert C.pick_columns(df, ["nn_y", "missing"], ["nn_x", "nn_y"], 12) == ["nn_y", "nn_x"]
    assert C.pick_columns(df, ["b", "a", "zz"]) == ["b", "a"]


def test_usable_columns(spark):
    df = spark.range(20).select("id", F.when(F.col("id") < 5, F.col("id")).alias("few"))
    assert stats.usable_columns(df, ["id", "few"], 10) == ["id"]


def test_row_functions_run_on_a_stream(spark, tmp_path):
    scan = table(spark, SF, "part")
    scan.limit(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scan.schema).parquet(str(tmp_path / "in"))
    out = C.one_hot(stream, "p_type", ["PROMO"]).withColumn("ratio", C.safe_ratio("p_size", "p_retailprice"))
    query = out.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("scored").count() == 50

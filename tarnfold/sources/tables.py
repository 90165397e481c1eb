"""Typed sources, prediction sinks and model storage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

PLANTS = T.StructType(
    [T.StructField("id", T.LongType())]
    + [
        T.StructField(c, T.StringType())
        for c in (
            "fuel_group", "primary_fuel", "other_fuel1", "owner_bucket", "capacity_band", "lat_band", "lon_band",
        )
    ]
    + [
        T.StructField(c, T.DoubleType())
        for c in (
            "capacity_mw", "capacity_log_mw", "plant_age", "abs_latitude", "latitude", "longitude", "age_x_capacity",
        )
    ]
    + [T.StructField("underperforming", T.IntegerType())]
)
SIGNALS = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(f"X{i}", T.DoubleType()) for i in range(1, 17)]
    + [T.StructField("y", T.IntegerType())]
)
MESSAGES = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("text", "language", "label")]
)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, format: str | None = None
) -> DataFrame:
    """Read parquet or headed CSV. CSV needs a schema: inferring one costs a pass over the data.

    Columns of a CSV are found by header name, so a test file may lack the label; NaN
    becomes NULL.
    """
    format = format or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    if format == "parquet":
        df = spark.read.parquet(path)
        return df if schema is None else df.select(*[f.name for f in schema if f.name in df.columns])
    if schema is None:
        raise ValueError("a CSV source needs a schema")
    header = spark.read.option("header", True).csv(path).columns
    by_name = {f.name: f for f in schema}
    typed = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in header])
    df = (
        spark.read.schema(typed)
        .option("header", True)
        .option("multiLine", any(isinstance(f.dataType, T.StringType) and f.name == "text" for f in typed))
        .option("escape", '"')
        .csv(path)
    )
    return nan_to_null(df.select(*[c for c in header if c in by_name]))


def nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system the path belongs to (local, HDFS, object store)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a stored table is whole: a file, or a folder whose job left its mark of success.

    A job that died leaves files without the mark, and those do not count as a table.
    """
    if not path_exists(spark, path):
        return False
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    return status.isFile() or path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def load_or_compute(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], drop: Sequence[str] = (), store: bool = False
) -> DataFrame:
    """Stored features where they are whole, else computed (and stored on request).

    What a dead job left at ``path`` is computed again, and replaced when storing. ``drop`` names
    columns, such as the label, that may have been stored along.
    """
    if not is_committed(spark, path):
        computed = compute()
        if not store:
            return computed.drop(*drop)
        computed.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop(*drop)


def select_features(df: DataFrame, prefix: str = "X", n: int = 16, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[f"{prefix}{i}" for i in range(1, n + 1)])


def write_predictions(
    df: DataFrame, path: str, prediction: str = "prediction", key: str = "id", name: str | None = None, mode: str = "error"
) -> None:
    """``(id, prediction)`` as headed CSV, one file per partition."""
    df.select(key, F.col(prediction).alias(name or prediction)).write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if format == "csv" else writer.format(format).save(path)


def write_by_approach(
    df: DataFrame, path: str, approach: str = "approach", format: str = "csv", mode: str = "error"
) -> None:
    """One folder per approach from a long ``(approach, id, prediction)`` table, in one job."""
    df.write.mode(mode).partitionBy(approach).option("header", True).format(format).save(path)


def by_approach(df: DataFrame, predictions: Sequence[str], key: str = "id", out: str = "label") -> DataFrame:
    """Wide prediction columns to the long table that :func:`write_by_approach` takes."""
    cells = F.array(
        *[F.struct(F.lit(p).alias("approach"), F.col(p).cast("string").alias(out)) for p in predictions]
    )
    return df.select(key, F.inline(cells))


def save_model(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    """The label list travels inside the pipeline's label stage."""
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

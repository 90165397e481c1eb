"""Target encoding, label indexes, imputation, scaling and row-set operations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tarnfold.operators.joins import lookup, measured
from tarnfold.operators.ordering import exact_quantiles, running_totals


@dataclass
class TargetEncoding:
    """Smoothed means per (feature, key[, fold]) and the global mean behind them."""

    table: DataFrame
    prior: DataFrame
    rows: int
    fold: str | None = None


def _long_keys(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("key")) for c in columns]
    )
    return df.select(*keep, F.inline(cells)).filter(F.col("key").isNotNull())


def fit_target_encoding(
    df: DataFrame, columns: Sequence[str], y: str, m: float = 20.0, fold: str | None = None
) -> TargetEncoding:
    """``(n * mean + m * g) / (n + m)`` per key, all columns from one scan.

    With ``fold`` the entry of (key, fold) is built from the other folds: the key's
    totals less its own fold, instead of one pass per fold.
    """
    prior = df.agg(F.avg(y).alias("g"))
    keep = [y] + ([fold] if fold else [])
    by = ["feature", "key"] + ([fold] if fold else [])
    sums = (
        _long_keys(df, columns, keep)
        .groupBy(*by)
        .agg(F.sum(y).cast("double").alias("s"), F.count(y).alias("n"))
    )
    s, n = F.col("s"), F.col("n")
    if fold:
        whole = W.partitionBy("feature", "key")  # one row per fold
        s, n = F.sum("s").over(whole) - s, F.sum("n").over(whole) - n
    encoded = sums.select(
        *by, F.col("n"), ((s + F.lit(float(m)) * prior.scalar()) / (n + F.lit(float(m)))).alias("te")
    )
    table, rows = measured(encoded)
    return TargetEncoding(table, prior, rows, fold)


def apply_target_encoding(
    df: DataFrame, encoding: TargetEncoding, columns: Sequence[str], suffix: str = "_te"
) -> DataFrame:
    """Add ``<column><suffix>``; a key that was never seen gets the global mean."""
    keys = ["_key"] + ([encoding.fold] if encoding.fold else [])
    out = df
    for c in columns:
        entries = encoding.table.filter(F.col("feature") == c).select(
            F.col("key").alias("_key"), *keys[1:], "n", F.col("te").alias(f"{c}{suffix}")
        )
        out = lookup(
            out.withColumn("_key", F.col(c).cast("string")),
            entries,
            keys,
            default={f"{c}{suffix}": encoding.prior.scalar()},
            weight="n",
            rows=encoding.rows,
        ).drop("_key")
    return out


def target_encode_oof(
    df: DataFrame, columns: Sequence[str], y: str, fold: str = "fold", m: float = 20.0
) -> DataFrame:
    return apply_target_encoding(df, fit_target_encoding(df, columns, y, m, fold), columns)


def label_index(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """``(value, idx)``: 0-based place of every value in the sorted union of the frames."""
    values = union_rows(*[f.select(F.col(column).cast("string").alias("value")) for f in frames])
    vals = values.filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("rows"))
    vals = vals.select("value", "rows", F.lit(1).alias("one"))
    ranked = running_totals(vals, [], "value", ["one"])
    return ranked.select("value", "rows", (F.col("one_upto") - 1).cast("long").alias("idx"))


def apply_label_index(df: DataFrame, index: DataFrame, column: str, out: str | None = None) -> DataFrame:
    side = index.select(F.col("value").alias(column), "rows", F.col("idx").alias(out or f"{column}_idx"))
    return lookup(df, side, column, weight="rows")


def label_name(df: DataFrame, index: DataFrame, column: str, out: str) -> DataFrame:
    side = index.select(F.col("idx").alias(column), "rows", F.col("value").alias(out))
    return lookup(df, side, column, weight="rows")


def fit_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, one struct: exact median per column."""
    table = exact_quantiles(df, columns, [0.5])
    return table.agg(
        F.struct(*[F.max(F.when(F.col("feature") == c, F.col("q0"))).alias(c) for c in columns]).alias("fill")
    )


def fit_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("fill"))


def fill_from(df: DataFrame, fill: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill NULL and NaN from a one-row struct of values."""
    filled = df.withColumn("_fill", fill.scalar())
    return filled.withColumns(
        {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.col(f"_fill.{c}")) for c in columns}
    ).drop("_fill")


def impute_median(
    train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]
) -> list[DataFrame]:
    fill = fit_medians(train, columns)
    return [fill_from(f, fill, columns) for f in [train, *others]]


def fill_with_train_mean(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_from(test, fit_means(train, columns), columns)


def fit_scaling(df: DataFrame, columns: Sequence[str], population: bool = False) -> DataFrame:
    deviation = F.stddev_pop if population else F.stddev_samp
    return df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[deviation(c).alias(f"{c}_std") for c in columns],
        ).alias("s")
    )


def standardize(
    df: DataFrame, scaling: DataFrame, columns: Sequence[str], eps: float = 1e-8, suffix: str = "_s"
) -> DataFrame:
    scaled = df.withColumn("_s", scaling.scalar())
    return scaled.withColumns(
        {
            f"{c}{suffix}": F.try_divide(
                F.col(c) - F.col(f"_s.{c}_mean"), F.col(f"_s.{c}_std") + F.lit(eps)
            )
            for c in columns
        }
    ).drop("_s")


def scale_population(df: DataFrame, columns: Sequence[str], suffix: str = "_s") -> DataFrame:
    return standardize(df, fit_scaling(df, columns, population=True), columns, 0.0, suffix)


def class_weight_col(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """Balanced weights ``n / (k * n_class)``."""
    counts = df.filter(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("n"))
    sizes = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes")).alias("t"))
    weights = counts.withColumn("_t", sizes.scalar()).select(
        y, "n", (F.col("_t.rows") / (F.col("_t.classes") * F.col("n"))).alias(out)
    )
    return lookup(df, weights, y, weight="n")


def fixed_positive_weight(df: DataFrame, y: str, weight: float, out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.when(F.col(y) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))


def union_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def append_pseudo(train: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Duplicates stay: a test row may be appended again in a later round."""
    return train.unionByName(pseudo.select(*train.columns))


def only_in(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).distinct().subtract(b.select(column).distinct())


def all_values(a: DataFrame, b: DataFrame, column: str, without: Sequence = ()) -> DataFrame:
    values = a.select(column).union(b.select(column)).distinct()
    return values.filter(~F.col(column).isin(list(without))) if without else values

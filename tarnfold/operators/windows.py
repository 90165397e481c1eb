"""Within-group features, folds, splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarnfold.operators.joins import lookup, measured
from tarnfold.operators.ordering import hash_rank, running_totals


def fit_group_stats(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation per group; ``n`` is the group's row count."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count("*").alias("n"),
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_samp(c).alias(f"{c}_std") for c in columns],
        )
    )


def apply_group_zscore(
    df: DataFrame, stats: DataFrame, group: str, columns: Sequence[str], eps: float = 0.01
) -> DataFrame:
    """``(x - mean) / (std + eps)`` with given statistics; an unknown group gives NULL."""
    joined = lookup(df, stats, group, weight="n")
    return joined.select(
        *df.columns,
        *[
            ((F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_std") + F.lit(eps))).alias(f"{c}_z")
            for c in columns
        ],
    )


def group_zscore(df: DataFrame, group: str, columns: Sequence[str], eps: float = 0.01) -> DataFrame:
    return apply_group_zscore(df, fit_group_stats(df, group, columns), group, columns, eps)


def group_pct_rank(df: DataFrame, group: str, column: str, out: str | None = None) -> DataFrame:
    """Ascending rank in the group, ties averaged, over the non-null count."""
    out = out or f"{column}_rank"
    vals = (
        df.filter(F.col(column).isNotNull() & F.col(group).isNotNull())
        .groupBy(group, column)
        .agg(F.count("*").alias("n"))
    )
    vals, rows = measured(vals)
    ranked = running_totals(vals, [group], column, ["n"], rows).select(
        group,
        column,
        "n",
        ((F.col("n_upto") - (F.col("n") - 1) / 2.0) / F.col("n_all")).alias(out),
    )
    return lookup(df, ranked, [group, column], weight="n", rows=rows)


def rank_against(
    df: DataFrame,
    reference: DataFrame,
    group: str,
    column: str,
    out: str | None = None,
    direction: str = "at_most",
) -> DataFrame:
    """Share of the group's reference values that are ``at_most`` (or ``greater`` than) mine.

    A running count over the distinct values of both tables; no pair of rows is formed.
    """
    out = out or f"{column}_rank"
    both = reference.select(
        group, column, F.lit(1).alias("is_ref"), F.lit(0).alias("is_query")
    ).unionByName(df.select(group, column, F.lit(0).alias("is_ref"), F.lit(1).alias("is_query")))
    vals = (
        both.filter(F.col(column).isNotNull() & F.col(group).isNotNull())
        .groupBy(group, column)
        .agg(F.sum("is_ref").alias("ref"), F.sum("is_query").alias("n"))
    )
    share = F.try_divide(F.col("ref_upto").cast("double"), F.col("ref_all").cast("double"))
    if direction == "greater":
        share = F.lit(1.0) - share
    elif direction != "at_most":
        raise ValueError("direction is 'at_most' or 'greater'")
    vals, rows = measured(vals)
    ranked = (
        running_totals(vals, [group], column, ["ref", "n"], rows)
        .filter(F.col("n") > 0)
        .select(group, column, "n", share.alias(out))
    )
    return lookup(df, ranked, [group, column], weight="n", rows=rows)


def combined_pct(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return (a + b) / 2.0


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key; Spark keeps only ``k`` per key and task before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def first_by(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], where: Column | None = None
) -> DataFrame:
    """Value of the row that comes first in the given order, among rows meeting ``where``."""
    rank = F.struct(*order)
    if where is not None:
        rank = F.when(where, rank)
    return df.groupBy(*keys).agg(F.min_by(value, rank).alias(value))


def stratified_folds(df: DataFrame, y: str, k: int, key: str = "id", seed: int = 42) -> DataFrame:
    """Fold ids 0..k-1 whose sizes differ by at most one within every class."""
    return hash_rank(df, key, seed, by=[y]).select(
        *df.columns, F.pmod("_rank", F.lit(k)).cast("int").alias("fold")
    )


def stratified_split(
    df: DataFrame, y: str, holdout: float = 0.1, key: str = "id", seed: int = 42
) -> DataFrame:
    """Add ``split``: ``test`` for the given share of every class, else ``train``."""
    quota = F.floor(F.col("_size") * F.lit(holdout) + F.lit(0.5))
    return hash_rank(df, key, seed, by=[y]).select(
        *df.columns,
        F.when(F.col("_rank") < quota, F.lit("test")).otherwise(F.lit("train")).alias("split"),
    )


def seeded_sample(
    df: DataFrame,
    n: int | None = None,
    fraction: float | None = None,
    key: str = "id",
    seed: int = 42,
) -> DataFrame:
    """Exactly ``n`` rows, or ``floor(rows * fraction)``, in seeded hash order."""
    if (n is None) == (fraction is None):
        raise ValueError("give n or fraction")
    quota = F.lit(n) if n is not None else F.floor(F.col("_size") * F.lit(fraction))
    return hash_rank(df, key, seed, below=quota).select(*df.columns)

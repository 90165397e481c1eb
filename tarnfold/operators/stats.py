"""Grouped rates, correlations, distributions and ordered reports."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tarnfold.operators.joins import lookup, match, semi_join
from tarnfold.operators.ordering import exact_quantiles, melt


def rate_by(
    df: DataFrame, keys: Sequence[str], y: str, std: bool = False, min_count: int = 0
) -> DataFrame:
    measures = [F.avg(y).alias("rate"), F.count(y).alias("n")]
    if std:
        measures.append(F.stddev_samp(y).alias("std"))
    out = df.groupBy(*keys).agg(*measures)
    return having_count(out, min_count) if min_count else out


def having_count(df: DataFrame, min_count: int, n: str = "n") -> DataFrame:
    return df.filter(F.col(n) >= min_count)


def crosstab(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    counts = [F.count_if(F.col(b) == F.lit(v)).alias(str(v)) for v in values]
    return df.groupBy(a).agg(*counts)


def rate_matrix(df: DataFrame, a: str, b: str, y: str, order: Sequence) -> DataFrame:
    """Mean of ``y`` by ``a`` (rows) and ``b`` (columns in the given order); empty is NULL."""
    cells = [F.avg(F.when(F.col(b) == F.lit(v), F.col(y))).alias(str(v)) for v in order]
    return df.groupBy(a).agg(*cells)


def rate_cube(
    df: DataFrame, a: str, b: str, facet: str, y: str, min_count: int = 10
) -> DataFrame:
    return rate_by(df, [facet, a, b], y, min_count=min_count)


def pivot_metric(
    df: DataFrame, row: str, column: str, values: Sequence, metric: str, how: str = "max"
) -> DataFrame:
    pick = {"max": F.max, "first": F.min}[how]  # one row per cell, so first = min
    return df.groupBy(row).agg(
        *[pick(F.when(F.col(column) == F.lit(v), F.col(metric))).alias(str(v)) for v in values]
    )


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation over complete pairs; NULL, not an error, where one side is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy))


def corr_with(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """One row per feature, from a single aggregate over the table."""
    wide = df.agg(*[pearson(c, y).alias(c) for c in columns])
    return melt(wide, columns).withColumnRenamed("value", "corr")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("corr")) for c in columns]
    for a, b in pairs:
        for left, right in ((a, b), (b, a)):
            cells.append(
                F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"), F.col(f"`{a}|{b}`").alias("corr"))
            )
    return wide.select(F.inline(F.array(*cells)))


def corr_by_group(df: DataFrame, group: str, columns: Sequence[str], y: str) -> DataFrame:
    wide = df.groupBy(group).agg(*[pearson(c, y).alias(c) for c in columns])
    return melt(wide, columns, [group]).withColumnRenamed("value", "corr")


def skew(column: str) -> Column:
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max, one row per feature."""
    moments = (
        melt(df, columns)
        .groupBy("feature")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "feature", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75")
    )
    return moments.join(quartiles, "feature", "left")


def box_stats(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    moments = (
        melt(df, columns, [by])
        .groupBy(by, "feature")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], [by]).select(
        by,
        "feature",
        F.col("q0").alias("q25"),
        F.col("q1").alias("median"),
        F.col("q2").alias("q75"),
    )
    return _beside(moments, quartiles, [by, "feature"])


def _beside(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join one row per group, the NULL group included."""
    side = totals.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = match([(F.col(k), F.col(f"_k_{k}")) for k in keys], null_safe=True)
    return df.join(side, on, "left").drop(*[f"_k_{k}" for k in keys])


def cardinality(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, and the product of all of them."""
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        counts = melt(wide, columns).select("feature", F.col("value").cast("long").alias("n_distinct"))
    else:
        cells = F.array(
            *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
        )
        seen = df.select(F.inline(cells)).groupBy("feature", "value").agg(F.lit(1).alias("one"))
        counts = seen.groupBy("feature").agg(F.count("value").alias("n_distinct"))
    return counts


def combinations_possible(counts: DataFrame) -> DataFrame:
    return counts.agg(F.product(F.col("n_distinct").cast("double")).alias("combinations"))


def class_distribution(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*by, y).agg(F.count("*").alias("n"))
    if by:
        counts = _beside(counts, counts.groupBy(*by).agg(F.sum("n").alias("total")), by)
    else:
        counts = counts.withColumn("total", counts.agg(F.sum("n").alias("t")).scalar())
    return counts.select(*by, y, "n", (F.col("n") / F.col("total")).alias("share"))


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value, the smallest one on ties."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(
        F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("mode"), F.max("n").alias("n")
    )


def argmax_group(df: DataFrame, group: str, y: str) -> DataFrame:
    """Group with the highest mean; the first in sort order on ties."""
    means = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg(y).alias("rate"))
    return means.agg(
        F.min_by(group, F.struct(-F.col("rate"), F.col(group))).alias("best_group"),
        F.max("rate").alias("best_rate"),
    )


def class_contrast(df: DataFrame, group: str, columns: Sequence[str], y: str) -> DataFrame:
    wide = df.groupBy(group).agg(
        *[F.avg(F.when(F.col(y) == 1, F.col(c))).alias(f"{c}|1") for c in columns],
        *[F.avg(F.when(F.col(y) == 0, F.col(c))).alias(f"{c}|0") for c in columns],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"`{c}|1`").alias("mean_1"),
                F.col(f"`{c}|0`").alias("mean_0"),
                (F.col(f"`{c}|1`") - F.col(f"`{c}|0`")).alias("diff"),
            )
            for c in columns
        ]
    )
    return wide.select(group, F.inline(cells))


def _rates_by_sets(df: DataFrame, key_sets: Sequence[Sequence[str]], y: str) -> DataFrame:
    """Rate per group of every key set, one pass: the finest groups first, then their roll-ups."""
    keys = list(dict.fromkeys(k for s in key_sets for k in s))
    fine = df.groupBy(*keys).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    rolled = fine.groupingSets([[F.col(k) for k in s] for s in key_sets], *keys).agg(
        F.grouping_id().alias("gid"), F.sum("_s").alias("_sum"), F.sum("_n").alias("n")
    )
    return rolled.select(*keys, "gid", "n", (F.col("_sum").cast("double") / F.col("n")).alias("rate"))


def _set_id(key_set: Sequence[str], keys: Sequence[str]) -> int:
    return sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in key_set)


def grouping_variance(
    df: DataFrame, key_sets: Sequence[Sequence[str]], y: str, min_count: int = 5
) -> DataFrame:
    """How much the rate varies over the groups of every key set."""
    keys = list(dict.fromkeys(k for s in key_sets for k in s))
    rates = _rates_by_sets(df, key_sets, y)
    name = F.create_map(*[F.lit(x) for s in key_sets for x in (_set_id(s, keys), "_".join(s))])
    # a condition, not a filter: a key set without any large group still gets its row
    large = F.col("n") >= min_count
    rate = F.when(large, F.col("rate"))
    return (
        rates.groupBy("gid")
        .agg(
            F.count(rate).alias("n_groups"),
            F.coalesce(F.sum(F.when(large, F.col("n"))), F.lit(0)).alias("covered"),
            F.var_samp(rate).alias("rate_variance"),
            F.stddev_samp(rate).alias("rate_std"),
            F.min(rate).alias("min_rate"),
            F.max(rate).alias("max_rate"),
            (F.max(rate) - F.min(rate)).alias("rate_range"),
        )
        .withColumn("grouping", name[F.col("gid").cast("int")])
        .drop("gid")
    )


def discrimination(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    return grouping_variance(df, [[k] for k in keys], y, min_count=1)


def interaction_matrix(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Deviation of the rate over the groups of every pair of keys; long and symmetric."""
    keys = list(keys)
    sets = [[k] for k in keys] + [list(p) for p in combinations(keys, 2)]
    spread = _rates_by_sets(df, sets, y).groupBy("gid").agg(F.stddev_samp("rate").alias("rate_std"))
    cells = []
    for s in sets:
        gid = _set_id(s, keys)
        for a, b in {(s[0], s[-1]), (s[-1], s[0])}:
            cells.append((gid, a, b))
    named = F.array(
        *[F.struct(F.lit(g).alias("cell"), F.lit(a).alias("a"), F.lit(b).alias("b")) for g, a, b in sorted(cells)]
    )
    return (
        spread.select("gid", "rate_std", F.inline(named))
        .filter(F.col("gid") == F.col("cell"))
        .select("a", "b", "rate_std")
    )


def purity_summary(df: DataFrame, keys: Sequence[str], y: str, min_count: int = 5) -> DataFrame:
    return rate_by(df, keys, y, min_count=min_count).agg(
        F.count("*").alias("n_groups"),
        F.count_if(F.col("rate") == 0).alias("all_zero"),
        F.count_if(F.col("rate") == 1).alias("all_one"),
        F.count_if(F.col("rate") > 0.5).alias("above_half"),
        F.count_if(F.col("rate") < 0.2).alias("below_fifth"),
    )


def histogram(
    df: DataFrame, columns: Sequence[str], bins: int = 50, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-width density histogram over each group's own range; the last bin is closed."""
    by = list(by)
    keys = [*by, "feature"]
    long = melt(df, columns, by).filter(F.col("value").isNotNull())
    ends = long.groupBy(*keys).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("total")
    )
    flat = F.col("lo") == F.col("hi")
    ends = ends.withColumns(
        {
            "lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")),
            "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")),
        }
    ).withColumn("n_rows", F.col("total"))
    placed = lookup(long, ends, keys, weight="n_rows", null_safe=True)
    position = F.floor((F.col("value") - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo")))
    counts = (
        placed.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
        .groupBy(*keys, "lo", "hi", "total", "bin")
        .agg(F.count("*").alias("n"))
    )
    # one row per bin, the empty ones included
    filled = counts.groupBy(*keys, "lo", "hi", "total").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_counts")
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return filled.select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        "lo",
        "hi",
        "total",
        "_counts",
    ).select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("left_edge"),
        F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0)).cast("long").alias("n"),
        (
            F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0)) / (F.col("total") * width)
        ).alias("density"),
    )


def compare_distributions(
    a: DataFrame, b: DataFrame, columns: Sequence[str], bins: int = 50, names=("train", "test")
) -> DataFrame:
    both = a.select(F.lit(names[0]).alias("split"), *columns).unionByName(
        b.select(F.lit(names[1]).alias("split"), *columns)
    )
    return histogram(both, columns, bins, ["split"])


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows with a value, and with a positive value, per column."""
    return (
        melt(df, columns)
        .groupBy("feature")
        .agg(
            F.avg(F.col("value").isNotNull().cast("double")).alias("filled"),
            F.avg(F.coalesce(F.col("value") > 0, F.lit(False)).cast("double")).alias("positive"),
        )
    )


def usable_columns(df: DataFrame, columns: Sequence[str], min_values: int = 10) -> list[str]:
    """Columns with more than ``min_values`` non-null cells (one aggregate, one row back)."""
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > min_values]


def above_overall(df: DataFrame, key: str, y: str) -> DataFrame:
    rates = rate_by(df, [key], y)
    overall = df.agg(F.avg(y).alias("g")).scalar()
    return rates.withColumn("overall", overall).withColumn(
        "above", (F.col("rate") > F.col("overall")).cast("int")
    )


def above_parent(df: DataFrame, parent: str, key: str, y: str) -> DataFrame:
    """As :func:`above_overall`, against the rate of the enclosing group."""
    fine = df.groupBy(parent, key).agg(F.sum(y).alias("_s"), F.count(y).alias("n"))
    coarse = fine.groupBy(parent).agg(
        (F.sum("_s").cast("double") / F.sum("n")).alias("overall"), F.sum(F.lit(1)).alias("groups")
    )
    rates = fine.select(parent, key, "n", (F.col("_s").cast("double") / F.col("n")).alias("rate"))
    return lookup(rates, coarse, parent, weight="groups", null_safe=True).withColumn(
        "above", (F.col("rate") > F.col("overall")).cast("int")
    )


def quantile_flags(
    df: DataFrame, column: str, low: float = 0.1, high: float = 0.9
) -> DataFrame:
    """Add ``<column>_low`` / ``<column>_high``: beyond the table's exact quantiles."""
    ends = exact_quantiles(df, [column], [low, high]).agg(
        F.struct(F.max("q0").alias("lo"), F.max("q1").alias("hi")).alias("e")
    )
    return df.withColumn("_ends", ends.scalar()).select(
        *df.columns,
        F.coalesce((F.col(column) < F.col("_ends.lo")), F.lit(False)).cast("int").alias(f"{column}_low"),
        F.coalesce((F.col(column) > F.col("_ends.hi")), F.lit(False)).cast("int").alias(f"{column}_high"),
    )


def top(df: DataFrame, column: str, n: int, ties: Sequence[str], ascending: bool = False) -> DataFrame:
    """First ``n`` rows by a metric; NULL last, ties by the given keys."""
    first = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return df.orderBy(first, *ties).limit(n)


def top_abs(df: DataFrame, column: str, n: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.abs(column).desc_nulls_last(), *ties).limit(n)


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return top(counts, "n", n, [key])


def top_keys_stats(df: DataFrame, key: str, n: int, y: str) -> DataFrame:
    """Rates of the ``n`` most frequent keys only."""
    return rate_by(semi_join(df, F.broadcast(top_keys(df, key, n).select(key)), key), [key], y)


def ordered(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows of the listed categories with their place in the list, to sort a report by."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.withColumn("position", place.cast("int")).filter(F.col("position") > 0).orderBy("position")


def best_config(df: DataFrame, score: str, config_id: str) -> DataFrame:
    """The configuration with the highest score; the earliest one on ties."""
    best = F.min_by(F.struct(*df.columns), F.struct(-F.col(score), F.col(config_id)))
    return df.filter(F.col(score).isNotNull()).agg(best.alias("b")).select("b.*")

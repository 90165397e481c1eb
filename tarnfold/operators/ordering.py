"""Exact order statistics over groups of any size.

A window over a whole group puts that group into one task. Beyond a measured size every
group is cut into value ranges of similar size first: totals per range give each range
its offset, and only the rows of one range are sorted together. The cut points are a
fixed number of values picked by hash, so that the side tables have a known size bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarnfold.functions.columns import hash_text
from tarnfold.operators.joins import lookup, match, measured
from tarnfold.session import shuffle_partitions

_STRIDE = 64
# Up to this many distinct rows, counted first, a group may be sorted in one task.
PLAIN_ROWS = 1_000_000
# Rows of one hash range that are sorted together.
SLICE_ROWS = 100_000


def running_totals(
    vals: DataFrame,
    groups: Sequence[str],
    order: str,
    totals: Sequence[str],
    rows: int | None = None,
    ranges: int | None = None,
    plain_rows: int | None = None,
) -> DataFrame:
    """Add ``<t>_upto`` (running, inclusive) and ``<t>_all`` (per group) for each total.

    ``vals`` has one row per (groups, order) and no NULL in ``order``. It is materialised
    and counted (unless the caller has done so and gives ``rows``); only beyond
    ``plain_rows`` do the groups have to be split.
    """
    groups = list(groups)
    if rows is None:
        vals, rows = measured(vals)
    if rows <= (PLAIN_ROWS if plain_rows is None else plain_rows):
        part = W.partitionBy(*groups)
        upto = part.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return vals.select(
            "*",
            *[F.sum(t).over(upto).alias(f"{t}_upto") for t in totals],
            *[F.sum(t).over(part).alias(f"{t}_all") for t in totals],
        )
    ranges = ranges or 4 * shuffle_partitions(vals.sparkSession)
    hashed = vals.withColumn("_h", F.xxhash64(*groups, order))
    picked = hashed.groupBy(F.pmod("_h", F.lit(ranges)).alias("_slot")).agg(
        F.min("_h").alias("_pick")
    )
    chosen = hashed.join(F.broadcast(picked.select("_pick")), F.col("_h") == F.col("_pick"), "left_semi")
    cuts = chosen.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups]).agg(
        F.array_sort(F.collect_set(order)).alias("_points")
    )
    starts = F.sequence(F.lit(0), F.size("_points") - 1, F.lit(_STRIDE))
    cuts = cuts.select(
        *[f"_g_{g}" for g in groups],
        F.transform(starts, lambda i: F.get(F.col("_points"), i)).alias("_first"),
        F.transform(starts, lambda i: F.slice(F.col("_points"), i + 1, F.lit(_STRIDE))).alias("_runs"),
    )
    if groups:
        on = match([(vals[g], cuts[f"_g_{g}"]) for g in groups], null_safe=True)
        placed = vals.join(F.broadcast(cuts), on, "left")
    else:
        placed = vals.withColumns(
            {"_first": cuts.select("_first").scalar(), "_runs": cuts.select("_runs").scalar()}
        )
    run = F.size(F.filter("_first", lambda p: p <= F.col(order)))
    inside = F.size(F.filter(F.get(F.col("_runs"), F.col("_run") - 1), lambda p: p <= F.col(order)))
    placed = (
        placed.withColumn("_run", F.coalesce(run, F.lit(0)))
        .withColumn("_split", F.col("_first").isNotNull())
        .withColumn(
            "_range",
            F.when(F.col("_run") <= 0, F.lit(0)).otherwise((F.col("_run") - 1) * _STRIDE + inside),
        )
        .select(*vals.columns, "_split", "_range")
    )
    # at most `ranges` cut points exist, so at most 2 * ranges rows come out of this
    per_range = (
        placed.filter("_split")
        .groupBy(*groups, "_range")
        .agg(*[F.sum(t).alias(f"_s_{t}") for t in totals])
    )
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    offsets = per_range.select(
        *[F.col(g).alias(f"_o_{g}") for g in groups],
        F.col("_range").alias("_o_range"),
        *[F.coalesce(F.sum(f"_s_{t}").over(before), F.lit(0)).alias(f"_b_{t}") for t in totals],
        *[F.sum(f"_s_{t}").over(whole).alias(f"_a_{t}") for t in totals],
    )
    pairs = [(placed[g], offsets[f"_o_{g}"]) for g in groups]
    pairs.append((placed["_range"], offsets["_o_range"]))
    joined = placed.join(F.broadcast(offsets), match(pairs, null_safe=True), "left")
    part = W.partitionBy(*groups, "_range")
    running = part.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return joined.select(
        *[placed[c] for c in vals.columns],
        *[
            (F.coalesce(F.col(f"_b_{t}"), F.lit(0)) + F.sum(placed[t]).over(running)).alias(f"{t}_upto")
            for t in totals
        ],
        *[
            F.coalesce(F.col(f"_a_{t}"), F.sum(placed[t]).over(part)).alias(f"{t}_all")
            for t in totals
        ],
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolation quantiles, one row per (by, feature), columns ``q0, q1, ...``."""
    by = list(by)
    vals = (
        melt(df, columns, by)
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "feature", "value")
        .agg(F.count("*").alias("n"))
    )
    ranked = running_totals(vals, [*by, "feature"], "value", ["n"])
    picks = []
    for i, p in enumerate(probabilities):
        position = (F.col("n_all") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("n_upto") - F.col("n") <= rank) & (rank < F.col("n_upto"))
            picks.append(F.max(F.when(here, F.col("value"))).alias(f"_{side}{i}"))
    found = ranked.groupBy(*by, "feature").agg(F.max("n_all").alias("_n"), *picks)
    results = []
    for i, p in enumerate(probabilities):
        position = (F.col("_n") - 1) * F.lit(float(p))
        results.append(
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (position - F.floor(position))).alias(f"q{i}")
        )
    return found.select(*by, "feature", *results)


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide to long ``(keep..., feature, value)``; NULL values stay."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return df.select(*keep, F.inline(cells))


def hash_rank(
    df: DataFrame,
    key: str,
    seed: int = 42,
    by: Sequence[str | Column] = (),
    digits: int | None = None,
    below: Column | None = None,
) -> DataFrame:
    """Add ``_rank`` (0-based, in seeded hash order) and ``_size``, within ``by``.

    md5 is uniform, so its leading hex digits cut any group into even ranges: as many
    ``digits`` as keep a range of all rows, counted first, below SLICE_ROWS. One count per
    range, then a sort inside each range. With
    ``below`` only ranks under it are kept, and ranges past it are never shuffled.
    """
    if digits is None:
        digits = max(3, math.ceil(math.log(max(df.count() / SLICE_ROWS, 1), 16)))
    names = [f"_by{i}" for i in range(len(by))]
    base = df.withColumns(
        {
            **{n: (F.col(b) if isinstance(b, str) else b) for n, b in zip(names, by)},
            "_hash": hash_text(key, seed),
        }
    ).withColumn("_slice", F.substring("_hash", 1, digits))
    counts = base.groupBy(*names, "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*names).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *names,
        "_slice",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(*names)).alias("_size"),
    )
    placed = lookup(base, offsets, [*names, "_slice"], weight="_n", null_safe=True)
    if below is not None:
        placed = placed.filter(F.col("_before") < below)
    inside = W.partitionBy(*names, "_slice").orderBy("_hash", key)
    ranked = placed.select(
        *df.columns,
        (F.col("_before") + F.row_number().over(inside) - 1).alias("_rank"),
        "_size",
    )
    return ranked if below is None else ranked.filter(F.col("_rank") < below)

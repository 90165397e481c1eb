"""Keyed lookups and filters that hold when one key owns a third of the rows."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnfold.session import cut_lineage

# A lookup side goes out as a broadcast only after it has been measured: at most this
# many rows of at most ROW_BYTES on average, about 50 MB.
BROADCAST_ROWS = 200_000
ROW_BYTES = 256
# A key is hot above 1/HOT_SHARE of the weight, so there are never more hot keys than this.
HOT_SHARE = 1_000


def match(pairs: Sequence[tuple[Column, Column]], null_safe: bool) -> Column:
    condition = None
    for a, b in pairs:
        one = a.eqNullSafe(b) if null_safe else a == b
        condition = one if condition is None else condition & one
    return condition


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """Materialise once in the checkpoint folder and measure what was written.

    The size is in rows, counted by weight where the rows are wide: ROW_BYTES make a row.
    """
    stored = cut_lineage(df)
    width, fixed = F.lit(0), 0
    for field in stored.schema:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0))
        else:
            fixed += 8
    row = stored.agg(F.count("*").alias("n"), F.sum(width + F.lit(fixed)).alias("bytes")).first()
    return stored, max(row.n, math.ceil((row.bytes or 0) / ROW_BYTES))


def lookup(
    df: DataFrame,
    dim: DataFrame,
    keys: Sequence[str] | str,
    default: Mapping[str, object] | None = None,
    weight: str | None = None,
    bounded: bool = False,
    null_safe: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Left-join the columns of ``dim`` (one row per key) onto ``df``.

    ``bounded`` states that the number of rows of ``dim`` is fixed by construction, and
    ``rows`` is a bound the caller has counted already. Otherwise ``dim`` is materialised and counted: small goes out as a broadcast, large
    is shuffled on the key. Keys that are hot in ``df`` are found by ``weight`` (rows of ``df`` per
    key, if ``dim`` has it) and by a frequent-items sketch of ``df``'s keys, which also sees those
    that ``dim`` lacks; the rows of ``dim`` for them, at most a few HOT_SHARE, go out as a broadcast and their
    rows are spread by a row hash instead of meeting in one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    default = default or {}
    values = [c for c in dim.columns if c not in keys and c != weight]
    bounded = bounded or (rows is not None and rows <= BROADCAST_ROWS)
    if not bounded:
        dim, rows = measured(dim)
        bounded = rows <= BROADCAST_ROWS
    if bounded:
        out = _join_side(df, F.broadcast(_side(dim, keys, values)), keys, null_safe)
    else:
        out = _split_lookup(df, dim, keys, values, weight, null_safe)
    return with_defaults(out, default)


def _side(dim: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return dim.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *values)


def _join_side(df: DataFrame, side: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    on = match([(F.col(k), F.col(f"_k_{k}")) for k in keys], null_safe)
    return df.join(side, on, "left").drop(*[f"_k_{k}" for k in keys])


def with_defaults(df: DataFrame, default: Mapping[str, object]) -> DataFrame:
    if not default:
        return df
    return df.withColumns(
        {c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in default.items()}
    )


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys that may own more than 1 / HOT_SHARE of the rows, from one sketch of the key columns.

    The sketch tracks eight times as many items as can be hot, so that no hot key is missed (its error
    is below a HOT_SHARE-th), and there are never more than HOT_SHARE of them.
    """
    known = df.select(_key_hash(keys).alias("h"), F.lit(1).alias("one"))
    met = known.agg(F.expr(f"approx_top_k(h, {HOT_SHARE}, {8 * HOT_SHARE})").alias("top"), F.count("*").alias("n")).first()
    return [r["item"] for r in met.top if r["item"] is not None and r["count"] * HOT_SHARE > met.n]


def _split_lookup(df, dim, keys, values, weight, null_safe):
    hashes = set(hot_keys(df, keys))
    if weight is not None:
        total = dim.agg(F.sum(weight).alias("t")).scalar()
        known = dim.filter(F.col(weight) * F.lit(HOT_SHARE) > total).select(_key_hash(keys).alias("h"))
        hashes |= {r.h for r in known.collect()}
    is_hot = _key_hash(keys).isin(sorted(hashes)) if hashes else F.lit(False)
    hot = dim.filter(is_hot).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys],
        *[F.col(v).alias(f"_h_{v}") for v in values],
        F.lit(True).alias("_found"),
    )
    on = match([(F.col(k), F.col(f"_h_{k}")) for k in keys], null_safe)
    tagged = df.withColumn("_hot", is_hot).join(F.broadcast(hot), on & F.col("_hot"), "left").drop(*[f"_h_{k}" for k in keys])
    apart = F.col("_hot")
    if not null_safe:
        for k in keys:
            apart = apart | F.col(k).isNull()
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(1 << 30)) + 1
    tagged = tagged.withColumn("_salt", F.when(apart, spread).otherwise(F.lit(0)).cast("long"))
    # a zero that is not a literal the optimizer would fold away, so the salt stays part of the shuffle key
    cold = dim.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(v).alias(f"_c_{v}") for v in values],
        F.pmod(_key_hash(keys), F.lit(1)).cast("long").alias("_zero"),
    )
    pairs = [(F.col(k), F.col(f"_k_{k}")) for k in keys]
    joined = tagged.join(cold, match(pairs, null_safe) & (F.col("_salt") == F.col("_zero")), "left")
    return joined.select(
        *df.columns,
        *[F.when(F.col("_found"), F.col(f"_h_{v}")).otherwise(F.col(f"_c_{v}")).alias(v) for v in values],
    )


def attach_features(df: DataFrame, features: DataFrame, key: str = "id") -> DataFrame:
    """Join stored features by id. Ids are unique on both sides, so no key can be hot."""
    drop = [c for c in features.columns if c in df.columns and c != key]
    return df.join(features.drop(*drop), key, "left")


def join_predictions(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.join(b, key, "inner")


def compare_predictions(
    a: DataFrame, b: DataFrame, key: str = "id", label: str = "label"
) -> DataFrame:
    left = a.withColumnRenamed(label, f"{label}_a")
    right = b.select(key, F.col(label).alias(f"{label}_b"))
    return left.join(right, key, "inner").withColumn(
        "same", F.col(f"{label}_a").eqNullSafe(F.col(f"{label}_b"))
    )


def semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(keys, on, "left_anti")


def _json_type(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    if isinstance(value, float):
        return "double"
    if isinstance(value, (list, tuple)):
        return f"array<{_json_type(value[0])}>"
    return "string"


def grid_literal(grid: Sequence[Mapping[str, object]]) -> Column:
    """A list of configurations as one array literal (folded once, not a join side)."""
    fields = ", ".join(f"`{k}`: {_json_type(v)}" for k, v in grid[0].items())
    return F.from_json(F.lit(json.dumps(list(grid))), f"array<struct<{fields}>>")


def cross_grid(df: DataFrame, grid: Sequence[Mapping[str, object]]) -> DataFrame:
    """Every row once per configuration of a small literal grid (no join, no shuffle)."""
    return df.select("*", F.inline(grid_literal(grid)))

"""Row-level column builders; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

NO_VALUE = "__NONE__"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0, as a failed comparison does in pandas."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def one_hot(df: DataFrame, column: str, values: Iterable[str], prefix: str = "is_") -> DataFrame:
    return df.withColumns(
        {f"{prefix}{str(v).lower()}": flag(F.col(column) == F.lit(v)) for v in values}
    )


def in_group(column: str | Column, values: Sequence) -> Column:
    return flag(_col(column).isin(list(values)))


def not_sentinel(column: str | Column, sentinel: str = NO_VALUE) -> Column:
    return flag(~_col(column).eqNullSafe(F.lit(sentinel)))


def safe_ratio(a: str | Column, b: str | Column, eps: float = 0.1) -> Column:
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double") + F.lit(float(eps)))


def interact(*columns: str | Column) -> Column:
    product = _col(columns[0]).cast("double")
    for c in columns[1:]:
        product = product * _col(c).cast("double")
    return product


def square(column: str | Column) -> Column:
    return interact(column, column)


def masked(expression: Column, condition: Column) -> Column:
    return F.when(condition, expression.cast("double")).otherwise(F.lit(0.0))


def fan_out(
    df: DataFrame, column: str, values: Iterable[str], features: Mapping[str, str | Column]
) -> DataFrame:
    """One masked copy of every feature per category value: ``<value>_<feature>``."""
    return df.withColumns(
        {
            f"{str(v).lower()}_{name}": masked(_col(f), F.col(column) == F.lit(v))
            for v in values
            for name, f in features.items()
        }
    )


def radians(column: str | Column) -> Column:
    return F.radians(_col(column))


def norm2(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(square(a) + square(b))


def map_values(column: str | Column, mapping: Mapping, default) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, _col(column)), F.lit(default))


def bucketize(column: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(edges[i], edges[i+1]]``; anything outside is NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    x = _col(column)
    result = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        result = F.when((x > F.lit(lo)) & (x <= F.lit(hi)), F.lit(label)).otherwise(result)
    return result


def combo_key(columns: Sequence[str | Column], null_text: str = "nan") -> Column:
    parts = [F.coalesce(_col(c).cast("string"), F.lit(null_text)) for c in columns]
    return F.concat_ws("_", *parts)


def clip01(column: str | Column) -> Column:
    return F.least(F.greatest(_col(column).cast("double"), F.lit(0.0)), F.lit(1.0))


def hash_text(key: str | Column, seed: int = 42) -> Column:
    """Seeded md5 of a row key: a shuffle order every engine can repeat."""
    return F.md5(F.concat(_col(key).cast("string"), F.lit(f":{seed}")))


def hash_number(key: str | Column, seed: int = 42) -> Column:
    """First 32 bits of :func:`hash_text` as a long."""
    return F.conv(F.substring(hash_text(key, seed), 1, 8), 16, 10).cast("long")


def pick_columns(
    df: DataFrame, priority: Sequence[str], pool: Sequence[str] = (), limit: int | None = None
) -> list[str]:
    """Existing columns, preferred ones first, then the rest of the pool."""
    present = [c for c in priority if c in df.columns]
    rest = [c for c in (pool or df.columns if limit else pool) if c in df.columns and c not in present]
    wanted = present + rest
    return wanted if limit is None else wanted[:limit]

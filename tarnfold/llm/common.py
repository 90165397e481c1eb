"""Small helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnfold.session import ensure_checkpoint_dir

# Blocks of this many bytes keep the temporary arrays of a task near the processor and bounded.
BLOCK_BYTES = 1 << 21
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: a table in the shared folder, which outlives lost executors.

    Unlike a checkpoint, what is read back carries no inferred constraints, which would grow
    from round to round of an iteration.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that reads them has been written itself."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path is not None:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet, in any case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def remainder(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; NULL for a NULL key."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(mod))


def bounded_sample(rows: DataFrame, stratum: str, per_stratum: int, *hashed: str) -> DataFrame:
    """About ``per_stratum`` rows of each value of ``stratum``, at random by a hash of ``hashed``.

    The number of strata must be small (they are counted and listed); the sample has a
    quarter more rows than asked for at most, but for chance, however large ``rows`` is.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(stratum).count().collect()}
    if not counts:
        return rows.limit(0)
    if len(counts) > 5_000:
        raise ValueError(f"{len(counts)} values of {stratum}: too many classes to learn")
    share = F.lit(0.0)
    for value, n in counts.items():
        hit = F.col(stratum).eqNullSafe(F.lit(value))
        share = F.when(hit, F.lit(min(1.0, 1.25 * per_stratum / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(*hashed), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(draw < share)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more entry than texts); NULL is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def blocks(starts: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each; a longer row is a range of its own."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in (_PRIME, _INVERSE)]
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums modulo 2**64, for ``range_hash``."""
    power, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range; equal bytes have equal hashes wherever they stand."""
    _, inverse = _power_tables(len(sums))
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_ranges(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every run of bytes that are not space or \\t to \\r, and the first run of each row."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[data], out=solid[1 : n + 1])
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(solid[1 : n + 1] & (~solid[:n] | edge[:n]))
    end = np.flatnonzero(solid[1 : n + 1] & (~solid[2:] | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, starts)

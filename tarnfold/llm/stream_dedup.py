"""Exact deduplication as a stateful stream, with DataFrame functions only.

``absorb`` streams the files of a folder into keyed state: per SHA-256 digest of the normalised
text it keeps how many rows had it, the largest key, and where that row's content is (file and row
in it). The state has no watermark and never expires; RocksDB holds it on disk and writes it to the
state folder with every micro-batch, so a lost executor loses nothing and a later call goes on with the
files that are new by then. No text enters the state.

``resolve`` gives every row of the folder the row that stays. Digests only propose: the text of every
row whose digest was met before is compared, byte by byte, with the content at the locator. Rows whose
digest covers different texts are grouped by their texts instead.

Hot groups: the state is pre-aggregated before its shuffle; the comparison deals a group out in parts of
``PART_ROWS`` rows, each with one copy of the content; rows meet their group through a lookup that
spreads frequent keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnfold.llm.common import stored, tasks
from tarnfold.operators.joins import lookup
from tarnfold.session import ensure_checkpoint_dir

PART_ROWS = 4096
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GROUP = "digest binary, rows bigint, keep_id {key}, keep_file string, keep_row bigint"


def normalised(text: Column) -> Column:
    """NULL as empty, A-Z (and nothing else) lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def state_folder(spark: SparkSession) -> str:
    """A new folder for the state, in the shared folder the cluster names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/dedup-state-{uuid.uuid4()}"


def _pattern(source: str) -> str:
    """The source as a pattern: a stream takes a single file by a pattern only."""
    return source if any(c in source for c in "*?[{") else f"{source.rstrip('/')[:-1]}[{source.rstrip('/')[-1]}]"


def _located(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(
        F.col(key).alias("id"),
        normalised(F.col(text)).alias("norm"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def absorb(
    spark: SparkSession,
    source: str,
    state: str,
    key: str = "doc_id",
    text: str = "text",
    batch_bytes: int = 64 << 30,
    digest: Callable[[Column], Column] = sha256,
) -> None:
    """Take the Parquet files of ``source`` that ``state`` has not seen yet into it, in batches of ``batch_bytes``.

    The number of state partitions is that of the first call's shuffle partitions, for good.
    """
    own = spark.newSession()  # the store is this stream's choice, not the caller's
    own.conf.set("spark.sql.shuffle.partitions", str(tasks(spark)))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    # a store reserves 4 MB for its log of files otherwise, however small it is
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    # ages count for growing folders only: here every file is taken, however old
    reader = own.readStream.schema(spark.read.parquet(source).schema).option("maxFileAge", "36500d").option("maxBytesPerTrigger", str(batch_bytes))
    rows = _located(reader.parquet(_pattern(source)), key, text)
    groups = rows.groupBy(digest(F.col("norm")).alias("digest")).agg(
        F.count("*").alias("rows"), F.max(F.struct("id", "file", "row")).alias("keep")
    )
    # the state is the result; what a batch changed goes nowhere
    running = (
        groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    running.awaitTermination()


def retained(spark: SparkSession, state: str, key_type: str = "bigint") -> DataFrame:
    """(digest, rows, keep_id, keep_file, keep_row) of every digest in the state."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/commits/0")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _GROUP.format(key=key_type))
    held = spark.read.format("statestore").load(state)
    keep = F.col("value")[held.schema["value"].dataType[1].name]
    return held.select(
        F.col("key")[held.schema["key"].dataType[0].name].alias("digest"),
        F.col("value")[held.schema["value"].dataType[0].name].alias("rows"),
        keep["id"].alias("keep_id"),
        keep["file"].alias("keep_file"),
        keep["row"].alias("keep_row"),
    )


def resolve(
    spark: SparkSession,
    source: str,
    state: str,
    key: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """One row per row of ``source``, which ``state`` has taken in: key, keep_id, group_size, kept, text_sha256.

    NULL texts are empty, and empty texts are equal. Of rows with equal texts the one with the largest
    key stays; a NULL key is the smallest, and among equal keys the last row by file and place stays, so that
    one row of a group always does. Empty tables give no rows; other columns are not read.
    """
    rows = _located(spark.read.parquet(source), key, text).withColumn("digest", digest(F.col("norm")))
    groups = retained(spark, state, dict(rows.dtypes)["id"]).filter("rows > 1")
    sha = F.col("digest") if digest is sha256 else sha256(F.col("norm"))
    joined = lookup(rows.withColumn("sha", sha), groups.withColumn("n", F.col("rows")), "digest", weight="rows")
    own = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    # texts are needed again only where a digest was met before
    again = F.when(F.col("n") > 1, F.col("norm")).alias("norm")
    joined = stored(joined.select("id", "file", "row", "digest", "sha", "n", "keep_id", F.coalesce(own, F.lit(True)).alias("kept"), again))
    parts = F.ceil(F.col("n") / part_rows).cast("int")
    content = joined.filter("n > 1 and kept").select(
        F.col("digest").alias("c_digest"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("c_part"), F.col("norm").alias("content")
    )
    hits = joined.filter("n > 1 and not kept").select(
        "digest", F.pmod(F.xxhash64("file", "row"), parts).cast("int").alias("part"), "norm"
    )
    differ = hits.join(content, (F.col("digest") == F.col("c_digest")) & (F.col("part") == F.col("c_part"))).filter(
        F.col("norm") != F.col("content")
    )
    clashes = stored(differ.select("digest").distinct())
    if clashes.isEmpty():
        return _answer(joined, key)
    apart = joined.join(clashes, "digest", "left_semi")
    by_text = apart.groupBy("norm").agg(F.count("*").alias("n"), F.max(F.struct("id", "file", "row")).alias("keep"))
    again = lookup(apart.select("id", "file", "row", "sha", "norm"), by_text.withColumn("size", F.col("n")), "norm", weight="size")
    stays = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    again = again.select("id", "sha", "n", F.col("keep.id").alias("keep_id"), stays.alias("kept"))
    return _answer(joined.join(clashes, "digest", "left_anti"), key).union(_answer(again, key))


def _answer(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(
        F.col("id").alias(key),
        F.when(F.col("n") > 1, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(spark: SparkSession, source: str, key: str = "doc_id", text: str = "text", state: str | None = None) -> DataFrame:
    """``absorb`` what is new in ``source`` and ``resolve`` all of it."""
    state = state or state_folder(spark)
    absorb(spark, source, state, key, text)
    return resolve(spark, source, state, key, text)

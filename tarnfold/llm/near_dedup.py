"""MinHash near-duplicates by an LSH forest.

Texts with equal shingle sets form a class, and only classes are compared. A class has a
signature of minimum hashes; tree t of the forest is the order of all classes by their
signature read from position t * STEP on, around its end. Classes that are close in an
order share a long prefix. Candidates of a class are the next classes in each order: at
least ``depth`` values must be shared, but where many classes share them, those with the longer
common prefix stand closer and come first, so crowded regions are searched at greater
depth. Candidates whose whole signatures agree too little are dropped, links are confirmed on
full sets, and where a crowded region cut the search short it is searched again between
the components found so far. The classes of such regions get a longer signature, one bit of each of 2,048
minimum hashes, which tells texts that share most of a passage from near-duplicates before a pair
leaves its task. Classes that are cut short even then are joined on their rare shingles, and in blocks on their
frequent ones, with no bound on how far apart they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tarnfold.llm.common import LOWER, blocks, flat, forget, mix, prefix_hash, range_hash, stored, tasks, word_ranges
from tarnfold.llm.components import components, merged

VALUES = 96
TREES = 12
STEP = VALUES // TREES
_RNG = np.random.default_rng(2024)
_FLIP = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BITS = 2048
_BIT_FLIP = _RNG.integers(0, 1 << 63, BITS, dtype=np.uint64)
_BIT_ODD = _RNG.integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_SECOND = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Settings:
    """``depth``: values two neighbours share at least. ``agree``: share of equal signature values
    below which a pair is not looked at again; a pair with 0.8 of its shingles in common falls
    below 0.62 with a chance of 1 in 100,000. ``reach`` and ``links``: how far along an order and for how
    many candidates a class looks at first; ``far``: how far it looks in the second search, after
    which all rows that were cut short are left to the exact join;
    ``agree_far``: the same by 2,048 bits, in the second search (for 0.8 the estimate deviates by 0.0133, so this
    is missed with a chance of 1 in 100,000); ``usual``: in how many of the classes left after it a shingle is no longer rare;
    ``rounds``: how often components are joined by their centres before all other pairs are compared;
    ``block``: how many rows with frequent shingles only are compared with as many others by one task."""

    depth: int = 2
    agree: float = 0.62
    reach: int = 48
    links: int = 4
    far: int = 1024
    agree_far: float = 0.743
    usual: int = 64
    rounds: int = 6
    block: int = 512


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of each text.

    Words are runs of bytes other than space and \\t to \\r, with A-Z in lower case. A text
    with fewer words is one shingle, one without words has none.
    """
    data, starts = flat(texts)
    for i, j in blocks(starts):
        part, at = LOWER[data[starts[i] : starts[j]]], starts[i : j + 1] - starts[i]
        begin, end, first = word_ranges(part, at)
        words = range_hash(prefix_hash(part), begin, end)
        n = max(len(words) - k + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for step in range(k):
            rolled = rolled * _FACTOR + words[step : n + step]
        rolled = mix(rolled)
        for r in range(j - i):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    whole = mix(whole * _FACTOR + w)
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16 bits of each minimum hash of each (not empty) set."""
    out = np.empty((len(starts), VALUES), np.uint16)
    for k in range(VALUES):
        least = np.minimum.reduceat((values ^ _FLIP[k]) * _ODD[k], starts)
        out[:, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def bit_signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One bit of each of BITS minimum hashes of each (not empty) set, packed into bytes."""
    out = np.empty((len(starts), BITS), np.uint8)
    for k in range(BITS):
        least = np.minimum.reduceat((values ^ _BIT_FLIP[k]) * _BIT_ODD[k], starts)
        out[:, k] = mix(least) >> np.uint64(63)
    return np.packbits(out, axis=1)


def sketches(texts: pa.Array, k: int) -> pa.StructArray:
    n = np.zeros(len(texts), np.int64)
    names = np.zeros((2, len(texts)), np.uint64)
    signed: list[bytes | None] = [None] * len(texts)
    waiting: list[tuple[int, np.ndarray]] = []

    def sign() -> None:
        starts = np.cumsum([0] + [len(s) for _, s in waiting[:-1]])
        values = np.concatenate([s for _, s in waiting])
        # big-endian, so that bytes sort as numbers do
        signature = signatures(values, starts).astype(">u2")
        rows = [r for r, _ in waiting]
        names[0, rows] = np.add.reduceat(mix(values), starts)
        names[1, rows] = np.add.reduceat(mix(values ^ _SECOND), starts)
        for r, s in zip(rows, signature, strict=True):
            signed[r] = s.tobytes()
        waiting.clear()

    size = 0
    for r, s in enumerate(shingle_sets(texts, k)):
        n[r] = len(s)
        if len(s):
            waiting.append((r, s))
            size += len(s)
        if waiting and size >= 1 << 16:
            sign()
            size = 0
    if waiting:
        sign()
    return pa.StructArray.from_arrays(
        [pa.array(n), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), pa.array(signed, pa.binary())],
        ["n", "h1", "h2", "signature"],
    )


def neighbours(rows: DataFrame, s: Settings, percent: int, second: bool, partitions: int) -> DataFrame:
    """Candidate pairs (a, b, agree) of ``rows`` (tree, signature, node, root, n), and which nodes were cut short.

    Rows lie in order over range partitions, each task holds a window of ``reach`` rows, and
    the rows at the ends of neighbouring partitions meet in a second small step. Of a long run of rows that each agree
    with the next one, only these pairs are returned at first: the second search asks which of the run they join.
    Sets whose sizes alone keep them below ``percent`` are no pair. In the ``second`` search pairs of
    one root are left out, and of all others those that agree enough in their ``bits`` are kept.
    """
    reach = s.far if second else s.reach
    out = "a bigint, b bigint, agree float, cut boolean, edge int, place int, tree tinyint, signature binary, node bigint, root bigint, n bigint, bits binary"
    words = BITS // 64 if second else 0

    def pairs(tree, sig, node, root, n, bits, older: int):
        """Pairs with the later one at or behind ``older``."""
        found, cut = [], np.zeros(len(node), bool)
        left, run, long = np.full(len(node), s.links), np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        for lag in range(1, min(reach, len(node) - 1) + 1):
            near = (tree[:-lag] == tree[lag:]) & (sig[:-lag, : s.depth] == sig[lag:, : s.depth]).all(axis=1)
            near[: max(older - lag, 0)] = False
            at = np.flatnonzero(near)
            if not len(at):
                if older == 0 or lag >= older:
                    break
                continue
            if lag == reach:  # rows nearer to both ends of a region have met all of it
                cut[at] = cut[at + lag] = True
            x, y = n[at], n[at + lag]
            at = at[100 * np.minimum(x, y) >= percent * np.maximum(x, y)]
            if second:
                at = at[root[at] != root[at + lag]]
            if second:
                share = 1 - np.bitwise_count(bits[at] ^ bits[at + lag]).sum(axis=1) * (2 / BITS)
            else:
                share = (sig[at] == sig[at + lag]).mean(axis=1)
            enough = share >= (s.agree_far if second else s.agree)
            at, share = at[enough], share[enough]
            if lag == 1 and not second:
                # rows that agree with the next one make a run; those of a long one are searched again in any case
                breaks = np.ones(len(node), bool)
                breaks[at + 1] = False
                run = np.cumsum(breaks) - 1
                long = np.bincount(run)[run] > reach
            elif not second:
                within = long[at] & (run[at] == run[at + lag])
                cut[at[within]] = cut[at[within] + lag] = True
                at, share = at[~within], share[~within]
            over = at[left[at] <= 0]
            cut[over] = cut[over + lag] = True
            at, share = at[left[at] > 0], share[left[at] > 0]
            left[at] -= 1
            found.append((at, at + lag, share))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), cut
        return *(np.concatenate(x) for x in zip(*found, strict=True)), cut

    def matrix(batch: pa.RecordBatch):
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), ">u2").reshape(-1, VALUES)
        bits = np.zeros((len(sig), 0), np.uint64)
        if second:
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, words)
        return [batch.column("tree").to_numpy(zero_copy_only=False), sig, *(batch.column(c).to_numpy() for c in ("node", "root", "n")), bits]

    def records(node, found, cut_nodes=()) -> pa.RecordBatch:
        a, b, share = found
        k, m = len(a), len(cut_nodes)
        none = lambda kind: pa.nulls(k + m, kind)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.minimum(node[a], node[b]), cut_nodes]).astype(np.int64)),
                pa.array(np.concatenate([np.maximum(node[a], node[b]), cut_nodes]).astype(np.int64)),
                pa.array(np.concatenate([share, np.zeros(m)]).astype(np.float32)),
                pa.array(np.arange(k + m) >= k),
                none(pa.int32()), none(pa.int32()), none(pa.int8()), none(pa.binary()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary()),
            ],
            schema=names,
        )

    names = pa.schema(
        [("a", pa.int64()), ("b", pa.int64()), ("agree", pa.float32()), ("cut", pa.bool_()), ("edge", pa.int32()), ("place", pa.int32()),
         ("tree", pa.int8()), ("signature", pa.binary()), ("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())]
    )

    def edge_rows(part: list, edge: int, place: int) -> pa.RecordBatch:
        tree, sig, node, root, size, bits = part
        k = len(node)
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float32()), pa.nulls(k, pa.bool_()),
                pa.array(np.full(k, edge, np.int32)), pa.array(np.arange(place, place + k, dtype=np.int32)), pa.array(tree.astype(np.int8)),
                pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(node), pa.array(root), pa.array(size),
                pa.array([x.tobytes() for x in bits], pa.binary()) if second else pa.nulls(k, pa.binary()),
            ],
            schema=names,
        )

    def beyond(part: list, at: int) -> np.ndarray:
        """Rows that are not in the region of row ``at``."""
        tree, sig = part[:2]
        return np.flatnonzero((tree != tree[at]) | (sig[:, : s.depth] != sig[at, : s.depth]).any(axis=1))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tail, head_sent, head = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = matrix(batch)
            if head_sent < reach:  # the first rows also meet the end of the partition before: their region, and a row that ends it
                some = [x[: reach - head_sent] for x in part]
                head = head or [x[:1] for x in part]
                other = beyond([np.concatenate([x, y]) for x, y in zip(head, some, strict=True)], 0)
                if len(other):
                    some = [x[: other[0]] for x in some]
                yield edge_rows(some, here - 1, reach + head_sent)
                head_sent = reach if len(other) else head_sent + len(some[0])
            older = 0
            if tail is not None:
                older = len(tail[0])
                part = [np.concatenate([x, y]) for x, y in zip(tail, part, strict=True)]
            a, b, share, cut = pairs(*part, older)
            yield records(part[2], (a, b, share), np.unique(part[2][cut]))
            tail = [x[-reach:] for x in part]
        if tail is not None:
            other = beyond(tail, -1)
            tail = [x[other[-1] if len(other) else 0 :] for x in tail]
            yield edge_rows(tail, here, reach - len(tail[0]))

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        part = matrix(table.to_batches()[0]) if table.num_rows else None
        if part is None:
            return names.empty_table()
        later = int((table.column("place").to_numpy() < reach).sum())
        a, b, share, cut = pairs(*part, later)
        keep = a < later  # pairs inside one partition are known already
        # a partition with fewer rows than a task looks ahead: a region that goes all through it may go on behind it
        rows, (tree, sig) = len(part[0]), part[:2]
        like = lambda at: (tree == tree[at]) & (sig[:, : s.depth] == sig[at, : s.depth]).all(axis=1)
        if 0 < rows - later < reach and later:
            cut[:later] |= like(rows - 1)[:later]
        if 0 < later < reach and rows > later:
            cut[later:] |= like(0)[later:]
        return pa.Table.from_batches([records(part[2], (a[keep], b[keep], share[keep]), np.unique(part[2][cut]))])

    ordered = rows.repartitionByRange(partitions, "tree", "signature", "node").sortWithinPartitions("tree", "signature", "node")
    first = stored(ordered.mapInArrow(inside, out))
    meet = first.filter("edge is not null").groupBy("edge").applyInArrow(across, out)
    found = stored(first.filter("edge is null").select("a", "b", "agree", "cut").union(meet.select("a", "b", "agree", "cut")))
    forget(first)
    return found


def forest_rows(classes: DataFrame) -> DataFrame:
    """Every class once per tree, with its signature turned to where the tree begins."""
    width = 2 * STEP
    turned = [
        F.struct(
            F.lit(t).cast("tinyint").alias("tree"),
            F.concat(F.expr(f"substring(signature, {t * width + 1})"), F.expr(f"substring(signature, 1, {t * width})")).alias("signature"),
        )
        for t in range(TREES)
    ]
    return classes.select("node", "root", "n", "bits", F.inline(F.array(*turned))).select("tree", "signature", "node", "root", "n", "bits")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share ``percent`` of their united shingles, on full sets."""

    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            out.append(100 * shared >= percent * (len(both) - shared))
        return pa.array(out, pa.bool_())

    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.filter(linked("set_a", "set_b")).select("a", "b")


def classes_and_links(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, settings: Settings = Settings()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all documents, the classes of equal sets, and each linked class's root."""
    spark, s = docs.sparkSession, settings

    @F.arrow_udf("struct<n: bigint, h1: bigint, h2: bigint, signature: binary>")
    def sketch(texts: pa.Array) -> pa.Array:
        return sketches(texts, words)

    @F.arrow_udf("binary")
    def full_set(texts: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in shingle_sets(texts, words)], pa.binary())

    @F.arrow_udf("binary")
    def long_signature(sets: pa.Array) -> pa.Array:
        out: list[bytes] = []
        for at in range(0, len(sets), 256):
            each = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets.slice(at, 256)]
            starts = np.cumsum([0] + [len(x) for x in each[:-1]])
            out += [x.tobytes() for x in bit_signatures(np.concatenate(each), starts)]
        return pa.array(out, pa.binary())

    source = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("x"))
    sketched = stored(source.select("id", "x", sketch("t").alias("s")).select("id", "x", "s.*"))
    classes = (
        sketched.filter("n > 0")
        .groupBy("n", "h1", "h2")
        .agg(
            F.min("id").alias("least"),
            F.min(F.struct(F.col("id").isNull().alias("unnamed"), F.col("id"), F.col("x"))).alias("sample"),
            F.first("signature").alias("signature"),
        )
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    alone = classes.withColumn("root", F.col("node")).withColumn("bits", F.lit(None).cast("binary"))
    rows = max(1, TREES * classes.count())
    found = neighbours(forest_rows(alone), s, percent, False, _partitions(spark, rows, s.reach))
    pairs = stored(found.filter("not cut").groupBy("a", "b").agg(F.first("agree").alias("agree")))
    cut = stored(found.filter("cut").select(F.col("a").alias("node")).distinct())
    forget(found)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(cut).distinct()
    wanted = classes.join(ends, "node").select("node", "sample.id", "sample.x")
    texts = source.join(
        wanted.withColumnsRenamed({"id": "w_id", "x": "w_x"}), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("x") == F.col("w_x"))
    )
    sets = stored(texts.select("node", full_set("t").alias("shingles")))
    # every class asks its most similar candidate first; ties go by hash, so that no class is asked by all
    choice = F.struct(F.col("agree"), F.xxhash64("a", "b").alias("draw"), F.col("a"), F.col("b"))
    asked = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("node"), choice.alias("c")), F.struct(F.col("b").alias("node"), choice.alias("c")))))
    best = stored(asked.groupBy("node").agg(F.max("c").alias("c")).select("c.a", "c.b").distinct())
    links, tried = stored(confirm(best, sets, percent)), best
    roots = components(links)
    links, tried, roots = _connect(pairs, links, tried, roots, sets, percent, s.rounds)
    if not cut.isEmpty():
        long = sets.join(cut, "node").dropDuplicates(["node"]).select("node", long_signature("shingles").alias("bits"))
        crowded = classes.join(long, "node").join(roots, "node", "left")
        crowded = stored(crowded.select("node", "n", "signature", "bits", F.coalesce("root", "node").alias("root")))
        n = max(1, TREES * crowded.count())
        found = neighbours(forest_rows(crowded), s, percent, True, _partitions(spark, n, s.far))
        again = stored(found.filter("not cut").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
        cut = stored(found.filter("cut").select(F.col("a").alias("node")).distinct())
        forget(found, pairs)
        links, tried, roots = _connect(again, links, tried, roots, sets, percent, s.rounds)
        forget(again)
        if not cut.isEmpty():
            left = crowded.select("node", "n").join(cut, "node").join(sets.dropDuplicates(["node"]), "node")
            roots = _exhaust(left, links, tried, roots, sets, percent, s)
    return sketched, classes, roots


def _exhaust(
    rows: DataFrame, links: DataFrame, tried: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, s: Settings
) -> DataFrame:
    """``roots`` with all links between ``rows`` (node, n, shingles), however many share a passage.

    Two sets whose first shared shingle, rarest first, is a rare one meet in a join on the rare
    shingles that begin them. All others share frequent shingles only, so how much they share
    follows from n and the frequent part alone: sets equal in both are one group, one set of each
    group stands for it, and those are compared in blocks, which return no more links than they join.
    """

    @F.arrow_udf("array<bigint>")
    def numbers(packed: pa.Array) -> pa.Array:
        each = [np.frombuffer(x.as_buffer(), np.int64) for x in packed]
        ends = np.cumsum([0] + [len(x) for x in each]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *each])))

    rows = rows.select("node", "n", numbers("shingles").alias("own"))
    pairs, frequent = _by_rare_shingles(rows, percent, s.usual)
    links, tried, roots = _connect(pairs, links, tried, roots, sets, percent, s.rounds)
    if frequent.isEmpty():
        return roots
    groups = stored(frequent.groupBy("n", "name").agg(F.min("node").alias("group")))
    step = frequent.select("node", "n", "name", F.size("own").alias("k")).join(groups, ["n", "name"]).join(roots, "node", "left")
    step = stored(step.select("node", "n", "k", "group", F.coalesce("root", "node").alias("root")))
    alike = step.filter(F.col("node") != F.col("group")).filter(100 * F.col("k") >= percent * (2 * F.col("n") - F.col("k")))
    alike = alike.select(F.col("node").alias("a"), F.col("group").alias("b"))
    # a group with rows of several components is taken as a component of its own
    one = F.when(F.min("root") == F.max("root"), F.min("root")).otherwise(-1 - F.col("group"))
    known = step.groupBy("group").agg(one.alias("root")).withColumnRenamed("group", "node")
    shared = stored(_by_blocks(stored(frequent.select("node", "n", "own", "head").join(known, "node")), percent, s.block))
    # every member of a group is as near to the other group's set as the one that stands for it
    ends = shared.union(shared.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partner = ends.groupBy(F.col("a").alias("group")).agg(F.min("b").alias("b"))
    linked = shared.union(step.join(partner, "group").select(F.col("node").alias("a"), "b"))
    return merged(roots, alike.union(linked))


def _by_blocks(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) that join all of ``rows`` (node, n, own, head, root) that are near by ``own`` and not of one root yet.

    Rows that share no shingle of their heads, even by way of others, are not near, and neither are those
    whose sizes differ by more than one step. What is left is dealt out in blocks, and every
    two blocks that may hold near rows meet in a task.
    """
    if rows.count() > block:
        places = components(rows.select(F.col("node").alias("a"), F.explode("head").alias("b")))
        rows = rows.join(places.withColumnRenamed("root", "place"), "node")
    else:
        rows = rows.withColumn("place", F.lit(0).cast("long"))
    step = F.floor(F.log(F.col("n").cast("double")) / max(1e-3, math.log(100 / percent) * (1 + 1e-9)))
    rows = stored(rows.select("node", "n", "own", "root", "place", step.alias("size")))
    # blocks hold so many rows and, of long ones, so many shingles at most
    many = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("own")) / (256 * block))).cast("int")
    parts = stored(rows.groupBy("place", "size").agg(many.alias("parts")))
    near = lambda by, name: parts.select("place", (F.col("size") + by).alias("size"), F.col("parts").alias(name))
    rows = rows.join(parts, ["place", "size"]).join(near(1, "below"), ["place", "size"], "left").join(near(-1, "above"), ["place", "size"], "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    each = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meet = lambda low, x, high, y, later: F.struct(low.alias("low"), x.alias("x"), high.alias("high"), y.alias("y"), later.alias("later"))
    size, own = F.col("size"), F.col("block")
    met = F.concat(
        F.transform(each(F.col("parts")), lambda i: meet(size, F.least(own, i), size, F.greatest(own, i), own > i)),
        F.transform(each(F.col("above")), lambda i: meet(size, own, size + 1, i, F.lit(False))),
        F.transform(each(F.col("below")), lambda i: meet(size - 1, i, size, own, F.lit(True))),
    )
    dealt = rows.select("node", "n", "own", "root", "place", F.inline(met))

    def links(table: pa.Table) -> pa.Table:
        single = (table["low"][0], table["x"][0]) == (table["high"][0], table["y"][0])
        node, n, root, later = (table[c].to_numpy() for c in ("node", "n", "root", "later"))
        some, others = (np.arange(len(node)),) * 2 if single else (np.flatnonzero(~later), np.flatnonzero(later))
        near = _near(table["own"].combine_chunks(), n, some, others, percent)
        found = []
        for x, row in zip(some.tolist(), near, strict=True):
            at = others[row]
            _, first = np.unique(root[at], return_index=True)
            for y in at[first].tolist():
                if root[x] != root[y]:
                    found.append((node[x], node[y]))
                    root = np.where(root == root[y], root[x], root)
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("place", "low", "x", "high", "y").applyInArrow(links, "a bigint, b bigint")


def _near(own: pa.ListArray, n: np.ndarray, some: np.ndarray, others: np.ndarray, percent: int, width: int = 1 << 13) -> np.ndarray:
    """Which of ``some`` rows are near which of the ``others`` by the shingles in ``own``; ``width`` shingles at a time, as bits."""
    row = np.repeat(np.arange(len(n)), np.diff(own.offsets.to_numpy()))
    _, code, count = np.unique(own.flatten().to_numpy(), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    order = order[count[code[order]] > 1]
    row, code = row[order], code[order]
    shared = np.zeros((len(some), len(others)), np.int64)
    for first in range(0, len(count), width):
        i, j = np.searchsorted(code, [first, first + width])
        if i == j:
            continue
        has = np.zeros((len(n), -(-width // 64) * 64), np.uint8)
        has[row[i:j], code[i:j] - first] = 1
        has = np.packbits(has, axis=1).view(np.uint64)
        right = has[others]
        for k, x in enumerate(some):
            shared[k] += np.bitwise_count(right & has[x]).sum(axis=1, dtype=np.int64)
    return 100 * shared >= percent * (n[some][:, None] + n[others] - shared)


def _by_rare_shingles(rows: DataFrame, percent: int, usual: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of ``rows`` (node, n, own) that share one of their first rare shingles, and the frequent
    parts (node, n, own, head, name) of those rows that can be near another by these alone: two that are have a
    shingle of their heads in common."""
    each = rows.select("node", "n", F.explode("own").alias("s"))
    # a shingle of a single row is shared with none; the rarest first, ties by hash
    count = stored(each.groupBy("s").agg(F.count("*").alias("d")).filter("d > 1"))
    known = each.join(count, "s").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("own"))
    known = stored(known)
    least = F.floor((percent * F.col("n") + 99) / 100)  # shingles a near one shares at least
    begins = (F.size("own") - least + 1).cast("int")  # n less those of a single row, which come first
    head = F.filter(F.slice("own", F.lit(1), F.greatest(begins, F.lit(0))), lambda x: x["d"] <= usual)
    begin = stored(known.select("node", "n", F.explode(head).alias("x")).select("node", "n", F.col("x.s").alias("s")))
    side = lambda name: begin.select("s", F.col("node").alias(name), F.col("n").alias(f"n_{name}"))
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = side("a").join(side("b"), "s").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    common = F.transform(F.filter("own", lambda x: x["d"] > usual), lambda x: x["s"])
    frequent = known.select("node", "n", common.alias("common")).filter(100 * F.size("common") >= percent * F.col("n"))
    head = F.slice("common", F.lit(1), (F.size("common") - least + 1).cast("int"))
    frequent = frequent.select("node", "n", F.array_sort("common").alias("own"), head.alias("head"))
    return stored(pairs), stored(frequent.withColumn("name", F.sha2(F.array_join("own", " "), 256)))


def _partitions(spark, rows: int, reach: int) -> int:
    """As many as the shuffle has, but each with many times more rows than a task looks ahead."""
    return max(1, min(tasks(spark), rows // (16 * reach)))


def _connect(
    pairs: DataFrame, links: DataFrame, tried: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, rounds: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confirm ``pairs``, first by way of centres, then all that still lie between two components."""

    apart = stored(_between(pairs, roots))
    for _ in range(rounds):
        asked = stored(_to_centres(apart, links, roots).join(tried, ["a", "b"], "left_anti"))
        if 10 * asked.count() <= apart.count():  # they could spare few of the other comparisons
            break
        more = stored(confirm(asked, sets, percent))
        tried, links = tried.union(asked), links.union(more)
        if more.isEmpty():
            break
        roots, before = merged(roots, more), apart
        apart = stored(_between(before, roots))
        forget(before)
    asked = stored(apart.select("a", "b").join(tried, ["a", "b"], "left_anti"))
    forget(apart)
    if asked.isEmpty():
        return links, tried, roots
    more = stored(confirm(asked, sets, percent))
    return links.union(more), tried.union(asked), roots if more.isEmpty() else merged(roots, more)


def _to_centres(apart: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """For each candidate pair between two components: each end with the centre of the other's component.

    The centre is the class with the most links. Copies of one text are often nearer to it than to
    each other, so this joins them with one comparison each instead of one per pair of copies.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n"))
    centres = ends.join(roots, "node").groupBy("root").agg(F.max_by("node", F.struct("n", "node")).alias("centre"))
    # an end asks a centre once, however many candidates it has in its component
    towards = lambda end, root: apart.select(F.col(end).alias("x"), F.col(root).alias("root"))
    asks = towards("a", "root_b").union(towards("b", "root_a")).distinct().join(centres, "root")
    return asks.select(F.least("x", "centre").alias("a"), F.greatest("x", "centre").alias("b")).distinct()


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are not connected yet, with the roots of both."""
    side = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    joined = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    named = joined.select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b"))
    return named.filter("root_a <> root_b")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, settings: Settings = Settings()
) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id and kept.

    ``component_id`` is the smallest key that links lead to, the row's own included, and
    ``kept`` marks the rows that have it. NULL texts and texts without words have no shingle
    and are linked with nothing. A NULL key is greater than any other; rows that share a key are
    linked through their texts only, and are kept or not by the key. Other columns are not returned.
    """
    sketched, classes, roots = classes_and_links(docs, text, key, words, percent, settings)
    rooted = classes.select("n", "h1", "h2", "least", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(smallest, "root").select("n", "h1", "h2", "component")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return (
        sketched.select("id", "n", "h1", "h2")
        .join(named, ["n", "h1", "h2"], "left")
        .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
    )


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose group has a smaller key; all columns stay.

    Rows with a NULL key cannot be named and stay.
    """
    gone = near_duplicates(docs, text, key, words, percent).filter("not kept").select(F.col(key).alias("_gone"))
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")

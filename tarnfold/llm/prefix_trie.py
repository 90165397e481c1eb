"""Prefix trie of conversations that share heads, by composable fingerprints.

A conversation is rebuilt from the first turns of its family's base conversation and its own turns after
as many. No rebuilt text is made. The fingerprint of a sequence of turns is an element of a monoid: per lane
the pair (sum of x_i * B**i, length) modulo a prime, where joining two sequences multiplies the second sum by a
power of B. One sorted scan of the original turns gives the fingerprint of every prefix; a rebuilt prefix is
base head times own range, and an own range is the difference of two prefixes, moved by at most ``heads`` places.
So every rebuilt turn is a row of numbers: its depth, fingerprints with and without it, and a reference to the
stored turn it repeats.

Nodes are groups of equal (depth, fingerprint). Each group is verified: all its members' last turns refer to
turns of one digest, their prefixes without it are one group again, and the turns of one digest are
compared as texts. If anything differs, all is done again with other fingerprints.

Subtree totals double their reach every round (1, 2, 4, ... levels), so that deep tries take few rounds and no
row is copied to all its ancestors. Nodes with one conversation are chains and need no rounds.

The sorted scan cuts a long conversation wherever its partition ends; the pieces, at most two a
partition, are joined by the monoid's product. Digests of members are hashed in a stream over sorted
blocks of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tarnfold.llm.common import stored, tasks
from tarnfold.operators.joins import lookup

PRIME = (1 << 31) - 1
LANES = 4
# Rows of a long conversation that meet one copy of its head; ids in a block of members.
PART_ROWS = ID_BLOCK = 4096
_H = [f"h{i}" for i in range(LANES)]
_B = [f"b{i}" for i in range(LANES)]
_D = [f"d{i}" for i in range(4)]
_KEY = ["depth", "k1", "k2"]


@dataclass(frozen=True)
class Settings:
    """Conversations c - c % ``family`` lend their first crc32(c) % ``heads`` turns. ``prime`` is small in tests only."""

    family: int = 5
    heads: int = 9
    prime: int = PRIME


def bases(prime: int, attempt: int) -> list[int]:
    seeds = [hashlib.sha256(f"{attempt}:{lane}".encode()).digest() for lane in range(LANES)]
    return [2 + int.from_bytes(s, "big") % (prime - 2) for s in seeds]


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def _prefixes(base: list[int], prime: int):
    """Place and prefix fingerprints, without (b) and with (h) each turn, within this partition's piece of a conversation."""
    q = np.uint64(prime)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, count, sums = None, 0, np.zeros(LANES, np.uint64)
        powers = np.ones((LANES, 0), np.uint64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(0).to_numpy(zero_copy_only=False)
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(n, 4)
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
            place = np.arange(n) - first[run] + 1
            goes_on = current is not None and conv[0] == current
            if goes_on:
                place[run == 0] += count
            if int(place.max()) >= powers.shape[1]:
                powers = np.stack([_powers(b, 2 * int(place.max()) + 2, prime) for b in base])
            columns, h = [], np.zeros((LANES, n), np.uint64)
            for lane in range(LANES):
                term = raw[:, lane] % q * powers[lane][place] % q
                total = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
                h[lane] = total[1:] - total[first][run]
                if goes_on:
                    h[lane][run == 0] += sums[lane]
                h[lane] %= q
                columns.append((h[lane] + q - term) % q)
            current, count, sums = conv[-1], int(place[-1]), h[:, -1].copy()
            whole = [pa.array(np.full(n, part, np.int32)), pa.array(place.astype(np.int64)), batch.column(2)]
            turns = [pa.array(np.ascontiguousarray(raw[:, i]).view(np.int64)) for i in range(4)]
            lanes = [pa.array(x.astype(np.int64)) for x in (*h, *columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *whole, *turns, *lanes], names=["conv", "part", "place", "n_bytes", *_D, *_H, *_B])

    return scan


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = turns.select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).filter("conv is not null")
    told = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(told, 256)))


def _pieces(scanned: DataFrame, base: list[int], prime: int) -> DataFrame:
    """The scan with places and fingerprints counted from the begin of each conversation.

    Only conversations cut by a partition's end are corrected; their pieces are at most two a partition.
    """
    last = F.max(F.struct("place", *_H)).alias("last")
    pieces = scanned.groupBy("conv", "part").agg(last).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "last"))).alias("all"))
    moves = []
    for row in pieces.filter(F.size("all") > 1).toLocalIterator():
        before, sums = 0, [0] * LANES
        for piece in row["all"]:
            shift = [pow(b, before, prime) for b in base]
            if before:
                moves.append((row["conv"], piece["part"], before, *sums, *shift))
            sums = [(s + piece["last"][h] * m) % prime for s, h, m in zip(sums, _H, shift)]
            before += piece["last"]["place"]
    if not moves:
        return scanned
    s, m = [f"s{i}" for i in range(LANES)], [f"m{i}" for i in range(LANES)]
    schema = ", ".join(["m_conv long", "m_part int", "before long", *[f"{c} long" for c in s + m]])
    side = F.broadcast(scanned.sparkSession.createDataFrame(moves, schema))
    joined = scanned.join(side, (F.col("conv") == F.col("m_conv")) & (F.col("part") == F.col("m_part")), "left")

    def moved(lane: int, column: str) -> Column:
        return F.when(F.col("before").isNull(), F.col(column)).otherwise(F.pmod(F.col(s[lane]) + F.col(column) * F.col(m[lane]), F.lit(prime)))

    return joined.select(
        "conv", "part", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "n_bytes", *_D,
        *[moved(i, c).alias(c) for i, c in enumerate(_H)], *[moved(i, c).alias(c) for i, c in enumerate(_B)],
    )


def _packed(lanes: list[Column], names: tuple[str, str]) -> list[Column]:
    return [(F.shiftleft(lanes[2 * i], 31) + lanes[2 * i + 1]).alias(name) for i, name in enumerate(names)]


def rebuilt(turns: DataFrame, s: Settings, base: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows of all rebuilt conversations without texts, and one row per conversation with its end.

    The first: conv, depth, the repeated turn (ref_conv, ref_place), its bytes and digest (d0 to d3), keys of the
    prefix with the turn (k1, k2) and without (p1, p2). The second: conv, depth, k1, k2.
    """
    q = F.lit(s.prime)
    spark, most = turns.sparkSession, s.heads - 1
    order = ["conv", F.asc_nulls_first("turn"), "digest"]
    slim = turns.select("conv", "turn", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    dealt = slim.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).select("conv", "digest", "n_bytes")
    schema = ", ".join(["conv long", "part int", "place long", "n_bytes long", *[f"{c} long" for c in _D + _H + _B]])
    places = _pieces(stored(dealt.mapInArrow(_prefixes(base, s.prime), schema)), base, s.prime)

    head = F.when(F.col("place") <= most, F.struct("place", "n_bytes", *_D, *_H, *_B))
    convs = places.groupBy("conv").agg(
        F.max(F.struct("place", *_H)).alias("whole"), F.array_sort(F.collect_list(head)).alias("head")
    )
    convs = stored(
        convs.withColumn("base", F.col("conv") - F.col("conv") % s.family).withColumn("h", F.crc32(F.col("conv").cast("string")) % s.heads)
    )
    lent = convs.select(F.col("conv").alias("base"), F.col("head").alias("lent"))
    info = convs.join(lent, "base", "left").withColumn("lent", F.slice(F.coalesce("lent", F.array().cast(dict(lent.dtypes)["lent"])), 1, F.greatest(F.col("h").cast("int"), F.lit(0))))
    n_lent = F.size("lent").cast("long")

    def at(array: str, place: Column, lane: int) -> Column:
        return F.when(place > 0, F.get(F.col(array), (place - 1).cast("int"))[f"h{lane}"]).otherwise(F.lit(0)).cast("long")

    def by_power(lane: int) -> Column:
        """B ** (lent - h), by which own turns move; the exponent is 0 to -most."""
        inverse = pow(base[lane], -1, s.prime)
        return F.get(F.array(*[F.lit(pow(inverse, e, s.prime)).cast("long") for e in range(most + 1)]), (F.col("h") - n_lent).cast("int"))

    info = info.select(
        "conv", "base", "h", "lent", n_lent.alias("n_lent"), F.col("whole.place").alias("n"),
        *[F.col(f"whole.h{i}").alias(f"w{i}") for i in range(LANES)],
        *[at("lent", n_lent, i).alias(f"x{i}") for i in range(LANES)],
        *[F.coalesce(at("head", F.col("h"), i), F.lit(0)).alias(f"y{i}") for i in range(LANES)],
        *[by_power(i).alias(f"z{i}") for i in range(LANES)],
    )
    info = stored(info)

    def own(column: str, lane: int) -> Column:
        """Lent head times the own range up to ``column``."""
        return F.pmod(F.col(f"x{lane}") + F.pmod(F.col(column) - F.col(f"y{lane}"), q) * F.col(f"z{lane}"), q)

    heads = info.select("conv", F.col("base").alias("ref_conv"), F.inline("lent"))
    heads = heads.select(
        "conv", F.col("place").alias("depth"), "ref_conv", F.col("place").alias("ref_place"), "n_bytes", *_D,
        *_packed([F.col(c) for c in _H], ("k1", "k2")), *_packed([F.col(c) for c in _B], ("p1", "p2")),
    )
    # a long conversation's rows are dealt out in parts, each with a copy of its one row of info
    facts = [c for c in info.columns if c not in ("base", "lent")]
    spread = info.filter("n > h").select(*facts, F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / PART_ROWS))).alias("slice"))
    tails = places.withColumn("slice", F.floor(F.col("place") / PART_ROWS)).join(spread, ["conv", "slice"]).filter("place > h")
    tails = tails.select(
        "conv", (F.col("n_lent") + F.col("place") - F.col("h")).alias("depth"), F.col("conv").alias("ref_conv"),
        F.col("place").alias("ref_place"), "n_bytes", *_D,
        *_packed([own(c, i) for i, c in enumerate(_H)], ("k1", "k2")), *_packed([own(c, i) for i, c in enumerate(_B)], ("p1", "p2")),
    )
    longer = F.col("n") > F.col("h")
    ends = info.select(
        "conv", (F.col("n_lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"),
        *_packed([F.when(longer, own(f"w{i}", i)).otherwise(F.col(f"x{i}")) for i in range(LANES)], ("k1", "k2")),
    )
    return stored(heads.union(tails)), ends


def _nodes(rows: DataFrame, ends: DataFrame) -> tuple[DataFrame, bool]:
    """Groups of equal prefixes, and whether every group's references agree."""
    alike = [c for c in (*_D, "p1", "p2", "n_bytes")]
    nodes = rows.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"),
        *[F.min(c).alias(c) for c in alike], *[F.max(c).alias(f"max_{c}") for c in alike],
    )
    nodes = stored(nodes)
    differ = F.lit(False)
    for c in alike:
        differ = differ | (F.col(c) != F.col(f"max_{c}"))
    agree = nodes.filter(differ).isEmpty()
    void = [F.lit(0).cast("long").alias(c) for c in _KEY]
    none = F.lit(None).cast("long")
    root = ends.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(*void, "conv_id", "n_convs", none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("n_bytes"))
    return root.union(nodes.select(*root.columns)), agree


def _same_texts(turns: DataFrame) -> bool:
    """Whether the turns of each digest have one role and text (compared in full, combined before the shuffle)."""
    said = F.struct("role", "text")
    return turns.groupBy("digest").agg(F.min(said).alias("a"), F.max(said).alias("b")).filter("a <> b").isEmpty()


def _subtree_sums(shared: DataFrame, rows: DataFrame) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over each node's subtree; after a round they reach twice as far down."""
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    sums, step = stored(shared), 1
    path = rows.select(F.col("conv").alias("a_conv"), F.col("depth").alias("a_depth"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    while step <= deepest:
        # the ancestor ``step`` levels up is the prefix of that depth of any member
        far = sums.filter(F.col("depth") > step).withColumn("up", F.col("depth") - step)
        far = far.join(path, (F.col("conv_id") == F.col("a_conv")) & (F.col("up") == F.col("a_depth"))).select("up", "a1", "a2", "leaves", "saved")
        to_root = sums.filter(F.col("depth") == step).select(*[F.lit(0).cast("long").alias(c) for c in ("up", "a1", "a2")], "leaves", "saved")
        more = far.union(to_root).groupBy("up", "a1", "a2").agg(F.sum("leaves").alias("m_leaves"), F.sum("saved").alias("m_saved"))
        joined = sums.join(more, (F.col("depth") == F.col("up")) & (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")), "left")
        added = [(F.col(c) + F.coalesce(f"m_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        sums = stored(joined.select(*_KEY, "conv_id", *added))
        step *= 2
    return sums


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each node from its sorted blocks, with one hasher at a time."""
    current, hasher = None, None
    for batch in batches:
        out = []
        for *key, ids in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if key != current:
                if current is not None:
                    out.append((*current, hasher.hexdigest()))
                current, hasher = key, hashlib.sha256(ids.encode())
            else:
                hasher.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "sha"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*current, hasher.hexdigest())], names=[*_KEY, "sha"])


def _member_hashes(ends: DataFrame) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    parts = ends.groupBy(*_KEY, F.floor(F.col("conv") / ID_BLOCK).alias("block")).agg(ids)
    dealt = parts.repartition(tasks(ends.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "block").select(*_KEY, "ids")
    return dealt.mapInArrow(_hash_members, "depth long, k1 long, k2 long, sha string")


def prefix_trie(
    turns: DataFrame, settings: Settings = Settings(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns follow their number, NULL first, and equal numbers follow by the digest of role and text; repeated rows
    all stay. NULL roles and texts are empty. Rows without a conversation id belong to none and are left out. An
    empty table has no nodes, not even a root. Other columns are not read.
    """
    rows = _turns(turns, conv, turn, role, text)
    if not _same_texts(rows):
        raise ValueError("two turns share a SHA-256 digest")
    attempt, agree = 0, False
    while not agree:
        members, ends = rebuilt(rows, settings, bases(settings.prime, attempt))
        nodes, agree = _nodes(members, ends)
        attempt += 1
        if attempt > 1:
            settings = Settings(settings.family, settings.heads)  # a prime too small for the data
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    below = below.agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("singles"))
    zero = F.lit(0).cast("long")
    nodes = nodes.join(below, _KEY, "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("n_children", "singles")} | {"up": F.col("depth") - 1}
    )
    nodes = stored(nodes)
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("singles")).cast("long").alias("leaves")
    saved = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")
    sums = _subtree_sums(nodes.filter("n_convs > 1").select(*_KEY, "conv_id", leaves, saved), members)
    parents = nodes.filter("n_children > 0").select(
        F.col("depth").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    side = nodes.select(*_KEY, "conv_id", "n_convs", "n_children", "up", "p1", "p2")
    placed = lookup(side, parents.withColumnRenamed("n_children", "met"), ["up", "p1", "p2"], weight="met")
    out = placed.join(sums.drop("conv_id"), _KEY, "left").join(_member_hashes(ends), _KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )

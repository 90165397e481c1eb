"""Document fingerprints from closed syncmers.

A k-mer (K bytes) is an anchor if the least of the hashes of its S-byte substrings is its
first or its last one. That depends on nothing around it, so equal stretches of two texts
have the same anchors wherever they stand. The fingerprint holds all distinct anchors by hash,
each with the place of its first occurrence. Two texts are as alike as the share of their united
anchors that both have in the same order (the longest common chain of anchors). ``occurrences``
gives every anchor with every place as rows, to match stretches by a join.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tarnfold.llm.common import blocks, flat, mix, tasks

K, S = 16, 8
KEPT = None  # no bound: a fingerprint holds all anchors
_BLOCK = 1 << 22
_ANCHOR = np.dtype([("hash", ">u4"), ("place", ">u4")])


def _select(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in the block, and their hashes."""
    padded = np.zeros(len(data) + K, np.uint8)
    padded[: len(data)] = data
    h = mix(np.ndarray((len(data) + S,), "<u8", padded, strides=(1,)) + np.uint64(0x9E3779B97F4A7C15))
    n = len(data)
    two = np.minimum(h[:-1], h[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    first, last = h[:n], h[S : n + S]
    anchor = np.minimum(eight[:n], last)
    anchor = (anchor == first) | (anchor == last)
    # a k-mer ends inside its text
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        anchor[max(a, b - K + 1) : b] = False
    place = np.flatnonzero(anchor)
    return place, mix(h[place] * np.uint64(3) + h[place + S])


def anchors(texts: pa.Array) -> list[np.ndarray]:
    """The anchors of each text, by hash; a text without any has one for the whole of it, an empty text none."""
    data, starts = flat(texts)
    out: list[np.ndarray] = []
    for i, j in blocks(starts):
        part, at = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        place, value = _select(part, at)
        value = (value >> np.uint64(32)).astype(np.uint32)
        first = np.searchsorted(place, at)
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            if a < b:
                hashes, where = np.unique(value[a:b], return_index=True)
                rows = np.empty(len(hashes), _ANCHOR)
                rows["hash"], rows["place"] = hashes, place[a:b][where] - at[r]
            elif at[r] < at[r + 1]:
                rows = np.zeros(1, _ANCHOR)
                rows["hash"] = int.from_bytes(hashlib.sha256(part[at[r] : at[r + 1]].tobytes()).digest()[:4], "big")
            else:
                rows = np.zeros(0, _ANCHOR)
            out.append(rows)
    return out


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the united anchors that both texts have in the same order; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, x, y = np.intersect1d(a["hash"].astype(np.uint32), b["hash"].astype(np.uint32), assume_unique=True, return_indices=True)
    places = b["place"].astype(np.int64)[y][np.argsort(a["place"][x].astype(np.int64), kind="stable")]
    union = len(a) + len(b) - len(x)
    if (places[1:] > places[:-1]).all():
        return len(places) / union
    chain: list[int] = []
    for place in places.tolist():
        k = bisect_left(chain, place)
        chain[k : k + 1] = [place]
    return len(chain) / union


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hash, place): every anchor of every text wherever it occurs, with the whole 64-bit hash.

    Places count bytes. NULL texts and texts without an anchor have no row.
    """

    @F.arrow_udf("array<struct<hash: bigint, place: bigint>>")
    def found(texts: pa.Array) -> pa.Array:
        data, starts = flat(texts)
        hashes, places, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for i, j in blocks(starts):
            at = starts[i : j + 1] - starts[i]
            place, value = _select(data[starts[i] : starts[j]], at)
            count = np.diff(np.searchsorted(place, at))
            hashes.append(value)
            places.append(place - np.repeat(at[:-1], count))
            counts.append(count)
        rows = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places).astype(np.int64))], ["hash", "place"]
        )
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), rows)

    return docs.select(F.col(key), F.inline(found(F.col(text))))


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text, in hexadecimal; it is empty for NULL and empty texts.

    All rows and other columns stay; a column already called ``into`` is replaced.
    """

    @F.arrow_udf("string")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([x.tobytes().hex() for x in anchors(texts)], pa.string())

    return docs.withColumn(into, fingerprint(F.col(text)))


def likeness(pairs: DataFrame, left: str, right: str, into: str = "likeness") -> DataFrame:
    """``pairs`` with how alike the texts of two fingerprints are, from 0 to 1; NULL counts as empty."""

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        read = lambda x: np.frombuffer(bytes.fromhex(x or ""), _ANCHOR)
        return pa.array([alike(read(x), read(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return pairs.withColumn(into, score(F.col(left), F.col(right)))


def with_following(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, follows, key, text) so that rows sorted by all of them have their follower next to them.

    The order is by descending key (NULL keys last, equal keys by text). Buckets are even ranges of
    keys; the first row of each comes a second time, marked ``follows``, at the end of the bucket
    before it, and the very first row at the end of the last bucket. So no task needs another's rows.
    """
    spark = docs.sparkSession
    n = 4 * tasks(spark)
    cuts = docs.select(F.percentile_approx(key, [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    edges = np.unique(np.array(cuts, np.int64))
    last = len(edges) + 1  # of NULL keys

    def number(ids: pa.Array) -> np.ndarray:
        found = len(edges) - np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        found[ids.is_null().to_numpy(zero_copy_only=False)] = last
        return found

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        return pa.array(number(ids).astype(np.int32))

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    tops = sorted((r.b, r.top) for r in source.select(bucket("key").alias("b"), "key").groupBy("b").agg(F.max("key").alias("top")).collect())
    before = {top: tops[k - 1][0] for k, (_, top) in enumerate(tops)}  # the first comes after the last

    @F.arrow_udf("array<struct<bucket: int, follows: boolean>>")
    def places(ids: pa.Array) -> pa.Array:
        out = []
        for b, i in zip(number(ids).tolist(), ids.to_pylist(), strict=True):
            own = [{"bucket": b, "follows": False}]
            out.append([*own, {"bucket": before[i], "follows": True}] if i in before else own)
        return pa.array(out, pa.list_(pa.struct([("bucket", pa.int32()), ("follows", pa.bool_())])))

    return source.select("key", "text", F.inline(places("key"))).select("bucket", "follows", "key", "text")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of 512 rows or _BLOCK bytes of text; fingerprints are larger than their texts."""
    begin, held = 0, 0
    for k, size in enumerate(pc.binary_length(batch.column("text")).fill_null(0).to_pylist()):
        if k > begin and (k - begin == 512 or held + size > _BLOCK):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_and_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's fingerprint against that of an edited copy and of the next text, by descending key.

    The edit replaces the last third of the code points with as many from the start of the next
    text. NULL texts are empty; a single row is its own next.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None
        for batch in batches:
            for part in _slices(batch):
                marks = [(i, f) for i, f in zip(part.column("key").to_pylist(), part.column("follows").to_pylist(), strict=True)]
                texts = [t or "" for t in part.column("text").to_pylist()]
                prints = anchors(pa.array(texts, pa.large_string()))
                rows = list(zip(marks, texts, prints, strict=True))
                if waiting:
                    rows.insert(0, waiting)
                waiting = rows[-1]
                own = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[0][1]]
                edited = [x[1][: len(x[1]) - len(x[1]) // 3] + y[1][: len(x[1]) // 3] for x, y in own]
                after = anchors(pa.array(edited, pa.large_string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0][0] for x, _ in own], pa.int64()),
                        pa.array([len(x[1]) for x, _ in own], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([x[2].tobytes().hex() for x, _ in own], pa.string()),
                        pa.array([e.tobytes().hex() for e in after], pa.string()),
                        pa.array([alike(x[2], e) for (x, _), e in zip(own, after, strict=True)], pa.float64()),
                        pa.array([alike(x[2], y[2]) for x, y in own], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    placed = with_following(docs, key, text).repartition(tasks(docs.sparkSession), "bucket")
    return placed.sortWithinPartitions("bucket", "follows", F.desc_nulls_last("key"), "text").mapInArrow(compare, RESULT)

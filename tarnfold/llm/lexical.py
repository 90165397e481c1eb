"""Ranked lexical search, exact: term at a time with a limited set of accumulators.

Documents are scored where they lie. A task turns its documents into shards of bounded size with
postings of the wanted terms, and takes each item's terms rarest first. A document gets an accumulator
when one of its terms is met; once the bounds of the terms to come, together, stay below the k-th
partial score, no new document can reach the best k, so no more accumulators are made. Those that can
still get there are updated to their exact scores by the remaining terms. The k-th score of one
shard is where the next one of the task begins. Each task hands on k documents of an item at most,
and the best k of all tasks are taken in a last shuffle.

Document frequencies come from a pass over all documents before. Items are sent in blocks of bounded
size; results of a block are written before the next one is read, so a large set of items is never in
one place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window as W, functions as F

from tarnfold.llm.common import LOWER, blocks, flat, prefix_hash, range_hash, stored

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
# What a term adds to a score stays below its weight times this.
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    """``k`` results an item; ``length_share`` percent of the length norm follow the document's length.

    ``block_bytes``: items (as text) that are sent to the tasks at once. ``shard_bytes``: texts scored together.
    """

    k: int = 10
    length_share: int = 75
    block_bytes: int = 4 << 20
    shard_bytes: int = 16 << 20


def terms_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, begin, end and hash of every term, and the first term of each row (one entry more than rows)."""
    low = LOWER[data]
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1 : n + 1] = _TERM[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(solid[1 : n + 1] & (~solid[:n] | edge[:n]))
    end = np.flatnonzero(solid[1 : n + 1] & (~solid[2:] | edge[1:])) + 1
    return low, begin, end, range_hash(prefix_hash(low), begin, end), np.searchsorted(begin, starts)


def split_terms(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    low, begin, end, _, _ = terms_of(data, np.array([0, len(data)]))
    return [low[b:e].tobytes() for b, e in zip(begin, end)]


class Vocabulary:
    """The terms of a block of items, found by hash and confirmed by their bytes."""

    def __init__(self, words: list[bytes]):
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        begins = np.concatenate([np.zeros(1, np.int64), ends])[:-1] if words else ends
        hashes = range_hash(prefix_hash(data), begins, ends)
        order = np.argsort(hashes, kind="stable")
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two terms of a block share a 64-bit hash: use another block size")
        self.words, self.data, self.begins, self.sizes = words, data, begins, ends - begins
        self.hashes, self.order = hashes[order], order
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given terms are in the vocabulary, and their numbers."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        term = self.order[place]
        same = (self.hashes[place] == hashes[at]) & (self.sizes[term] == end[at] - begin[at])
        at, term = at[same], term[same]
        sizes = self.sizes[term]
        total = int(sizes.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        equal = low[np.repeat(begin[at], sizes) + inside] == self.data[np.repeat(self.begins[term], sizes) + inside]
        if not equal.all():
            wrong = np.zeros(len(at), bool)
            wrong[np.repeat(np.arange(len(at)), sizes)[~equal]] = True
            at, term = at[~wrong], term[~wrong]
        return at, term


def _scan(texts: pa.Array, words: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: its first row, terms in each row, and the vocabulary's terms as (row, term)."""
    data, starts = flat(texts)
    for first, last in blocks(starts):
        own = starts[first : last + 1]
        low, begin, end, hashes, firsts = terms_of(data[own[0] : own[-1]], own - own[0])
        at, term = words.find(low, begin, end, hashes)
        yield first, np.diff(firsts), np.searchsorted(firsts, at, side="right") - 1, term


def _frequencies(words: Vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, texts, total = np.zeros(len(words.words), np.int64), 0, 0
        for batch in batches:
            for _, n, row, term in _scan(batch.column(0), words):
                texts += int((n > 0).sum())
                total += int(n.sum())
                once = np.unique(row * len(df) + term) if len(df) else row
                df += np.bincount(once % max(len(df), 1), minlength=len(df))
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([met, [-1, -2]])), pa.array(np.concatenate([df[met], [texts, total]]))], names=["term", "n"]
        )

    return count


class Best:
    """The k best (score, key) of an item so far; equal scores by key, NULL keys last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.keys, self.void = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, keys: np.ndarray, void: np.ndarray) -> None:
        scores, keys, void = (np.concatenate(x) for x in ((self.scores, scores), (self.keys, keys), (self.void, void)))
        order = np.lexsort((keys, void, -scores))[: self.k]
        self.scores, self.keys, self.void = scores[order], keys[order], void[order]


class Shard:
    """Postings of the wanted terms over some documents, and what each adds to a score."""

    def __init__(self, row: np.ndarray, term: np.ndarray, lengths: np.ndarray, n_terms: int, texts: int, total: int, share: int):
        pairs, tf = np.unique(term * len(lengths) + row, return_counts=True)
        self.size = len(lengths)
        self.rows = pairs % self.size
        norm = 100 - share + share * lengths * texts // max(total, 1)
        self.adds = SCALE * tf // (1000 * tf + 8 * norm[self.rows])
        self.at = np.searchsorted(pairs // self.size, np.arange(n_terms + 1))

    def search(self, wanted: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of all that can be among the k best, given that less than ``floor`` is not.

        ``wanted``: (term, weight times its repeats), rarest first.
        """
        wanted = [(t, w) for t, w in wanted if w > 0 and self.at[t] < self.at[t + 1]]
        bounds = [w * int(self.adds[self.at[t] : self.at[t + 1]].max()) for t, w in wanted]
        rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]]) if bounds else np.zeros(1)
        scores = np.zeros(self.size, np.int64)
        alive: np.ndarray | None = None
        for j, (t, w) in enumerate(wanted):
            if alive is None and rest[j] < max(floor, self._kth(scores, k)):
                alive = np.flatnonzero(scores)
            rows, adds = self.rows[self.at[t] : self.at[t + 1]], self.adds[self.at[t] : self.at[t + 1]]
            if alive is None:
                scores[rows] += w * adds
                continue
            alive = alive[scores[alive] + rest[j] >= max(floor, self._kth(scores[alive], k))]
            place = np.minimum(np.searchsorted(rows, alive), len(rows) - 1)
            hit = rows[place] == alive
            scores[alive[hit]] += w * adds[place[hit]]
        found = np.flatnonzero(scores) if alive is None else alive
        found = found[scores[found] >= max(floor, self._kth(scores[found], k), 1)]
        return found, scores[found]

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> int:
        return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _search(words: Vocabulary, items: list[list[tuple[int, int]]], texts: int, total: int, s: Settings):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(s.k) for _ in items]
        parts: list[tuple] = []
        size = rows = 0

        def score() -> None:
            row, term, lengths, keys, void = (np.concatenate([p[i] for p in parts]) for i in range(5))
            shard = Shard(row, term, lengths, len(words.words), texts, total, s.length_share)
            for one, wanted in zip(best, items):
                found, scores = shard.search(wanted, s.k, one.floor())
                if len(found):
                    one.add(scores, keys[found], void[found])

        for batch in batches:
            key = batch.column(0)
            void = key.is_null().to_numpy(zero_copy_only=False)
            keys = key.fill_null(0).to_numpy(zero_copy_only=False)
            sizes = np.diff(flat(batch.column(1))[1])
            for first, n, row, term in _scan(batch.column(1), words):
                here = slice(first, first + len(n))
                parts.append((row + rows, term, n.astype(np.int64), keys[here], void[here]))
                rows += len(n)
                size += int(sizes[here].sum())
                if size >= s.shard_bytes:
                    score()
                    parts.clear()
                    size = rows = 0
        if rows:
            score()
        for number, one in enumerate(best):
            if len(one.scores):
                keys = pa.array(one.keys, mask=one.void)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(one.scores), number, np.int32)), keys, pa.array(one.scores)], names=["item", "key", "score"]
                )

    return search


def _of_block(docs: DataFrame, rows: list[Row], item_type: str, s: Settings) -> DataFrame:
    """The best k documents of some items: (number, item, key, score), number being the item's place in the block."""
    asked = [Counter(split_terms(r.text)) for r in rows]
    words = Vocabulary(sorted(set().union(*asked)))
    number = {w: i for i, w in enumerate(words.words)}
    counted = docs.select("text").mapInArrow(_frequencies(words), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r.term: r.n for r in counted.collect()}  # one row per term of this block
    texts, total = df.get(-1, 0), df.get(-2, 0)
    weight = {t: math.floor(1000 * math.log((2 * texts + 2) / (2 * n + 1))) for t, n in df.items() if t >= 0}
    items = [
        sorted(((number[w], weight[number[w]] * n) for w, n in a.items() if number[w] in weight), key=lambda x: (df[x[0]], x[0])) for a in asked
    ]
    found = docs.mapInArrow(_search(words, items, texts, total, s), "number int, key long, score long")
    best = W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= s.k)
    names = docs.sparkSession.createDataFrame([(i, r.item) for i, r in enumerate(rows)], f"number int, item {item_type}")
    return ranked.join(F.broadcast(names), "number")  # as many rows as a block has items


def search(
    docs: DataFrame, items: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text"
) -> DataFrame:
    """(item, rank, key, score): the best documents of every item with a score above 0.

    NULL and empty texts have no terms. Every row of ``items`` is asked for itself, also with an item id that is
    NULL or used twice, and every row of ``docs`` is a document; keys are integers, NULL keys come last among equal
    scores. Without items, documents or common terms there are no rows. Other columns are not read.
    """
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    asked = items.select(F.col(item).alias("item"), F.col(query).alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    count = max(1, math.ceil(size / settings.block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    parts = []
    for b in range(count):
        rows = asked.filter(block == b).collect()  # about block_bytes
        part = _of_block(d, rows, dict(asked.dtypes)["item"], settings)
        parts.append(stored(part) if count > 1 else part)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    names = [F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"]
    return out.select(*names)

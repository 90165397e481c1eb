"""Benchmark decontamination: random-walk embedding, bit sampling, exact edit verification.

The walk of Chakraborty, Goldenberg and Koucky reads a string byte by byte and at each of its
steps stays or moves on as a random function of step and byte says. Two strings few edits
apart meet again after every edit, so their embeddings, the bytes read, differ in few places:
edit distance becomes Hamming distance. A repetition draws a walk and samples of its
places; windows of text and of items with equal samples are candidates.

A window begins at every word of a text and is as long as an item from the word it
matches on, so an item is found from any of its words behind which the sampled stretch
is the same or has met again. With a fifth of the words of a 40-word item replaced, a word is
followed by such a stretch (about 30 bytes) with a chance of 0.25, and the words and
``repetitions`` together miss an item with a chance below 0.02; with a tenth, below 0.001. Each
candidate is verified by exact edit distance on the window of the item's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tarnfold.llm.common import LOWER, blocks, flat, fresh, mix, word_ranges

# Steps of the walk after which windows are sifted, and places sampled up to each.
STAGES = ((12, 4), (30, 4), (60, 6))
# Shorter items are looked for as they are, as no walk fits into them.
SHORT_BYTES = 40
# Items are shipped to the tasks in blocks of about this size.
BLOCK_BYTES = 4_000_000
_FILTER_BITS = 20
_FOLD = LOWER.copy()
_FOLD[[9, 10, 11, 12, 13]] = 32
FOUND = "array<struct<item_id: bigint, distance: int, begin: bigint, end: bigint>>"
_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]))


@dataclass(frozen=True)
class Settings:
    """``edits``: share of an item's bytes that may be edited. ``repetitions``: walks drawn."""

    edits: float = 0.3
    repetitions: int = 3
    seed: int = 29


class Walk:
    """One repetition: the moves of each step for each byte, and which steps are sampled."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        steps = STAGES[-1][0]
        self.moves = rng.integers(0, 2, (steps, 256), dtype=np.int64)
        self.sampled = np.zeros(steps, bool)
        before = 0
        for until, count in STAGES:
            self.sampled[rng.choice(np.arange(before, until), count, replace=False)] = True
            before = until

    def go(self, data: np.ndarray, place: np.ndarray, key: np.ndarray, stage: int) -> None:
        """Move every window through one stage; ``place`` and ``key`` change."""
        begin = STAGES[stage - 1][0] if stage else 0
        for step in range(begin, STAGES[stage][0]):
            read = data[place]
            if self.sampled[step]:
                key *= np.uint64(0x100000001B3)
                key += read
            place += self.moves[step][read]


def _slot(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


class Index:
    """The sampled windows of a block of items, for every repetition."""

    def __init__(self, items: list[tuple[int, bytes]], s: Settings) -> None:
        self.settings = s
        folded = [(i, _FOLD[np.frombuffer(t, np.uint8)]) for i, t in items]
        self.short = [(i, t.tobytes()) for i, t in folded if 0 < len(t) < SHORT_BYTES]
        self.items = [(i, t.tobytes()) for i, t in folded if len(t) >= SHORT_BYTES]
        data = np.zeros(sum(len(t) for _, t in self.items) + STAGES[-1][0], np.uint8)
        starts = np.cumsum([0] + [len(t) for _, t in self.items])
        if self.items:
            data[: starts[-1]] = np.frombuffer(b"".join(t for _, t in self.items), np.uint8)
        begin, _, first = word_ranges(data[: starts[-1]], starts)
        owner = np.repeat(np.arange(len(self.items)), np.diff(first))
        self.walks = [Walk(s.seed + r) for r in range(s.repetitions)]
        self.filters, self.keys, self.owners, self.offsets = [], [], [], []
        for walk in self.walks:
            place, key, seen = begin.copy(), np.zeros(len(begin), np.uint64), []
            for stage in range(len(STAGES)):
                walk.go(data, place, key, stage)
                seen.append(key.copy())
            inside = place <= starts[owner + 1]
            order = np.argsort(key[inside], kind="stable")
            self.filters.append([self._filter(k[inside]) for k in seen[:-1]])
            self.keys.append(key[inside][order])
            self.owners.append(owner[inside][order])
            self.offsets.append((begin - starts[owner])[inside][order])

    @staticmethod
    def _filter(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << _FILTER_BITS, bool)
        out[_slot(keys)] = True
        return out

    def candidates(self, data: np.ndarray, begin: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, item, place where the item would begin) of windows with the samples of an item's."""
        padded = np.concatenate([data, np.zeros(STAGES[-1][0], np.uint8)])
        out = []
        for r, walk in enumerate(self.walks):
            at, place, key = begin, begin.copy(), np.zeros(len(begin), np.uint64)
            for stage in range(len(STAGES)):
                walk.go(padded, place, key, stage)
                if stage < len(STAGES) - 1:
                    keep = np.flatnonzero(self.filters[r][stage][_slot(key)])
                    at, place, key = at[keep], place[keep], key[keep]
            low, high = np.searchsorted(self.keys[r], key), np.searchsorted(self.keys[r], key, side="right")
            many = high - low
            hit = np.repeat(np.arange(len(at)), many)
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[hit]
            out.append((at[hit], self.owners[r][entry], at[hit] - self.offsets[r][entry]))
        return out


def best_match(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``text``, and where the first such stretch ends (bit-parallel)."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, b in enumerate(item):
        masks[b] = masks.get(b, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for n, b in enumerate(text):
        eq = masks.get(b, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(xh | up)), up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1, minus << 1
        up, down = (minus | (full & ~(xv | plus))) & full, plus & xv & full
        if score < best:
            best, end = score, n + 1
    return best, end


def verify(item: bytes, text: bytes, guess: int, limit: int) -> tuple[int, int, int] | None:
    """(distance, begin, end) of the item in ``text`` around ``guess``, if within ``limit`` edits."""
    low = max(0, guess - limit)
    window = text[low : max(0, guess + len(item) + limit)]
    distance, end = best_match(item, window)
    if distance > limit:
        return None
    _, back = best_match(item[::-1], window[:end][::-1])
    return distance, low + end - back, low + end


def find(texts: pa.Array, index: Index) -> list[list[dict]]:
    data, starts = flat(texts)
    found: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(len(texts))]
    for i, j in blocks(starts):
        part, at = _FOLD[data[starts[i] : starts[j]]], starts[i : j + 1] - starts[i]
        begin, _, _ = word_ranges(part, at)
        asked: set[tuple[int, int, int]] = set()
        for place, item, guess in index.candidates(part, begin) if index.items else []:
            rows = np.searchsorted(at, place, side="right") - 1
            for row, k, g in zip(rows.tolist(), item.tolist(), guess.tolist(), strict=True):
                item_id, text = index.items[k]
                limit = int(index.settings.edits * len(text))
                # a verification covers all beginnings within the limit, so one per stretch of that length will do
                spot = (row, k, g // max(1, limit // 2))
                if spot in asked:
                    continue
                asked.add(spot)
                got = verify(text, part[at[row] : at[row + 1]].tobytes(), g - int(at[row]), limit)
                if got is not None and got < found[i + row].get(item_id, (1 << 30,)):
                    found[i + row][item_id] = got
        for item_id, text in index.short:
            whole = part.tobytes()
            where = whole.find(text)
            while where >= 0:
                row = int(np.searchsorted(at, where, side="right")) - 1
                if where + len(text) <= at[row + 1]:
                    local = where - int(at[row])
                    found[i + row].setdefault(item_id, (0, local, local + len(text)))
                where = whole.find(text, where + 1)
        for row in range(i, j):
            if found[row]:
                text = data[starts[row] : starts[row + 1]]
                point = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                found[row] = {k: (d, int(point[a]), int(point[b])) for k, (d, a, b) in found[row].items()}
    return [[{"item_id": k, "distance": v[0], "begin": v[1], "end": v[2]} for k, v in sorted(f.items())] for f in found]


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", settings: Settings = Settings()) -> Column:
    """For each row of ``docs``: (item_id, distance, begin, end) of every item it holds, the best place of each.

    Distances are in bytes of UTF-8, after A-Z is put in lower case and white space as spaces;
    begin and end are in code points. NULL and empty texts hold nothing; NULL and empty items, and items
    without an id, are in no text; equal items are all reported. Items of fewer than
    SHORT_BYTES bytes must occur as they are. The benchmark may be of any size: it is measured, split
    by hash, and each block is sent to the tasks and searched for in turn.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and octet_length(t) > 0")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    parts = []
    for block in range(n):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block).collect() if n > 1 else items.collect()
        listed = sorted((r.i, r.t.encode()) for r in rows)
        parts.append(_search(listed, settings)(F.col(text)))
    return F.concat(*parts) if parts else F.array().cast(FOUND)


def _search(items: list[tuple[int, bytes]], settings: Settings):
    made: list[Index] = []  # once per task

    @F.arrow_udf(FOUND)
    def search(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Index(items, settings))
        return pa.array(find(texts, made[0]), _FOUND)

    return search


def contaminations(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """One row per document and benchmark item found in it: key, item_id, distance, begin and end."""
    return docs.select(F.col(key), leaks(docs, benchmark, text, settings=settings).alias("_leaks")).select(key, F.inline("_leaks"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay."""
    mark = fresh(docs, "_leaks")
    return docs.withColumn(mark, leaks(docs, benchmark, text, settings=settings)).filter(F.size(mark) == 0).drop(mark)

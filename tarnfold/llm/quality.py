"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is ``sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``. The
features are hashed words (their share of the text, square-rooted) and binned statistics
of its structure, with the stored length as metadata. All pairs cost linear time: their
sum is ``(|sum v_i x_i|**2 - sum |v_i|**2 x_i**2) / 2``. Trained by stochastic gradient
descent in numpy on a sample whose size per label is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tarnfold.llm.common import LOWER, blocks, bounded_sample, flat, fresh, prefix_hash, range_hash, word_ranges

STATISTICS = 12
BINS = 16


@dataclass(frozen=True)
class Settings:
    """``per_label`` bounds the sample; texts beyond ``train_bytes`` are not trained on."""

    per_label: int = 3_000
    train_bytes: int = 200_000
    bits: int = 16
    factors: int = 6
    epochs: int = 6
    rate: float = 0.1
    batch: int = 64
    decay: float = 1e-5
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """``table``: weight, factors and squared length of the factors of each bucket; None if nothing was learned."""

    bias: float
    table: np.ndarray | None
    edges: np.ndarray
    bits: int


_KIND = np.zeros((6, 256), np.uint8)  # upper case, digit, other ASCII mark, line end, byte beyond ASCII, bar
_KIND[0, 65:91] = 1
_KIND[1, 48:58] = 1
_KIND[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_KIND[3, 10] = 1
_KIND[4, 128:] = 1
_KIND[5, [124, 123, 125, 60, 62, 61]] = 1


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def words_and_statistics(texts: pa.Array, meta: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: distinct word buckets, their shares, where each text begins in them, and statistics."""
    data, starts = flat(texts)
    rows, buckets, counts, stats = [], [], [], np.zeros((len(texts), STATISTICS))
    for i, j in blocks(starts):
        part, at = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        begin, end, first = word_ranges(part, at)
        hashes = range_hash(prefix_hash(LOWER[part]), begin, end)
        n_words, n_bytes = np.diff(first), np.diff(at)
        owner = np.repeat(np.arange(j - i), n_words)
        key, count = np.unique(
            (owner.astype(np.uint64) << np.uint64(bits)) | (hashes >> np.uint64(64 - bits)), return_counts=True
        )
        who = (key >> np.uint64(bits)).astype(np.int64)
        rows.append(who + i)
        buckets.append((key & np.uint64((1 << bits) - 1)).astype(np.int64))
        counts.append(count)
        words, size = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
        top = np.zeros(j - i)
        np.maximum.at(top, who, count)
        twice = np.zeros(len(hashes), bool)
        twice[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        s = stats[i:j]
        s[:, 0] = np.log1p(n_words)
        s[:, 1] = np.bincount(who, minlength=j - i) / words
        s[:, 2] = top / words
        s[:, 3] = _sums((end - begin).astype(np.float64), first) / words
        for k in range(6):
            s[:, 4 + k] = _sums(_KIND[k][part], at) / size
        s[:, 10] = _sums(twice, first) / words
        s[:, 11] = meta[i:j]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(len(texts) + 1, np.int64), stats
    who, bucket, count = np.concatenate(rows), np.concatenate(buckets), np.concatenate(counts)
    total = np.bincount(who, count, len(texts))
    share = np.sqrt(count / total[who]).astype(np.float32)
    return bucket, share, np.searchsorted(who, np.arange(len(texts) + 1)), stats


def _binned(stats: np.ndarray, edges: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of every statistic's bin, behind the word buckets."""
    bins = np.stack([np.searchsorted(edges[k], stats[:, k], side="right") for k in range(STATISTICS)], axis=1)
    return (1 << bits) + np.arange(STATISTICS) * (BINS + 1) + bins


STAT_VALUE = np.float32(1 / np.sqrt(STATISTICS))


def scores(texts: pa.Array, meta: np.ndarray, model: Model) -> np.ndarray:
    """Probability of a good text, in time linear in its words."""
    if model.table is None:
        return np.full(len(texts), 0.5)
    bucket, value, at, stats = words_and_statistics(texts, meta, model.bits)
    binned = _binned(stats, model.edges, model.bits)
    table, factors = model.table, model.table.shape[1] - 2
    raw = np.full(len(texts), model.bias)
    raw += _sums(table[bucket, 0] * value, at) + table[binned, 0].sum(axis=1) * STAT_VALUE
    square = _sums(table[bucket, -1] * value**2, at) + table[binned, -1].sum(axis=1) * STAT_VALUE**2
    for f in range(1, factors + 1):
        one = _sums(table[bucket, f] * value, at) + table[binned, f].sum(axis=1) * STAT_VALUE
        raw += 0.5 * one**2
    return 1 / (1 + np.exp(-np.clip(raw - 0.5 * square, -30, 30)))


def train(texts: list[str], meta: list[float], labels: list[int], s: Settings) -> Model:
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        bias = 0.0 if not labels else (4.0 if labels[0] == 1 else -4.0)
        table = np.zeros(((1 << s.bits) + STATISTICS * (BINS + 1), s.factors + 2), np.float32)
        return Model(bias, table if labels else None, np.zeros((STATISTICS, BINS)), s.bits)
    bucket, value, at, stats = words_and_statistics(pa.array(texts, pa.large_string()), np.array(meta), s.bits)
    edges = np.quantile(stats, np.linspace(0.02, 0.98, BINS), axis=0).T.copy()
    binned = _binned(stats, edges, s.bits)
    rng = np.random.default_rng(s.seed)
    size = (1 << s.bits) + STATISTICS * (BINS + 1)
    weights = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.05, (size, s.factors))], axis=1)
    spread = np.full((size, s.factors + 1), 1e-4)
    bias, bias_spread = 0.0, 1e-4
    balance = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    for _ in range(s.epochs):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // s.batch)):
            ids = np.concatenate([np.concatenate([bucket[at[r] : at[r + 1]], binned[r]]) for r in some])
            x = np.concatenate([np.concatenate([value[at[r] : at[r + 1]], np.full(STATISTICS, STAT_VALUE)]) for r in some])
            n = np.array([at[r + 1] - at[r] + STATISTICS for r in some])
            cut = np.concatenate([[0], np.cumsum(n)])
            owner = np.repeat(np.arange(len(some)), n)
            touched, place = np.unique(ids, return_inverse=True)
            rows = weights[touched][place]
            v = rows[:, 1:] * x[:, None]
            sums = np.add.reduceat(v, cut[:-1], axis=0)
            raw = bias + np.add.reduceat(rows[:, 0] * x, cut[:-1])
            raw += 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((v**2).sum(axis=1), cut[:-1]))
            wrong = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) * balance[some]
            step = wrong[owner] * x
            grad = np.stack(
                [np.bincount(place, step, len(touched))]
                + [np.bincount(place, step * (sums[owner, f] - v[:, f]), len(touched)) for f in range(s.factors)],
                axis=1,
            ) / len(some) + s.decay * weights[touched]
            spread[touched] += grad**2
            weights[touched] -= s.rate * grad / np.sqrt(spread[touched])
            g = wrong.mean()
            bias_spread += g * g
            bias -= s.rate * g / np.sqrt(bias_spread)
    table = np.concatenate([weights, (weights[:, 1:] ** 2).sum(axis=1, keepdims=True)], axis=1).astype(np.float32)
    return Model(float(bias), table, edges, s.bits)


def _metadata(docs: DataFrame, text: str, length: str | None) -> object:
    """Logarithm of the stored length, or of the real one where none is stored."""
    real = F.char_length(F.coalesce(F.col(text), F.lit("")))
    stored = F.col(f"`{length}`").cast("double") if length and length in docs.columns else F.lit(None).cast("double")
    return F.coalesce(F.log1p(F.greatest(stored, F.lit(0.0))), F.log1p(real.cast("double")))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    label: str = "quality",
    key: str = "doc_id",
    length: str | None = "n_chars",
    settings: Settings = Settings(),
) -> Model:
    """Learn from labelled texts. Keys are drawn from the labels first, so that only their texts are gathered.

    Labels other than 0 and 1 are ignored; of several labels of a key the lowest counts.
    """
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    drawn = bounded_sample(known.filter(F.col("k").isNotNull()), "y", settings.per_label, "k")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), _metadata(docs, text, length).alias("m")).filter(
        F.col("t").isNotNull() & (F.octet_length("t") <= settings.train_bytes)
    )
    # bounded: about settings.per_label keys for each of two labels
    sample = rows.join(F.broadcast(drawn), "k").collect()
    sample.sort(key=lambda r: (str(r.k), r.t))
    return train([r.t for r in sample], [r.m for r in sample], [int(r.y) for r in sample], settings)


def score(
    docs: DataFrame, model: Model, text: str = "text", length: str | None = "n_chars", into: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """``docs`` with the probability of a good text and 1 where it is at least one half.

    NULL and empty texts are scored by their (empty) structure; without a learned label every
    score is 0.5. All rows and other columns stay; columns already called as in ``into`` are replaced.
    """

    @F.arrow_udf("double")
    def predict(texts: pa.Array, meta: pa.Array) -> pa.Array:
        return pa.array(scores(texts, pc.fill_null(meta, 0.0).to_numpy(zero_copy_only=False), model), pa.float64())

    name, predicted = into
    temp = fresh(docs, "_score")
    stays = [c for c in docs.columns if c.lower() not in {x.lower() for x in into}]
    return docs.withColumn(temp, predict(F.col(text), _metadata(docs, text, length))).select(
        *[F.col(f"`{c}`") for c in stays], F.col(temp).alias(name), (F.col(temp) >= 0.5).cast("int").alias(predicted)
    )

"""Language identification: averaged hashed subword embeddings with a linear softmax.

Every 3 and 4 bytes in a row (letters in lower case, other ASCII as a space) are hashed
to a row of an embedding table; a text is the mean of its rows, and a linear softmax
gives its language. Table and softmax are trained together by stochastic gradient
descent in numpy, on a bounded sample. Part of the sample is held back to calibrate:
a temperature makes the score a probability, and the rejection threshold is the score
that all but a stated share of the rightly predicted texts reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnfold.llm.common import LOWER, blocks, bounded_sample, flat, fresh, remainder

UNDETERMINED = "und"
_FOLD = np.where((LOWER < 128) & ~np.isin(LOWER, np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)), 32, LOWER).astype(np.uint8)


@dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the sample; of a text beyond ``train_bytes`` one span of about that length, from a place
    drawn by its hash, is trained on. Training goes over the sample ``epochs`` times, and takes ``updates`` steps, and
    ``updates_each`` per language, at least."""

    per_language: int = 1_000
    train_bytes: int = 200_000
    bits: int = 16
    width: int = 16
    updates: int = 700
    updates_each: int = 60
    epochs: int = 3
    rate: float = 0.5
    batch: int = 32
    calibration: float = 0.2
    reject_share: float = 0.001
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``weights``: for each language and hash bucket, embedding times softmax layer (the last bucket is 0)."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int


def grams(data: np.ndarray, starts: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bucket of the 3 and of the 4 bytes from every byte on; bucket 2**bits where the text ends sooner."""
    folded = np.zeros(len(data) + 3, np.uint32)
    folded[: len(data)] = _FOLD[data]
    n, none = len(data), np.uint32(1 << bits)
    three = folded[:n] | folded[1 : n + 1] << np.uint32(8) | folded[2 : n + 2] << np.uint32(16)
    four = three | folded[3 : n + 3] << np.uint32(24)
    shift = np.uint32(32 - bits)
    out = [(three * np.uint32(0x9E3779B1)) >> shift, ((four ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)) >> shift]
    for size, ids in zip((3, 4), out, strict=True):
        for back in range(1, size):
            last = starts[1:] - back
            ids[last[last >= starts[:-1]]] = none
    return out


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for an empty row."""
    out = np.zeros(len(starts) - 1, np.float64)
    filled = np.flatnonzero(starts[1:] > starts[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(values, starts[filled])
    return out


def logits(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores per text and language before the softmax, and whether the text has any gram."""
    data, starts = flat(texts)
    out = np.tile(model.bias.astype(np.float64), (len(texts), 1))
    some = np.zeros(len(texts), bool)
    for i, j in blocks(starts):
        part, at = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        length = np.diff(at)
        n = np.maximum(length - 2, 0) + np.maximum(length - 3, 0)
        some[i:j] = n > 0
        for ids in grams(part, at, model.bits):
            for k in range(len(model.languages)):
                out[i:j, k] += row_sums(model.weights[k][ids], at) / np.maximum(n, 1)
    return out, some


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sum_by(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by their place among ``n``."""
    return np.stack([np.bincount(place, values[:, f], n) for f in range(values.shape[1])], axis=1).astype(np.float32)


def bags(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different buckets of every text, the share of its grams in each, and where each text begins (one more entry).

    They lie in one array each, and few texts are taken apart at once: the driver gets all of that memory back, which many
    small arrays would leave in pieces.
    """
    room = sum(2 * len(t.encode()) for t in texts)
    buckets, shares, ends = np.empty(room, np.int32), np.empty(room, np.float32), np.zeros(len(texts) + 1, np.int64)
    for k, text in enumerate(texts):
        data, starts = flat(pa.array([text], pa.large_string()))
        both = np.concatenate(grams(data, starts, bits))
        bucket, count = np.unique(both[both < (1 << bits)], return_counts=True)
        ends[k + 1] = ends[k] + len(bucket)
        buckets[ends[k] : ends[k + 1]] = bucket
        shares[ends[k] : ends[k + 1]] = count / max(count.sum(), 1)
    return buckets, shares, ends


def train(texts: list[str], labels: list[str], s: Settings) -> Model:
    """Stochastic gradient descent over mean embeddings; rows come in a fixed order."""
    languages = tuple(sorted(set(labels)))
    y = np.searchsorted(np.array(languages), np.array(labels)) if languages else np.zeros(0, int)
    buckets, shares, ends = bags(texts, s.bits)
    rng = np.random.default_rng(s.seed)
    table = rng.uniform(-1 / s.width, 1 / s.width, (1 << s.bits, s.width)).astype(np.float32)
    layer = np.zeros((s.width, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    order = rng.permutation(len(texts))
    held = order[: int(len(texts) * s.calibration)]
    fit = order[len(held) :]
    step, updates = 0, max(s.updates, s.updates_each * len(languages), s.epochs * -(-len(fit) // s.batch))
    while step < updates and len(fit):
        for some in np.array_split(rng.permutation(fit), -(-len(fit) // s.batch)):
            rate = s.rate * max(1 - step / updates, 0) * s.width
            step += 1
            rows = np.concatenate([buckets[ends[k] : ends[k + 1]] for k in some])
            share = np.concatenate([shares[ends[k] : ends[k + 1]] for k in some])
            owner = np.repeat(np.arange(len(some)), ends[some + 1] - ends[some])
            mean = sum_by(owner, table[rows] * share[:, None], len(some))
            wrong = softmax(mean @ layer + bias)
            wrong[np.arange(len(some)), y[some]] -= 1
            back = (wrong @ layer.T).astype(np.float32)
            layer -= (rate / len(some) * (mean.T @ wrong)).astype(np.float32)
            bias -= (0.1 * rate / len(some) / s.width * wrong.sum(axis=0)).astype(np.float32)
            touched, place = np.unique(rows, return_inverse=True)
            table[touched] -= rate / len(some) * sum_by(place, share[:, None] * back[owner], len(touched))
    weights = np.zeros((len(languages), (1 << s.bits) + 1), np.float32)
    weights[:, :-1] = (table @ layer).T
    model = Model(languages, weights, bias, 1.0, 0.0, s.bits)
    return _calibrated(model, [texts[k] for k in held], y[held], s)


def _calibrated(model: Model, texts: list[str], y: np.ndarray, s: Settings) -> Model:
    if not len(texts) or len(model.languages) < 2:
        return model
    raw = np.concatenate([logits(pa.array([t], pa.large_string()), model)[0] for t in texts])
    grid = np.geomspace(0.02, 8, 60)
    loss = [-np.log(np.maximum(softmax(raw / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    heat = float(grid[int(np.argmin(loss))])
    p = softmax(raw / heat)
    right = p.argmax(axis=1) == y
    threshold = float(np.quantile(p.max(axis=1)[right], s.reject_share)) if right.any() else 0.0
    return Model(model.languages, model.weights, model.bias, heat, min(threshold, 0.5), model.bits)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Learn from rows with a language and a text; the sample is bounded by ``settings``."""
    chars = F.lit(settings.train_bytes // 4)
    begin = F.pmod(F.xxhash64(text), F.greatest(F.char_length(text) - chars, F.lit(1)))
    span = F.when(F.octet_length(text) <= settings.train_bytes, F.col(text)).otherwise(F.substring(text, (begin + 1).cast("int"), chars))
    rows = docs.select(F.col(key).alias("k"), span.alias("t"), F.col(lang).cast("string").alias("l")).filter(
        F.col("l").isNotNull() & F.col("t").isNotNull()
    )
    sample = bounded_sample(rows, "l", settings.per_language, "k", "t").collect()
    sample.sort(key=lambda r: (r.l, r.t, str(r.k)))
    return train([r.t for r in sample], [r.l for r in sample], settings)


def identify(
    docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str, str] = ("lang_pred", "score", "rejected")
) -> DataFrame:
    """``docs`` with language, calibrated probability and whether that is too low to trust.

    NULL texts and texts without a letter are ``und`` with score 0 and rejected; so is every
    text if there was nothing to learn from. All rows and other columns stay; columns already
    called as in ``into`` are replaced.
    """

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        if not model.languages:
            return pa.StructArray.from_arrays(
                [pa.array([None] * len(texts), pa.string()), pa.array([0.0] * len(texts))], ["lang", "score"]
            )
        raw, _ = logits(texts, model)
        p = softmax(raw / model.temperature)
        best = p.argmax(axis=1)
        names = pa.array(model.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(p[np.arange(len(p)), best])], ["lang", "score"])

    found = fresh(docs, "_found")
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    known = F.col(f"{found}.lang").isNotNull() & letters
    lang, score, rejected = into
    stays = [c for c in docs.columns if c.lower() not in {x.lower() for x in into}]
    return docs.withColumn(found, predict(F.col(text))).select(
        *[F.col(f"`{c}`") for c in stays],
        F.when(known, F.col(f"{found}.lang")).otherwise(UNDETERMINED).alias(lang),
        F.when(known, F.col(f"{found}.score")).otherwise(0.0).alias(score),
        (~known | (F.col(f"{found}.score") < model.threshold)).alias(rejected),
    )


def held_out(key: str = "doc_id", mod: int = 4, part: int = 2) -> object:
    """Whether a row is kept from training; rows with a NULL key are neither held out nor trained on."""
    return F.coalesce(remainder(key, mod) == part, F.lit(False))


def trainable(docs: DataFrame, key: str = "doc_id", mod: int = 4, part: int = 2) -> DataFrame:
    return docs.filter(remainder(key, mod) != part)

"""Token counts: batch encoding in Arrow functions that return lengths only.

Every text is cut at boundaries no token can span, before a space that follows a
character other than white space: the byte-level pattern always ends a piece there, and
what it looks at lies behind the cut. The pieces of an Arrow batch are encoded by the library in
calls of even size in bytes, each distinct piece once, and their lengths are added up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# A library call gets about this many bytes; a worker remembers this many piece lengths.
CALL_BYTES = 1 << 18
REMEMBERED = 400_000
_RUN = re.compile(r"\s\s")
_tokenizers: dict[str, tuple] = {}


def pieces(text: str) -> list[str]:
    """Cut before every space that follows a character other than white space.

    A piece without its leading space stands for itself, except the first one, which
    has none. Texts in which white space follows white space are cut by pattern.
    """
    if _RUN.search(text) is None:
        return text.split(" ")
    return re.split(r"(?<=\S) ", text)


def even_calls(texts: list[str], limit: int = CALL_BYTES) -> Iterator[list[str]]:
    """Batches balanced by bytes; a longer text is a call of its own."""
    call, size = [], 0
    for text in texts:
        n = len(text) if text.isascii() else len(text.encode())
        if call and size + n > limit:
            yield call
            call, size = [], 0
        call.append(text)
        size += n
    if call:
        yield call


def _library(path: str) -> tuple:
    """The tokenizer of this worker and the lengths it has found so far (inner pieces)."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _tokenizers[path] = tokenizer, {}
    return _tokenizers[path]


def _encode_lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(e) for call in even_calls(texts) for e in tokenizer.encode_batch_fast(call, add_special_tokens=False)]


def count_batch(texts: list[str | None], path: str, remembered: int = REMEMBERED) -> list[int]:
    tokenizer, known = _library(path)
    counts, group, size = [], [], 0
    for i, text in enumerate(texts):
        group.append(text or "")
        size += len(group[-1])
        if size >= 8 * CALL_BYTES or i == len(texts) - 1:
            cut = [pieces(t) for t in group]
            heads = _encode_lengths(tokenizer, [c[0] for c in cut])
            fresh = set().union(*(c[1:] for c in cut)) - known.keys()
            if len(known) + len(fresh) > remembered:
                known.clear()
                fresh = set().union(*(c[1:] for c in cut))
            fresh = list(fresh)
            known.update(zip(fresh, _encode_lengths(tokenizer, [f" {p}" for p in fresh]), strict=True))
            get = known.__getitem__
            counts += [h + sum(map(get, c[1:])) for h, c in zip(heads, cut, strict=True)]
            group, size = [], 0
    return counts


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text; every row and other column stays.

    NULL and empty texts have 0 tokens. A column already called ``into`` is replaced.
    Special strings inside texts count as the library's default has them.
    ``vocabulary``: path of a ``.json`` file of a byte-level model without prefix space,
    readable on every executor.
    """

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(count_batch(texts.to_pylist(), vocabulary), pa.int64())

    return docs.withColumn(into, count(F.col(text)))

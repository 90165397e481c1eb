"""Secret scans: all rules in one minimal deterministic automaton, one pass over the bytes.

The searching automaton holds the opening of every rule, as much as tells a match from
prose, so that runs of unbounded length do not multiply its states. Where an opening
ends, the opening compiled backward gives the leftmost start, and the whole rule compiled
forward gives the longest end from there; both only run over the few stretches found.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnfold.llm.automaton import Automaton, compile_rules, ignore_case, scan
from tarnfold.llm.common import blocks, flat

SCAN_BYTES = 1 << 22
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
SPANS_TYPE = "array<struct<kind: string, begin: bigint, end: bigint>>"


@dataclass(frozen=True)
class Rule:
    """A match begins with ``opening`` and is as long as ``pattern`` goes.

    It needs ``least`` bytes, counted behind the longest ``head`` if there is one; shorter
    matches are dropped, and what they cover is not searched again.
    """

    kind: str
    opening: str
    pattern: str
    least: int
    head: str | None = None


_HEAD = ignore_case("(password|passwd|secret|token|api_?key)") + "[\"']? *[:=] *[\"']?"
_VALUE = "[A-Za-z0-9+/_.=-]"
BASE = (
    Rule("assign", _HEAD + _VALUE, f"{_HEAD}{_VALUE}+", 6, _HEAD),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{10}", "[0-9a-f]+", 24),
)
RULES = (
    *BASE,
    Rule("private_key", "-----BEGIN ", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
    Rule("forge", "gh[opsur]_", "gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("cloud", "AIza", "AIza[A-Za-z0-9_-]+", 39),
    Rule("payment", "[rs]k_live_", "[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("signed", "eyJ", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 20),
)


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    search: Automaton
    forward: tuple[Automaton, ...]
    backward: tuple[Automaton, ...]
    heads: tuple[Automaton | None, ...]


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    one = lambda pattern, backward=False: compile_rules([pattern], search=False, backward=backward)
    return Scanner(
        rules,
        compile_rules([r.opening for r in rules], search=True),
        tuple(one(r.pattern) for r in rules),
        tuple(one(r.opening, backward=True) for r in rules),
        tuple(one(r.head) if r.head else None for r in rules),
    )


def _matches(text: bytes, openings: list[tuple[int, int]], s: Scanner) -> list[tuple[int, int, int]]:
    """(begin, rule, end) in bytes: leftmost, longest, not overlapping within a rule, long enough."""
    found, free = [], [0] * len(s.rules)
    for end, rule in openings:
        if end <= free[rule]:
            continue
        back = s.backward[rule].ends(text[free[rule] : end][::-1], 0)
        if not back:
            continue
        begin = end - back[-1]
        ahead = s.forward[rule].ends(text[begin:], 0)
        if not ahead:
            continue
        free[rule] = end = begin + ahead[-1]
        head = s.heads[rule].ends(text[begin:end], 0)[-1] if s.heads[rule] else 0
        if end - begin - head >= s.rules[rule].least:
            found.append((begin, rule, end))
    return sorted(found)


def _apart(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The texts with a byte between them that is in no text and no rule."""
    rows = len(starts) - 1
    out = np.full(len(data) + rows, 255, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(starts))] = data
    return out


def find(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """For each text with a match: (begin, rule, end) in code points."""
    s = scanner(rules)
    data, starts = flat(texts)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i, j in blocks(starts, SCAN_BYTES):
        part, at = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        output = s.search.output[scan(s.search, _apart(part, at))]
        here = np.flatnonzero(output)
        ending = output[here]
        row = np.searchsorted(at[1:] + np.arange(1, j - i + 1), here, side="right")
        for r in np.unique(row):
            mine = row == r
            openings = [
                (int(p) + 1 - int(at[r]) - int(r), rule)
                for p, mask in zip(here[mine], ending[mine], strict=True)
                for rule in range(len(s.rules))
                if int(mask) >> rule & 1
            ]
            text = part[at[r] : at[r + 1]]
            spans = _matches(text.tobytes(), openings, s)
            if spans:
                point = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                found[i + int(r)] = [(int(point[a]), rule, int(point[b])) for a, rule, b in spans]
    return found


def secret_spans(docs: DataFrame, text: str = "text", into: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with an array of (kind, begin, end), in code points, ordered by begin and then by rule.

    NULL and empty texts have an empty array. All rows and other columns stay; a column already
    called ``into`` is replaced.
    """

    @F.arrow_udf(SPANS_TYPE)
    def spans(texts: pa.Array) -> pa.Array:
        found = find(texts, rules)
        return pa.array(
            [[{"kind": rules[r].kind, "begin": a, "end": b} for a, r, b in found.get(k, ())] for k in range(len(texts))], SPANS
        )

    return docs.withColumn(into, spans(F.col(text)))


def redacted(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """Every stretch covered by spans becomes ``[kind]``, named after the span that begins it."""
    out, at = [], 0
    for begin, rule, end in spans:
        if begin >= at:
            out += [text[at:begin], f"[{rules[rule].kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by their kind; NULL stays NULL, all rows stay."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        found = find(texts, rules)
        if not found:
            return texts.cast(pa.string())
        out = texts.to_pylist()
        for k, spans in found.items():
            out[k] = redacted(out[k], spans, rules)
        return pa.array(out, pa.string())

    return docs.withColumn(text, clean(F.col(text)))

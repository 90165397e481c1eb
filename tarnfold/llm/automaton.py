"""Regular expressions over bytes compiled to one deterministic automaton in arrays.

The pattern language is what secret rules need: bytes, ``[...]`` classes, ``(a|b)``,
``? * +`` and ``{n}``, ``{n,}``. Rules become one nondeterministic automaton, subset
construction makes it deterministic, and partition refinement makes it minimal. A state's
output is a bit mask of the rules that end there. Texts are scanned in step: each array
operation moves every lane (a stretch of the batch) on by one byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANE_BYTES = 1024


class _Parser:
    """Pattern to nondeterministic fragments (start, end) in a shared list of edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def pattern(self, text: str) -> tuple[int, int]:
        self.text, self.at = text, 0
        out = self._either()
        if self.at != len(text):
            raise ValueError(f"cannot read {text!r} at {self.at}")
        return out

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _either(self) -> tuple[int, int]:
        branches = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            branches.append(self._sequence())
        begin, end = self.state(), self.state()
        for a, b in branches:
            self.empty[begin].append(a)
            self.empty[b].append(end)
        return begin, end

    def _sequence(self) -> tuple[int, int]:
        begin = end = self.state()
        while self._peek() not in ("", "|", ")"):
            from_, atom_at = end, self.at
            parts = [self._atom()]
            low, high = self._count()
            after = self.at
            for _ in range(max(low, 1) - 1 + (high is None and low > 1)):
                self.at = atom_at
                parts.append(self._atom())
            self.at = after
            for k, (x, y) in enumerate(parts):
                self.empty[from_].append(x)
                if high is None and k == len(parts) - 1:
                    self.empty[y].append(x)
                    if low != 1:  # the last copy of {n,} and the body of * may be left out
                        self.empty[from_].append(y)
                if low == 0 and high == 1:
                    self.empty[from_].append(y)
                from_ = y
            end = from_
        return begin, end

    def _count(self) -> tuple[int, int | None]:
        mark = self._peek()
        if mark in ("?", "*", "+"):
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
        if mark == "{":
            stop = self.text.index("}", self.at)
            low = self.text[self.at + 1 : stop]
            self.at = stop + 1
            return (int(low[:-1]), None) if low.endswith(",") else (int(low), int(low))
        return 1, 1

    def _atom(self) -> tuple[int, int]:
        c = self._peek()
        self.at += 1
        if c == "(":
            out = self._either()
            if self._peek() != ")":
                raise ValueError(f"open group in {self.text!r}")
            self.at += 1
            return out
        if c == "[":
            stop = self.text.index("]", self.at + 1)
            allowed = self._class(self.text[self.at : stop])
            self.at = stop + 1
        elif c == "\\":
            allowed = frozenset([ord(self.text[self.at])])
            self.at += 1
        else:
            allowed = frozenset([ord(c)])
        begin, end = self.state(), self.state()
        self.edges[begin].append((allowed, end))
        return begin, end

    @staticmethod
    def _class(body: str) -> frozenset[int]:
        out, i = set(), 0
        while i < len(body):
            if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
                out |= set(range(ord(body[i]), ord(body[i + 2]) + 1))
                i += 3
            else:
                out.add(ord(body[i]))
                i += 1
        return frozenset(out)


@dataclass(frozen=True)
class Automaton:
    """Transition arrays. States are named by their row in ``step``: ``step[state + byte_class[byte]]`` is the next one.

    The first state is 0. ``output[state]``: bit r is set where rule r ends. ``dead``: the
    state from which no rule can end any more, or -1 (a searching automaton has none).
    """

    byte_class: np.ndarray
    step: np.ndarray
    output: np.ndarray
    dead: int

    def ends(self, data: bytes, rule: int) -> list[int]:
        """Lengths at which ``rule`` ends, from the first byte on (a plain loop, for short stretches)."""
        state, out = 0, []
        step, byte_class, output = self.step, self.byte_class, self.output
        for n, b in enumerate(data):
            state = int(step[state + int(byte_class[b])])
            if state == self.dead:
                break
            if int(output[state]) >> rule & 1:
                out.append(n + 1)
        return out


def compile_rules(patterns: list[str], search: bool, backward: bool = False) -> Automaton:
    """All rules in one automaton: ``search`` finds them anywhere, else from the first byte on.

    ``backward`` compiles the reversed languages.
    """
    nfa = _Parser()
    begins, ends = [], []
    for text in patterns:
        a, b = nfa.pattern(text)
        begins.append(a)
        ends.append(b)
    edges, empty = nfa.edges, nfa.empty
    if backward:
        back: list[list[tuple[frozenset[int], int]]] = [[] for _ in edges]
        back_empty: list[list[int]] = [[] for _ in edges]
        for s, out in enumerate(edges):
            for allowed, to in out:
                back[to].append((allowed, s))
        for s, out in enumerate(empty):
            for to in out:
                back_empty[to].append(s)
        edges, empty, begins, ends = back, back_empty, ends, begins
    byte_class, members = _byte_classes(edges)

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(s for s in seen if edges[s] or s in final)

    final = {e: r for r, e in enumerate(ends)}
    first = closure(set(begins))
    number, table, todo = {first: 0}, [], [first]
    while todo:
        now, row = todo.pop(0), []
        for byte in members:
            to = {t for s in now for allowed, t in edges[s] if byte in allowed}
            following = closure(to | set(begins) if search else to)
            if following not in number:
                number[following] = len(number)
                todo.append(following)
            row.append(number[following])
        table.append(row)
    outputs = [sum(1 << final[s] for s in subset if s in final) for subset in number]
    return _minimised(np.array(table, np.int64), np.array(outputs, np.int64), byte_class)


def _byte_classes(edges) -> tuple[np.ndarray, list[int]]:
    """Bytes that no edge tells apart share a class; one member of each class."""
    sets = sorted({tuple(sorted(allowed)) for out in edges for allowed, _ in out})
    signature = [tuple(b in s for s in map(frozenset, sets)) for b in range(256)]
    names: dict[tuple, int] = {}
    byte_class = np.array([names.setdefault(s, len(names)) for s in signature], np.int64)
    return byte_class, [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(names))]


def _minimised(table: np.ndarray, outputs: np.ndarray, byte_class: np.ndarray) -> Automaton:
    """Split states by output, then by the groups they lead to, until nothing splits."""
    group = np.unique(outputs, return_inverse=True)[1].reshape(-1)
    while True:
        rows = np.concatenate([group[:, None], group[table]], axis=1)
        finer = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    order = {int(group[0]): 0}
    for g in group:
        order.setdefault(int(g), len(order))
    renamed = np.array([order[int(g)] for g in group])
    keep = np.zeros(len(order), np.int64)
    keep[renamed[::-1]] = np.arange(len(group))[::-1]
    step = renamed[table[keep]]
    output = outputs[keep]
    loops = (step == np.arange(len(step))[:, None]).all(axis=1) & (output == 0)
    classes = step.shape[1]
    dead = int(np.flatnonzero(loops)[0]) * classes if loops.any() else -1
    by_row = np.zeros(step.size, np.int64)
    by_row[::classes] = output
    return Automaton(byte_class.astype(np.uint8), (step.reshape(-1) * classes).astype(np.int32), by_row, dead)


def ignore_case(pattern: str) -> str:
    """Every plain letter of a literal pattern as a class of both cases."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)


def scan(automaton: Automaton, data: np.ndarray) -> np.ndarray:
    """State after every byte, in one pass over lanes of equal length.

    A lane starts in the first state, as if nothing went before; where the lane before it
    ends elsewhere, it is run again from there until both runs agree, which they then do
    for good. So the states are exact wherever the lanes are cut.
    """
    n, step = len(data), automaton.step
    if not n:
        return np.zeros(0, step.dtype)
    lanes = max(1, n // LANE_BYTES)
    length = -(-n // lanes)
    symbol = np.zeros(lanes * length, np.uint8)
    symbol[:n] = automaton.byte_class[data]
    by_time = np.ascontiguousarray(symbol.reshape(lanes, length).T)
    states = np.empty((length, lanes), step.dtype)
    now = np.zeros(lanes, step.dtype)
    for t in range(length):
        now = np.take(step, now + by_time[t], out=states[t])
    redo = np.flatnonzero(states[-1, :-1]) + 1
    while len(redo):
        now = states[-1, redo - 1]
        for t in range(length):
            now = step[now + by_time[t, redo]]
            differs = now != states[t, redo]
            if not differs.all():
                redo, now = redo[differs], now[differs]
                if not len(redo):
                    break
            states[t, redo] = now
        redo = redo[redo + 1 < lanes] + 1
    return np.ascontiguousarray(states.T).reshape(-1)[:n]

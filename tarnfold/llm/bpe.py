"""BPE encoding and decoding by a tokenization automaton.

States are the tokens, with one more to begin with; an arc into a state emits its token.
At first the automaton holds the single symbols, and any may follow any inside a word.
Then every merge (u, v) -> w, in order of rank, applies its gadget: state w gets the
arcs that enter u (but not from u itself if u = v, as the leftmost pair merges first)
and the arcs that leave v, and the arc from u to v is removed. What is left accepts
every word in exactly one way, the way merging by rank would split it.

Arcs are not copied, which would take a table of tokens by tokens. A state keeps the two
states its arcs came from and the rank at which it was made, so an arc is looked up by
following its copies back; the answers are kept as the transition table fills up.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from tarnfold.llm.common import blocks, flat

# Bytes of chunks between white space, and words in them, of which a worker remembers the tokens; an entry counts with
# its characters, its tokens and ENTRY_BYTES. Longer chunks than LONG characters are not remembered.
REMEMBERED_BYTES, ENTRY_BYTES, LONG = 112 << 20, 170, 64
# Bytes of texts whose chunks are looked up together.
TOGETHER = 1 << 20
# Arcs of which the answer is kept.
ARCS = 600_000
# Keys of a node of the tree of tokens beside its symbols.
INSIDE, AT_END = 0, 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return [out[b] for b in range(256)]


class TokenAutomaton:
    """Deterministic automaton over the tokens of one vocabulary, built merge by merge.

    ``made[t]``: rank of the merge that made state t, -1 for single symbols. States in
    ``unused`` are never entered: their halves could not meet any more when their turn came.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.size = size = max(vocab.values(), default=0) + 1
        self.made = [-1] * size
        self.entered_as, self.left_as = list(range(size)), list(range(size))
        self.removed: dict[int, int] = {}
        self.unused: set[int] = set()
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self.arcs: dict[int, dict[int, bool]] = {}
        self.known_arcs = 0
        # the symbols of all tokens as a tree: under INSIDE and AT_END a node has the tokens on the way to it, shortest
        # first, that can be taken where the word goes on behind it, and where the word ends in it
        self.root: dict = {INSIDE: (), AT_END: ()}
        self.length = [0] * size
        ends_in: list[tuple[dict, bool, int]] = []
        for text, token in vocab.items():
            ends = bool(suffix) and text.endswith(suffix)
            symbols = text[: -len(suffix)] if ends else text
            node = self.root
            for symbol in symbols:
                node = node.setdefault(symbol, {})
            if token not in self.unused:
                self.length[token] = len(symbols)
                ends_in.append((node, ends, token))
        for node, ends, token in ends_in:
            node[AT_END if ends else INSIDE] = token
        todo = [((), node) for symbol, node in self.root.items() if isinstance(symbol, str)]
        while todo:
            before, node = todo.pop()
            inner, final = node.get(INSIDE), node.get(AT_END)
            node[INSIDE] = here = before if inner is None else (*before, inner)
            node[AT_END] = before if final is None else (*before, final)
            todo += [(here, below) for symbol, below in node.items() if isinstance(symbol, str)]

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if u in self.unused or v in self.unused or not self._follows(u, v, rank):
            self.unused.add(w)
        self.made[w] = rank
        self.entered_as[w], self.left_as[w] = u, v
        self.removed.setdefault(u * self.size + v, rank)

    def arc(self, a: int, b: int) -> bool:
        """Whether token b may follow token a once all gadgets are applied; looked up once and kept."""
        if self.known_arcs >= ARCS:
            self.arcs.clear()
            self.known_arcs = 0
        self.known_arcs += 1
        out = self.arcs.setdefault(a, {})[b] = self._follows(a, b, len(self.made))
        return out

    def _follows(self, a: int, b: int, before: int) -> bool:
        """Whether there is an arc from a to b when the gadgets of rank less than ``before`` are applied."""
        made = self.made
        while True:
            gone = self.removed.get(a * self.size + b)
            if gone is not None and gone < before:
                return False
            i, j = made[a], made[b]
            if i < 0 and j < 0:
                return True
            if i > j:  # a took its leaving arcs from its second half, as they were then
                before, a = i, self.left_as[a]
                continue
            u, v = self.entered_as[b], self.left_as[b]
            if i < j:  # b took its entering arcs from its first half, as they were then
                if a == u == v:
                    return False
                before, b = j, u
            else:  # one token twice
                before, a, b = i, v, u

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one pre-split word of byte symbols: the only path through the automaton.

        The longest token that may follow is taken first. The path up to any place is the only
        one, so a place with no way on is given up for good, and the walk is linear in the word.
        """
        root, length, arcs, n = self.root, self.length, self.arcs, len(word)
        tokens: list[int] = []
        begins: list[int] = []
        ways: list[tuple[tuple[int, ...], int]] = []
        shut: set[int] = set()
        at, row = 0, None
        while True:
            node = root
            for symbol in word[at:] if at else word:
                below = node.get(symbol)
                if below is None:
                    ahead = node[INSIDE]
                    break
                node = below
            else:  # at the end of the word, tokens that end one
                ahead = node[AT_END]
            left = len(ahead)
            while True:
                while left:
                    left -= 1
                    token = ahead[left]
                    if shut and at + length[token] in shut:
                        continue
                    if not tokens:
                        break
                    follows = None if row is None else row.get(token)
                    if follows is None:
                        follows = self.arc(tokens[-1], token)
                    if follows:
                        break
                else:
                    if not tokens:
                        raise ValueError(f"no path for {word!r}")
                    shut.add(at)
                    tokens.pop()
                    at, (ahead, left) = begins.pop(), ways.pop()
                    row = arcs.get(tokens[-1]) if tokens else None
                    continue
                break
            tokens.append(token)
            end = at + length[token]
            if end == n:
                return tokens
            begins.append(at)
            ways.append((ahead, left))
            at, row = end, arcs.get(token)


_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")
_GAP = regex.compile(f"[{_SPACES}]+")
_ODD = regex.compile("[\x1c-\x1f]")


class WordTokenizer:
    """A lower-casing word-level BPE vocabulary read from a ``.json`` file, in automaton form."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.names = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for text, token in (model["vocab"] | self.special).items():
            self.names[token] = text
        self.symbols = byte_symbols()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def remember(self, text: str, tokens: bytes) -> None:
        """Keep the tokens of a chunk or word; what was not met lately is forgotten first."""
        if len(text) > LONG:
            return
        if self.held >= REMEMBERED_BYTES // 2:
            self.known, self.old, self.held = {}, self.known, 0
        self.known[text] = tokens
        self.held += ENTRY_BYTES + len(text) + len(tokens)

    def chunk_tokens(self, chunk: str) -> bytes:
        """Token ids (four bytes each) of a chunk without white space, special strings included."""
        if "<|" not in chunk:
            return self.part_tokens(chunk)
        parts = self.split.split(chunk)
        return b"".join([array("i", [self.special[p]]).tobytes() if p in self.special else self.part_tokens(p) for p in parts])

    def part_tokens(self, part: str) -> bytes:
        if not part.isascii():
            # letter by letter, so that a last sigma is not a special case
            part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")
        part = part.lower()
        if part.isalpha():
            return self.word_tokens(part)
        if part[:-1].isalpha() and part[-1] in ".,":
            return self.word_tokens(part[:-1]) + self.word_tokens(part[-1])
        return b"".join(map(self.word_tokens, _WORD.findall(part)))

    def word_tokens(self, word: str) -> bytes:
        # plain words have the same tokens as the chunk that is just the word, so both are kept in one place
        plain = word.isascii()
        tokens = self.known.get(word) if plain else None
        if tokens is None:
            tokens = self.old.get(word) if plain else None
            if tokens is None:
                symbols = word if plain and word.isprintable() else "".join([self.symbols[b] for b in word.encode()])
                tokens = array("i", self.automaton.encode_word(symbols)).tobytes()
            if plain:
                self.remember(word, tokens)
        return tokens

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and how many each text has.

        The chunks of all texts are numbered first, so that each different one is looked up once.
        """
        split = [_GAP.split(t) if _ODD.search(t) else t.split() for t in texts]
        coded = pa.array([c for chunks in split for c in chunks], pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        each = []
        for chunk in coded.dictionary.to_pylist():
            tokens = self.known.get(chunk)
            if tokens is None:
                tokens = self.old.get(chunk)
                if tokens is None:
                    tokens = self.chunk_tokens(chunk)
                if chunk not in self.known:
                    self.remember(chunk, tokens)
            each.append(tokens)
        sizes = np.array([len(t) // 4 for t in each], np.int64)
        ids, begins = np.frombuffer(b"".join(each), np.int32), np.cumsum(sizes) - sizes
        length = sizes[codes] if len(codes) else np.zeros(0, np.int64)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
        total = int(upto[-1])
        out = ids[np.arange(total) + np.repeat((begins[codes] if len(codes) else length) - upto[:-1], length)]
        ends = np.cumsum([len(chunks) for chunks in split])
        return out, np.diff(np.concatenate([[0], upto[ends]]))


_loaded: dict[str, WordTokenizer] = {}
# The texts that a vocabulary encoded last, with their ids, until they are asked for again or others come.
_last: dict[str, tuple[pa.Array, pa.ListArray]] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def token_ids(texts: pa.Array, vocabulary: str) -> pa.ListArray:
    """Token ids of each text; NULL and empty texts have none.

    Where both the ids and what ``decode`` makes of them are used, Spark chains the two and asks for the ids of a batch
    twice in a row, so they are kept for one more call.
    """
    before = _last.pop(vocabulary, None)
    if before is not None and before[0].equals(texts):
        return before[1]
    del before
    model, parts, lengths = tokenizer(vocabulary), [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    _, starts = flat(texts)
    for i, j in blocks(starts, TOGETHER):
        found, n = model.encode([t or "" for t in texts.slice(i, j - i).to_pylist()])
        parts.append(found)
        lengths.append(n)
    offsets = np.cumsum(np.concatenate(lengths)).astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
    _last[vocabulary] = texts, out
    return out


def encode(docs: DataFrame, vocabulary: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text, no special tokens added.

    NULL and empty texts have an empty array. All rows and other columns stay; a column already
    called ``into`` is replaced. ``vocabulary``: path of a ``.json`` file with word ends,
    readable on every executor.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return token_ids(texts, vocabulary)

    return docs.withColumn(into, ids(F.col(text)))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the labels of the arcs that ``ids`` take, one space between them.

    NULL gives an empty text; ids that the vocabulary does not have, and NULL ids, are left out.
    """

    @F.arrow_udf("string")
    def labels(arrays: pa.Array) -> pa.Array:
        names = pa.array(tokenizer(vocabulary).names, pa.large_string())
        # null arrays have no values, whatever lies behind them
        tokens, lengths = arrays.flatten(), pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        known = pc.fill_null(pc.and_(pc.greater_equal(tokens, 0), pc.less(tokens, len(names))), False)
        ends = np.cumsum(lengths)
        if not pc.all(known, min_count=0).as_py():
            kept = np.concatenate([[0], np.cumsum(known.to_numpy(zero_copy_only=False))])
            tokens, ends = tokens.filter(known), kept[ends]
        parts = pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), names.take(tokens))
        return pc.binary_join(parts, pa.scalar(" ", pa.large_string())).cast(pa.string())

    return docs.withColumn(into, labels(F.col(ids)))

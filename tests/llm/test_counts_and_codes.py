"""Token counts, BPE, secret scans and fingerprints against the libraries and brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from support import ODD_TEXTS, SMALL, empty_documents, odd_documents
from tarnfold.llm import automaton, bpe, secrets, syncmers, token_counts
from tarnfold.llm.common import vocabulary
from tarnfold.llm.queries import QUERIES

PARTS = [" ", "  ", "\n", "\t", "'s", "'LL", "aaa", "The", "É", "é", "1", "23", "!!", "<|endoftext|>", "<|startoftext|>", "日本", " ",
         "　", "_", "\x1c", "\x85", "Σ", "aa", "ΑΣ", "İ", "é", "hahaha", "...", "😀", "lo", "ing"]


def random_texts(n=2_000, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["ha" * 3000, "a" * 1001]


def given(spark):
    return [t or "" for t in (r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())]


def test_counts_are_the_library_s(spark):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = random_texts() + given(spark) + ODD_TEXTS
    expected = [len(e) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert token_counts.count_batch(texts, path) == expected
    assert token_counts.count_batch(texts, path, remembered=50) == expected


def test_columns_of_the_count_and_secret_queries(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    counts = {r.doc_id: r for r in QUERIES["op2_token_counts"](spark, SMALL).collect()}
    scans = {r.doc_id: r for r in QUERIES["op5_secret_scans"](spark, SMALL).collect()}
    assert len(counts) == len(scans) == len(rows)
    for r in rows:
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        one = counts[r.doc_id]
        assert (one.n_bytes, one.n_tokens, one.over_limit) == (len(text.encode()), n, n > 1024)
        base, scan = base_spans(text), scans[r.doc_id]
        assert [scan.n_assign, scan.n_access, scan.n_hex] == [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert scan.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [x for x in scan.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")] == listed


def test_words_are_forgotten_within_the_bound(monkeypatch):
    """Many different words, long ones included: what is kept stays within the bytes given for it."""
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 1 << 17)
    path = vocabulary("word_bpe_49k.json")
    model, library = bpe.WordTokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(8)
    for _ in range(6):
        texts = [" ".join("".join(rng.choice("abcdeiou一二三四") for _ in range(rng.randint(1, 9))) for _ in range(200)) + " " + "z" * 500 for _ in range(5)]
        ids, n = model.encode(texts)
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == expected
        kept = [*model.known.items(), *model.old.items()]
        assert sum(bpe.ENTRY_BYTES + len(k) + len(v) for k, v in kept) <= (1 << 17) + 1000 and "z" * 500 not in dict(kept)


def test_calls_are_even():
    calls = list(token_counts.even_calls(["x" * n for n in (10, 90, 20, 300, 5)], 100))
    assert [sum(map(len, c)) for c in calls] == [100, 20, 300, 5]


def test_odd_rows_are_counted(spark):
    out = token_counts.token_counts(odd_documents(spark), vocabulary("byte_bpe_50k.json"))
    rows = out.collect()
    assert len(rows) == len(ODD_TEXTS) + 2 and out.columns == odd_documents(spark).columns
    assert all(r.n_tokens == 0 for r in rows if not r.text)
    assert token_counts.token_counts(empty_documents(spark), vocabulary("byte_bpe_50k.json")).count() == 0


def test_automaton_splits_as_merging_does(spark):
    path = vocabulary("word_bpe_49k.json")
    library, model = Tokenizer.from_file(path), bpe.WordTokenizer(path)
    rng = random.Random(1)
    texts = random_texts() + given(spark) + [t or "" for t in ODD_TEXTS]
    texts += ["".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 25))) for _ in range(3_000)]
    for text, code in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = model.encode([text])[0].tolist()
        assert ids == code.ids, text[:80]
        assert " ".join(model.names[i] for i in ids) == library.decode(ids, skip_special_tokens=False)


def test_gadgets_on_a_small_vocabulary():
    """All words over two letters, with merges of equal halves among the rules."""
    merges = [("a", "a"), ("aa", "b</w>"), ("a", "b"), ("aa", "aa"), ("b", "ab"), ("ab", "ab")]
    tokens = ["a", "b", "a</w>", "b</w>"] + [u + v for u, v in merges]
    model = bpe.TokenAutomaton({t: i for i, t in enumerate(tokens)}, merges, "</w>")
    rank = {m: r for r, m in enumerate(merges)}

    def merged(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            known = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
            if not known:
                return parts
            _, k = min(known)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    for n in range(1, 11):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> k & 1] for k in range(n))
            assert [tokens[t] for t in model.encode_word(word)] == merged(word), word


def test_bpe_query_and_odd_rows(spark):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op8_bpe"](spark, SMALL).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    out = bpe.decode(bpe.encode(odd_documents(spark), path), path)
    assert all(r.ids == [] and r.decoded == "" for r in out.filter("coalesce(trim(text), '') = ''").collect())
    assert bpe.encode(empty_documents(spark), path).count() == 0
    strange = spark.createDataFrame([(None,), ([5, None, 10**9, -1],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(strange, path).collect()] == ["", library.id_to_token(5)]


def test_bpe_encodes_a_batch_once_for_ids_and_decoded_text(monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    calls, plain = [], bpe.WordTokenizer.encode
    monkeypatch.setattr(bpe.WordTokenizer, "encode", lambda model, texts: calls.append(len(texts)) or plain(model, texts))
    batches = [["Hello, world", "", None, "gr\u00f6\u00dfer"], ["one two", "Hello, world", None, ""], ["one two"]]
    for texts in batches:
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        for _ in range(2):  # as Spark asks in a plan that uses the ids and decodes them
            assert bpe.token_ids(pa.array(texts, pa.string()), path).to_pylist() == want
    assert calls == [4, 4, 1]


_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


SECRET_PARTS = ["token", "secret", "PassWord", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABC123", "abcdef0123456789", "x", "é", "\n",
                "-----BEGIN RSA PRIVATE KEY-----", "00ff", "a" * 30, "AKIA" + "Z" * 17, "eyJhb.eyJab.sig", "ghp_" + "a1" * 20, "-", "."]


@pytest.mark.parametrize("lane", [16, 1024])
def test_secrets_are_those_of_the_rules(spark, monkeypatch, lane):
    monkeypatch.setattr(automaton, "LANE_BYTES", lane)
    rng = random.Random(3)
    texts = ["".join(rng.choice(SECRET_PARTS) for _ in range(rng.randint(0, 40))) for _ in range(3_000)]
    texts += ["f" * 100_000, "token=" + "q" * 5_000, "", None, *given(spark)]
    found = secrets.find(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        got = [(secrets.RULES[r].kind, a, b) for a, r, b in found.get(k, []) if r < 3]
        assert got == base_spans(text or ""), text


def test_added_rules_and_redaction(spark):
    text = "é -----BEGIN EC PRIVATE KEY----- and ghp_" + "Zq" * 20 + " and token = 'abcdef' end"
    (spans,) = secrets.find(pa.array([text])).values()
    assert [(secrets.RULES[r].kind, text[a:b]) for a, r, b in spans] == [
        ("private_key", "-----BEGIN EC PRIVATE KEY-----"), ("forge", "ghp_" + "Zq" * 20), ("assign", "token = 'abcdef")]
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "clean")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert got == {1: "é [private_key] and [forge] and [assign]' end", 2: None, 3: "", 4: "clean"}
    assert secrets.secret_spans(odd_documents(spark)).filter(F.size("spans") > 0).count() == 0
    assert secrets.redact(empty_documents(spark)).count() == 0


def test_minimal_automaton_is_small_and_exact():
    one = automaton.compile_rules(["ab+", "b{2,}", "(a|c)?b"], search=False)
    for text in ("ab", "abb", "bb", "b", "cb", "cbb", "bbb", "a", "ba"):
        for rule, pattern in enumerate(("ab+", "b{2,}", "(a|c)?b")):
            ends = [n for n in range(1, len(text) + 1) if re.fullmatch(pattern, text[:n])]
            assert one.ends(text.encode(), rule) == ends


def test_fingerprints_against_brute_force(spark):
    rows = sorted([(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()], reverse=True)
    got = {r.doc_id: r for r in QUERIES["op9_fingerprints"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for k, (key, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, follow = (brute_fingerprint(t) for t in (text, edited, after))
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == own.tobytes().hex() and r.edited_fingerprint == other.tobytes().hex()
        assert r.near_edited == syncmers.alike(own, other) and r.near_next == syncmers.alike(own, follow)


def brute_fingerprint(text):
    """Every k-mer by itself: an anchor if its least s-mer is the first or the last one."""
    raw = text.encode()
    value = lambda s: int(syncmers.mix(np.array([int.from_bytes(s, "little")], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0])
    first = {}
    known = [value(raw[i : i + 8]) for i in range(len(raw) - 7)]
    for i in range(len(raw) - 15):
        inner = known[i : i + 9]
        if min(inner) in (inner[0], inner[-1]):
            h = int(syncmers.mix(np.array([(inner[0] * 3 + inner[-1]) & (1 << 64) - 1], np.uint64))[0]) >> 32
            first.setdefault(h, i)
    if not first and raw:
        first = {int.from_bytes(hashlib.sha256(raw).digest()[:4], "big"): 0}
    return np.array(sorted(first.items())[: syncmers.KEPT], dtype=[("hash", ">u4"), ("place", ">u4")])


def test_long_texts_match_in_a_short_passage(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = words(60)
    texts = [f"{words(2_500)} {passage} {words(2_500)}", f"{words(4_000)} {passage} {words(1_000)}", words(5_000), None, ""]
    a, b, other = (brute_fingerprint(t) for t in texts[:3])
    shared = len(np.intersect1d(a["hash"], b["hash"]))
    assert shared > 40 and syncmers.alike(a, b) == shared / (len(a) + len(b) - shared) and syncmers.alike(a, other) < 1e-3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(docs).collect()}
    assert got[0] == a.tobytes().hex() and got[3] == got[4] == ""
    rows = syncmers.occurrences(docs).collect()
    at = {(r.doc_id, r.hash): r.place for r in rows}
    both = [(r.place, at[1, r.hash]) for r in rows if r.doc_id == 0 and (1, r.hash) in at]
    assert len(both) >= 40 and {texts[0][x : x + 16] == texts[1][y : y + 16] for x, y in both} == {True}


def test_fingerprints_of_odd_rows(spark):
    out = {(r.doc_id, r.text): r.fingerprint for r in syncmers.fingerprints(odd_documents(spark)).collect()}
    assert all((f == "") == (not t) for (_, t), f in out.items())
    pairs = spark.createDataFrame([("", ""), ("", None), ("0000000100000000", "0000000100000005"), ("0000000100000000", "")], "a string, b string")
    assert [r.likeness for r in syncmers.likeness(pairs, "a", "b").collect()] == [1.0, 1.0, 1.0, 0.0]
    odd = syncmers.edited_and_next(odd_documents(spark))
    assert odd.count() == len(ODD_TEXTS) + 2
    assert syncmers.edited_and_next(empty_documents(spark)).count() == 0
    single = syncmers.edited_and_next(spark.createDataFrame([(4, "abcdef")], "doc_id bigint, text string")).first()
    assert single.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and single.near_next == 1.0

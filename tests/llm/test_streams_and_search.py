"""Exact streaming deduplication, the prefix trie and ranked search against brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F
from support import MEDIUM, ODD_TEXTS, SMALL, empty_documents, odd_documents

from tarnfold.llm import lexical, prefix_trie, stream_dedup
from tarnfold.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def _exact(rows):
    """(key, keep, size, kept, digest) of every (key, text); of rows with one key and text one stays."""
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[(text or "").translate(LOWER)].append(key)
    out = []
    for norm, keys in groups.items():
        order = sorted(keys, key=lambda k: (k is not None, k or 0))
        for n, key in enumerate(order):
            out.append((key, order[-1], len(keys), n == len(keys) - 1, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_exact_dedup_of_odd_rows_in_several_batches(spark, tmp_path):
    source = str(tmp_path / "docs")
    odd_documents(spark).repartition(5, "text").write.parquet(source)
    state = stream_dedup.state_folder(spark)
    stream_dedup.absorb(spark, source, state, batch_bytes=1)  # a file at a time
    found = stream_dedup.resolve(spark, source, state, part_rows=2)
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    assert _sorted(found.collect()) == _sorted(_exact(rows))
    # files that come later meet the state that is there; copies of earlier texts take their place
    added = [(1000 + n, (t or "").upper()) for n, t in enumerate(ODD_TEXTS[:9])]
    spark.createDataFrame(added, "doc_id bigint, text string").write.mode("append").parquet(source)
    stream_dedup.absorb(spark, source, state)
    assert _sorted(stream_dedup.resolve(spark, source, state).collect()) == _sorted(_exact(rows + added))
    stream_dedup.absorb(spark, source, state)  # nothing new
    assert stream_dedup.retained(spark, state).agg(F.sum("rows")).first()[0] == len(rows + added)


def test_exact_dedup_when_digests_clash(spark, tmp_path):
    source = str(tmp_path / "docs")
    rows = [(k, f"Text {k % 40}") for k in range(200)]
    spark.createDataFrame(rows, "doc_id int, text string").repartition(3).write.parquet(source)
    state = stream_dedup.state_folder(spark)
    weak = lambda text: F.unhex(F.hex(F.pmod(F.crc32(text), F.lit(11))))
    stream_dedup.absorb(spark, source, state, digest=weak)
    assert stream_dedup.retained(spark, state).count() <= 11
    found = stream_dedup.resolve(spark, source, state, digest=weak, part_rows=3)
    assert _sorted(found.collect()) == _sorted(_exact(rows))


def test_exact_dedup_of_empty_table_and_of_one_file(spark, tmp_path):
    source = str(tmp_path / "none")
    empty_documents(spark).write.parquet(source)
    assert stream_dedup.deduplicate(spark, source).collect() == []
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert _sorted(QUERIES["op13_exact_dedup"](spark, SMALL).collect()) == _sorted(_exact(rows))


def test_exact_dedup_plans_have_no_python(spark):
    plan = QUERIES["op13_exact_dedup"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _ranked(docs, items, k=10):
    held = [(key, collections.Counter(_terms(text))) for key, text in docs]
    texts = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, query in items:
        scores = []
        for key, c in held:
            n = sum(c.values())
            score = 0
            for t in _terms(query):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * n * texts // total)))
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], start=1)]
    return out


def test_ranked_search_equals_all_scores(spark):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(60)] + ["ÄÖ", "日本語", "Zig", "zag9"]
    weights = [1 / (n + 1) for n in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 80)))) for k in range(600)]
    docs += [(1000 + k, docs[7][1]) for k in range(40)] + [(7, docs[7][1]), (None, docs[7][1])] + list(zip(range(2000, 2100), ODD_TEXTS))
    items = [(k, "-".join(rng.choices(words, k=rng.randint(1, 25)))) for k in range(30)]
    items += [(30, docs[7][1]), (31, None), (32, "absent words"), (32, "w0"), (None, "W0 w0 w0 zig"), (33, "word5 word6 same text")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"score": F.lit("x"), "rank": F.lit(0)}).repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    expected = _sorted(_ranked(docs, items))
    for settings in (lexical.Settings(), lexical.Settings(block_bytes=800, shard_bytes=1 << 12)):
        found = lexical.search(d, i, settings).select("item_id", "rank", "doc_id", "score")
        assert _sorted(found.collect()) == expected


def test_ranked_search_without_rows(spark):
    docs, items = odd_documents(spark), spark.createDataFrame([(1, "same text")], "item_id int, text string")
    assert lexical.search(empty_documents(spark), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs, items).select("item_id", "doc_id").count() == len(_ranked([(0, t) for t in ODD_TEXTS], [(1, "same text")]))


def test_ranked_search_stops_making_accumulators():
    row, term, n = [], [], 500
    for r in range(n):
        row += [r, r]
        term += [0, 1 if r % 50 else 2]
    shard = lexical.Shard(*(__import__("numpy").array(x) for x in (row, term)), lengths=__import__("numpy").full(n, 2), n_terms=3, texts=n, total=2 * n, share=75)
    found, scores = shard.search([(2, 5000), (1, 20), (0, 1)], 10, 0)
    assert sorted(found) == list(range(0, n, 50)) and len(set(scores)) == 1


def _trie(turns, family=5, heads=9):
    """The contract's nodes from rebuilt texts."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in told:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(math.fmod(c, family))
        whole = told.get(base, [])[:h] + told[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    return [
        (
            min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, who in members.items()
    ]


_TURNS = "conv_id bigint, turn bigint, role string, text string"


def _talks(seed=9):
    rng = random.Random(seed)
    turns = []
    for conv in [*range(-7, 90), 5000, 5003, 9001]:
        words = ["hi", "ok", "", None, "é" * 3, "a longer turn"]
        for n in range(rng.choice([0, 1, 2, 5, 9, 14])):
            turns.append((conv, n, rng.choice(["user", "assistant", None]) if n else "user", "hello" if n == 0 else rng.choice(words)))
    for conv in range(200, 260):  # copies of one conversation
        turns += [(conv, n, "user", f"turn {n}") for n in range(12)]
    for conv in (300, 301, 302):  # long, with equal and missing numbers
        turns += [(conv, n, "user", f"t{n % 7}") for n in range(700)]
    turns += [(400, None, "user", "no number"), (400, 3, "x", "same"), (400, 3, "x", "same"), (None, 1, "user", "nobody")]
    rng.shuffle(turns)
    return turns


def test_prefix_trie_equals_rebuilt_texts(spark):
    turns = _talks()
    df = spark.createDataFrame(turns, _TURNS).withColumns({"depth": F.lit(1), "part": F.lit("x"), "h": F.lit(0)})
    expected = _sorted(_trie(turns))
    assert _sorted(prefix_trie.prefix_trie(df).collect()) == expected
    # a prime too small for so many prefixes: groups fail their check and all is done again
    assert _sorted(prefix_trie.prefix_trie(df, prefix_trie.Settings(prime=5)).collect()) == expected


def test_prefix_trie_when_partitions_cut_conversations(spark, monkeypatch):
    turns = [(c, n, "user", f"t{n % 5}") for c in (10, 11, 13) for n in range(900)]
    monkeypatch.setattr(prefix_trie, "PART_ROWS", 64)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 2)
    monkeypatch.setattr(prefix_trie, "tasks", lambda _: 29)
    found = prefix_trie.prefix_trie(spark.createDataFrame(turns, _TURNS).repartition(40))
    assert _sorted(found.collect()) == _sorted(_trie(turns))


def test_prefix_trie_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([], _TURNS)
    assert prefix_trie.prefix_trie(none).collect() == []
    for turns in ([(2, 1, None, None)], [(5, 1, "user", "a"), (5, 1, "user", "a")], [(None, 1, "user", "a")]):
        assert _sorted(prefix_trie.prefix_trie(spark.createDataFrame(turns, _TURNS)).collect()) == _sorted(_trie(turns))


def test_prefix_trie_query_equals_rebuilt_texts(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _sorted(QUERIES["op11_prefix_trie"](spark, MEDIUM).collect()) == _sorted(_trie(turns))

"""Near-duplicates, leaks, personal data, chats, classifiers and the pipeline against brute force."""

import datetime
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, duck
from support import MEDIUM, ODD_TEXTS, SMALL, copies, empty_documents, exact_components, odd_documents
from tarnfold.llm import chat, components, decontaminate, language_id, near_dedup, pii, quality
from tarnfold.llm.queries import ORACLES, QUERIES


def found_components(df):
    return sorted(((r[0], r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("settings", [near_dedup.Settings(), near_dedup.Settings(reach=3, links=1)])
def test_crowds_copies_and_passages(spark, settings):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = near_dedup.near_duplicates(docs, words=4, settings=settings)
    assert found_components(out) == sorted(exact_components(rows, 4), key=str)
    assert out.filter("kept <> (doc_id = component_id)").count() == 0


def test_near_duplicates_far_apart_in_a_crowded_region(spark):
    """More texts share a template than the second search looks ahead; pairs of them share a little more."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(170)]
    rows = []
    for k in range(300):
        own = [word() for _ in range(34)]
        rows.append((2 * k, " ".join(template + own)))
        if k < 40:  # 16 of 34 words of its own
            rows.append((2 * k + 1, " ".join(template + own[:16] + [word() for _ in range(18)])))
    rows += [(1001, " ".join(template)), (1003, " ".join(template + [word() for _ in range(4)]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    settings = near_dedup.Settings(reach=3, links=1, far=8, usual=16)
    for some in (rows, [r for r in rows if r[0] < 1000]):  # the template by itself is near them all
        out = near_dedup.near_duplicates(spark.createDataFrame(some, "doc_id bigint, text string"), words=4, settings=settings)
        expected = exact_components(some, 4)
        assert found_components(out) == sorted(expected, key=str)
    assert len({c for _, _, c in expected}) > 200


def test_a_crowd_on_frequent_shingles_makes_no_square_of_pairs(spark, monkeypatch):
    """Texts that differ in two words of a passage, in the same places as others do: nothing but frequent shingles."""
    rng = random.Random(12)
    passage = [f"w{k}" for k in range(100)]
    rows = []
    for k, (i, j) in enumerate(rng.sample([(i, j) for i in range(100) for j in range(i)], 500)):
        rows.append((k, " ".join("other" if at in (i, j) else w for at, w in enumerate(passage))))
    made, stored = [], near_dedup.stored

    def counted(df):
        out = stored(df)
        if out.columns[:2] == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    settings = near_dedup.Settings(reach=3, links=1, far=8, usual=4, block=64)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=4, settings=settings)
    assert found_components(out) == sorted(exact_components(rows, 4), key=str)
    assert max(made) < 25 * len(rows)


@pytest.mark.parametrize("width", [7, 1 << 13])
def test_blocks_join_what_is_near(spark, width, monkeypatch):
    """Rows of many sizes, in blocks of a few; some are of one root already."""
    monkeypatch.setattr(near_dedup._near, "__defaults__", (width,))
    rng, rows = random.Random(3), []
    for k in range(160):
        n = 10 + k // 8
        own = sorted(rng.sample(range(26 * (k % 2), 26 * (k % 2) + n + 2), n - k % 3))
        rows.append((k, n, own, own, k if k % 5 else 5))
    near = lambda a, b: 100 * len(set(a[2]) & set(b[2])) >= 80 * (a[1] + b[1] - len(set(a[2]) & set(b[2])))
    known = [(r[0], -r[4]) for r in rows]
    df = spark.createDataFrame(rows, "node bigint, n bigint, own array<bigint>, head array<bigint>, root bigint")
    links = [tuple(r) for r in near_dedup._by_blocks(df, 80, 16).collect()]
    assert all(near(rows[a], rows[b]) for a, b in links)
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b)]
    roots = lambda edges: {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert roots(links + known) == roots(pairs + known)
    assert 0 < len(links) < len(pairs)


def test_many_partitions_see_the_same_neighbours(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_partitions", lambda spark, rows, reach: 9)
    rows = copies(seed=8)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_components(near_dedup.near_duplicates(docs, words=5)) == sorted(exact_components(rows, 5), key=str)


def test_more_partitions_than_the_window_has_rows(spark, monkeypatch):
    """Rows on both sides of a partition that is smaller than the window still meet, in a later search."""
    monkeypatch.setattr(near_dedup, "_partitions", lambda spark, rows, reach: 211)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(160)]
    rows = copies(seed=4)[:250]
    for k in range(250):
        own = [word() for _ in range(34)]
        rows.append((1000 + 2 * k, " ".join(template + own)))
        if k < 40:
            rows.append((1001 + 2 * k, " ".join(template + own[:17] + [word() for _ in range(17)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_components(near_dedup.near_duplicates(docs, words=4)) == sorted(exact_components(rows, 4), key=str)


def test_a_long_run_of_copies_is_searched_once(spark):
    """Versions of one text: the first search names neighbours in the order, not all that lie within reach."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base[:at] + [f"own{k}"] + base[at:]) for k, at in enumerate(rng.choices(range(200), k=400))]
    sets = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "node bigint, t string")
    sketch = F.arrow_udf(lambda t: near_dedup.sketches(t, 4), "struct<n: bigint, h1: bigint, h2: bigint, signature: binary>")
    alone = sets.select("node", sketch("t").alias("s")).select("node", "s.n", "s.signature", F.col("node").alias("root"), F.lit(None).cast("binary").alias("bits"))
    found = near_dedup.neighbours(near_dedup.forest_rows(alone), near_dedup.Settings(), 80, False, 4)
    # one for each row and order, and some more beside the ends of runs and partitions
    assert found.filter("not cut").count() < 2 * near_dedup.TREES * len(texts)
    assert found.filter("cut").select("a").distinct().count() == len(texts)
    out = near_dedup.near_duplicates(sets, text="t", key="node", words=4)
    assert {r.component_id for r in out.collect()} == {0}


def test_bits_estimate_similarity():
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    sets = [np.concatenate([shared, a]), np.concatenate([shared, b])]
    x, y = near_dedup.bit_signatures(np.concatenate(sets), np.array([0, 900]))
    differ = np.unpackbits(x ^ y).sum()
    assert abs(1 - 2 * differ / near_dedup.BITS - 0.8) < 0.06


def test_near_duplicates_of_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    assert found_components(QUERIES["op3_near_dedup"](spark, MEDIUM)) == sorted(exact_components(rows, 4), key=str)


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_components(near_dedup.near_duplicates(docs)) == sorted(exact_components(rows, 5), key=str)
    left = near_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert left.filter("text like 'same%'").count() == 1 and left.filter("text is null").count() == 2
    assert near_dedup.near_duplicates(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("small", [0, components.SMALL])
def test_components_of_chains_and_stars(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (500, 400), (400, 500)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 40)) and got[500] == 400


def test_leaks_against_all_windows(spark):
    """Every document against every item by exact distance."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()][:80]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    fold = lambda t: decontaminate._FOLD[np.frombuffer(t.encode(), np.uint8)].tobytes()
    expected = set()
    for key, text in docs:
        for item, phrase in items:
            distance, _ = decontaminate.best_match(fold(phrase), fold(text))
            if distance <= int(0.3 * len(phrase.encode())):
                expected.add((key, item, distance))
    got = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == expected


def test_edited_passages_are_found(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshrdlé") for _ in range(rng.randint(2, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 60)))) for k in range(60)] + [(99, "short one"), (98, None), (97, ""), (None, "x " * 50)]
    docs, planted = [], set()
    for k in range(400):
        text = " ".join(word() for _ in range(rng.randint(5, 400)))
        if k % 2:
            item, phrase = rng.choice(items[:60])
            words = [word() if rng.random() < 0.1 else w for w in phrase.split()]
            text = f"{text}\n{' '.join(words).upper() if k % 4 == 1 and phrase.isascii() else ' '.join(words)}\t{text}"
            planted.add((k, item))
        docs.append((k, text))
    docs += [(1000, "a Short  one? a SHORT\tone."), (1001, None), (1002, "")]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 6_000)  # several blocks of items
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = decontaminate.contaminations(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted | {(1000, 99)}
    texts = dict(docs)
    assert all(texts[r.doc_id][r.begin : r.end].lower().split()[:1] for r in got)
    clean = decontaminate.decontaminate(table, spark.createDataFrame(items, "item_id bigint, text string"))
    assert clean.count() == len(docs) - len({r.doc_id for r in got})
    assert decontaminate.contaminations(table, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_leaks_of_odd_rows(spark):
    items = spark.createDataFrame([(1, LONG_ITEM)], "item_id bigint, text string")
    docs = odd_documents(spark)
    assert decontaminate.decontaminate(docs, items).columns == docs.columns
    assert decontaminate.contaminations(docs, items).count() == 2
    assert decontaminate.decontaminate(empty_documents(spark), items).count() == 0


LONG_ITEM = " ".join(f"word{k}" for k in range(100, 140))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_feistel(digits, key, kind):
    n = len(digits)
    u, v = n // 2, n - n // 2
    a, b = int(digits[:u]), int(digits[u:])
    for i in range(8):
        size = u if i % 2 == 0 else v
        moved = int(hashlib.sha256(f"{key}:{kind}:{n}:{i}:{b}".encode()).hexdigest()[:15], 16)
        a, b = b, (a + moved % 10**size) % 10**size
    return f"{a:0{u}d}{b:0{v}d}"


def test_pseudonyms_keep_format_and_link(spark):
    rng = random.Random(2)
    rows, expected = [], []
    for k in range(60):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(body + c for c in "0123456789" if luhn(body + c))
        new = brute_feistel(body, "key", "card")
        new = next(new + c for c in "0123456789" if luhn(new + c))
        spaced = lambda x: "-".join(x[i : i + 4] for i in range(0, 16, 4))
        wrong = body + str((int(card[-1]) + 1) % 10)
        rows.append((k, f"é pay {card}, or {spaced(card)}; not {wrong}."))
        expected.append(f"é pay {new}, or {spaced(new)}; not {wrong}.")
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert [r.text for r in pii.pseudonymise(docs, "key").orderBy("doc_id").collect()] == expected
    text = (
        "tel +1 (988) 555-2485 ip 42.144.35.254. and 300.1.1.1 id 123-45-6789 and 000-45-6789 on 2024-02-29 or 29.02.2024 or 29/02/2024 not 2023-02-29 "
        "to DE89 3704 0044 0532 0130 00 not DE88 3704 0044 0532 0130 00, by A.b+c@mail.example.com"
    )
    other = "again 2024-02-29, a.B+C@mail.example.com and +1 988-555-2485"
    two = spark.createDataFrame([(1, text), (2, other)], "doc_id int, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(two, "key").collect()}
    kinds = [f.kind for f in got[1].found]
    assert kinds == ["phone", "ip", "ssn", "date", "date", "date", "iban", "email"]
    new = got[1].text
    shape = re.compile(
        r"tel \+1 \(([2-9]\d\d)\) ([2-9]\d\d)-(\d{4}) ip (\S+)\. and 300\.1\.1\.1 id (\d{3}-\d\d-\d{4}) and 000-45-6789 on (\d{4})-(\d\d)-(\d\d) or \8\.\7\.\6 "
        r"or \8/\7/\6 not 2023-02-29 to (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) not DE88 3704 0044 0532 0130 00, by (u\w{16}@example\.org)$"
    )
    m = shape.match(new)
    assert m, new
    iban = m[9].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert all(int(x) < 256 for x in m[4].split("."))
    assert got[2].text == f"again {m[6]}-{m[7]}-{m[8]}, {m[10]} and +1 {m[1]}-{m[2]}-{m[3]}"
    assert pii.pseudonymise(two, "another").filter(F.col("text") == new).count() == 0


def test_valid_parts_of_what_is_not_valid(spark):
    card, one, two = "4111 1111 1111 1111", "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332"
    rows = [
        (f"{card} 12/27", "card", card), (f"{card} 123", "card", card), (f"77 {card}", "card", card), (f"7777 {card}", "card", card),
        (f"{one} EUR", "iban", one), (f"{two} BIC", "iban", two), (f"ID12 {card}", "card", card), (f"ID12 2222 3333 4444 5556 {card}", "card", card),
        ("born 1899-12-31", "date", "1899-12-31"), ("due 01.02.2100", "date", "01.02.2100"),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "doc_id int, text string")
    for r in pii.pseudonymise(docs, "key").collect():
        text, kind, value = rows[r.doc_id]
        assert kind in [f.kind for f in r.found] and value not in r.text and len(r.text) == len(text), (text, r)
        for end in (text.split(value)[1], ""):
            assert r.text.endswith(end)
    assert pii._EARLY_DAYS == (datetime.date(1900, 1, 1) - datetime.date(1000, 1, 1)).days
    assert pii._OTHER_DAYS == pii._EARLY_DAYS + (datetime.date(2999, 12, 31) - datetime.date(2100, 1, 1)).days + 1


def test_long_runs_of_digits_end_in_seconds(spark):
    card, account = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    runs = ["7" * 100_000, " ".join(["12345"] * 50_000), "-".join(["12345"] * 50_000), " ".join(["1"] * 20_000), "ID12 " + " ".join(["AB3D"] * 20_000), "X" * 90_000 + "12"]
    rows = [(k, t) for k, t in enumerate(runs)] + [(10 + k, f"{t} x {card} and {account}.") for k, t in enumerate(runs)]
    rows += [(30, f"{' '.join(['0000'] * 600)} {card} {' '.join(['0001'] * 600)}")]
    begun = time.time()
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id int, text string"), "key").collect()}
    assert time.time() - begun < 120
    for k, t in rows:
        assert len(got[k].text) == len(t)
        if k >= 10:
            assert card not in got[k].text
        if 10 <= k < 30:
            assert account not in got[k].text
    assert got[0].text == runs[0] and got[5].text == runs[5]


def test_sixty_languages_and_long_texts_are_learned(spark):
    """Every language is learned from, also if there are many and if one has nothing but very long texts."""
    rng = random.Random(3)
    names = [f"l{k:02d}" for k in range(60)]
    words = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(60)] for n in names}
    text = lambda n, size: " ".join(rng.choices(words[n], k=size))
    rows = [(n, text(n, 30)) for n in names[1:] for _ in range(40)] + [(names[0], text(names[0], 3_000)) for _ in range(40)]
    df = spark.createDataFrame([(k, t, n) for k, (n, t) in enumerate(rows)], "doc_id int, text string, lang string")
    model = language_id.fit(df, settings=language_id.Settings(train_bytes=2_000))
    assert model.languages == tuple(names)
    fresh = spark.createDataFrame([(k, text(n, 30), n) for k, n in enumerate(names * 5)], "doc_id int, text string, lang string")
    right = language_id.identify(fresh, model).filter("lang = lang_pred").count()
    assert right > 0.95 * 300


def test_training_grams_lie_in_three_arrays():
    texts = ["der Hund bellt", "", "ab", "the dog the dog the dog", "gr\u00f6\u00dfer \U0001f600", "x" * 5_000]
    buckets, shares, ends = language_id.bags(texts, 8)
    assert (buckets.dtype, shares.dtype, len(ends)) == (np.int32, np.float32, len(texts) + 1)
    for k, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        both = np.concatenate(language_id.grams(data, np.array([0, len(data)]), 8))
        want, count = np.unique(both[both < 256], return_counts=True)
        got = slice(ends[k], ends[k + 1])
        assert buckets[got].tolist() == want.tolist()
        assert np.array_equal(shares[got], (count / max(count.sum(), 1)).astype(np.float32))


def test_logits_are_plain_sums_over_grams():
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(3, (1 << 8) + 1)).astype(np.float32)
    weights[:, -1] = 0
    model = language_id.Model(("a", "b", "c"), weights, np.array([0.1, 0.2, 0.3], np.float32), 1.0, 0.0, 8)
    texts = ["", "ab", "abc", "Abc! déf", "x" * 50, "ÀÉ 12"]
    got, some = language_id.logits(language_id.pa.array(texts), model)

    def buckets(text):
        low = [b + 32 if 65 <= b < 91 else b for b in text.encode()]
        low = [32 if b < 128 and not 97 <= b < 123 else b for b in low]
        out = []
        for i in range(len(low) - 2):
            three = low[i] | low[i + 1] << 8 | low[i + 2] << 16
            out.append((three * 0x9E3779B1 & 0xFFFFFFFF) >> 24)
            if i + 3 < len(low):
                out.append((((three | low[i + 3] << 24) ^ 0x5BD1E995) * 0x85EBCA6B & 0xFFFFFFFF) >> 24)
        return out

    for t, row, any_gram in zip(texts, got, some):
        own = buckets(t)
        assert bool(own) == any_gram
        assert np.allclose(row, model.bias + sum((weights[:, b].astype(float) for b in own), np.zeros(3)) / max(len(own), 1), atol=1e-5)


def test_permutations_are_one_to_one(spark):
    for n in (2, 3, 4):
        digits = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        out = digits.select("d", pii.feistel(F.col("d"), "k", "t").alias("p")).collect()
        assert len({r.p for r in out}) == 10**n and all(r.p == brute_feistel(r.d, "k", "t") for r in out)
    days = spark.range(73_049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.limit(4_000).select(pii._date_permuted(F.col("d"), "k").alias("p")).filter("p rlike '^(19|20)'").distinct().count() == 4_000


def test_personal_data_of_odd_rows(spark):
    docs = odd_documents(spark)
    out = pii.pseudonymise(docs, "k")
    assert sorted(out.columns) == sorted(docs.columns) and out.filter(F.size("found") > 0).count() == 0
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in docs.collect())
    assert pii.pseudonymise(empty_documents(spark), "k").count() == 0
    small = QUERIES["op10_pii"](spark, SMALL)
    assert not re.search("Python|Pandas|Arrow", small._jdf.queryExecution().executedPlan().toString())
    left = small.filter(r"text rlike '@mail[0-9]'").count()
    assert left == 0 and small.filter("n_card > 0").count() > 0


def test_chat_query_is_native_and_equal_to_sql(spark):
    for sf in (SMALL, MEDIUM):
        ok, message, _ = compare(spark, duck(sf), sf, QUERIES["op1_chat_formatting"], ORACLES["op1_chat_formatting"])
        assert ok, message
    plan = QUERIES["op1_chat_formatting"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_windows_keep_to_the_budget_and_read_back(spark):
    rng = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>user\n", "\\", "<", "|", "<|nl|>", "\n", "word ", "é", "<\\|", "\\n", ""]
    rows = []
    for c in [*range(30), None]:
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "tool\nx<|", None])
            rows.append((c, t if rng.random() < 0.95 else None, role, None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))))
    rows += rows[:5] + [(7, 99, "assistant", "long " * 3_000)]
    s = chat.Settings(budget=300, history=60, least_step=30, block=7)
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, window int, loss_spans string")
    got = {}
    for w in chat.windows(turns, s).withColumn("turns", chat.read_turns(F.col("text"), F.col("repeated_chars"))).withColumn(
        "targets", chat.read_targets(F.col("text"), F.col("loss_spans"))
    ).orderBy("window").collect():
        assert w.n_tokens <= s.budget or w.n_turns == 1
        turns_read, targets = got.setdefault(w.conv_id, ([], []))
        turns_read += [(t.role, t.text) for t in w.turns]
        targets += w.targets
        assert w.repeated_chars < len(w.text) and len(w.turns) == w.n_turns
    for c in got:
        key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", chat_escape(r[3] or ""))
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        assert got[c][0] == own
        assert got[c][1] == [t for r, t in own if r == "assistant"]
    assert chat.windows(turns.limit(0)).count() == 0


def chat_escape(text):
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def test_windows_repeat_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", "x" * 300) for t in range(1, 30)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = chat.windows(turns, chat.Settings(budget=500, history=90)).orderBy("window").collect()
    assert len(out) > 3
    for k, w in enumerate(out):
        assert w.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n")
        assert k == 0 or w.text[: w.repeated_chars].count("x" * 300) == 1


def test_language_on_held_out_texts(spark):
    truth = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op6_language_id"](spark, MEDIUM).join(truth, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.96
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.02


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark)
    trained = language_id.fit(language_id.trainable(spark.read.parquet(f"{SMALL}/documents.parquet")))
    out = language_id.identify(docs, trained).collect()
    assert len(out) == len(ODD_TEXTS) + 2
    for r in out:
        assert (r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text))
        assert (r.rejected and r.score == 0) if r.lang_pred == "und" else 0 <= r.score <= 1
    nothing = language_id.fit(docs.filter("lang is null"))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(empty_documents(spark), trained).count() == 0


def test_quality_on_held_out_texts(spark):
    truth = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op7_quality"](spark, MEDIUM).join(truth, "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in rows)


def test_pair_sum_is_the_sum_over_pairs():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    s = quality.Settings(bits=6, factors=3)
    table = rng.normal(size=((1 << s.bits) + quality.STATISTICS * (quality.BINS + 1), s.factors + 2))
    table[:, -1] = (table[:, 1:-1] ** 2).sum(axis=1)
    model = quality.Model(0.3, table, rng.normal(size=(quality.STATISTICS, quality.BINS)).cumsum(axis=1), s.bits)
    texts = pa.array(["one two two three", "", None, "a b c d e f a"])
    meta = np.zeros(4)
    bucket, value, at, stats = quality.words_and_statistics(texts, meta, s.bits)
    binned = quality._binned(stats, model.edges, s.bits)
    for r, p in enumerate(quality.scores(texts, meta, model)):
        ids = [*bucket[at[r] : at[r + 1]], *binned[r]]
        x = [*value[at[r] : at[r + 1]], *[quality.STAT_VALUE] * quality.STATISTICS]
        raw = 0.3 + sum(table[i, 0] * v for i, v in zip(ids, x, strict=True))
        raw += sum(table[ids[i], 1:-1] @ table[ids[j], 1:-1] * x[i] * x[j] for i in range(len(ids)) for j in range(i))
        assert abs(p - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-5


def test_quality_of_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1), (4, 0), (5, 1), (5, 0), (None, 1), (6, None), (8, 7)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert out.count() == len(ODD_TEXTS) + 2 and out.filter("score between 0 and 1 and predicted = int(score >= 0.5)").count() == out.count()
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty_documents(spark), model).count() == 0


def test_pipeline_against_brute_force(spark):
    out = corpus_pipeline.run(spark, SMALL).collect()
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {key for key, _, c in exact_components([d[:2] for d in docs], 5) if key == c}
    fold = lambda t: decontaminate._FOLD[np.frombuffer(t.encode(), np.uint8)].tobytes()
    leaky = {k for k, t, _ in docs if k in kept and any(decontaminate.best_match(fold(p), fold(t))[0] <= int(0.3 * len(p.encode())) for p in items)}
    assert {r.doc_id for r in out} == kept - leaky
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secrets", "bpe"]


def test_pipeline_stages_take_odd_and_empty_tables(spark):
    for docs in (odd_documents(spark).withColumns({"source": F.lit("s"), "n_chars": F.char_length("text").cast("long")}),):
        for table in (docs, docs.limit(0)):
            for name, stage in corpus_pipeline.STAGES:
                result = stage(spark, table, SMALL)
                assert name == "bpe" or sorted(result.columns) == sorted(docs.columns)
                assert (result.count() > 0) == (table.count() > 0) or name == "language_id"

"""Tables and brute-force versions the tests of this folder share."""

from __future__ import annotations

import collections
import random
import re

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
LONG = " ".join(f"word{k % 977}" for k in range(40_000))
ODD_TEXTS = [
    None, "", " ", "\n\t \n", "a", "A!", "1234", "é", "日本語 テキスト", LONG, LONG, "same text twice here", "same text twice here",
    "tabs\tand\x0bodd\x1cspaces\x85here", "<|endoftext|> inside <|startoftext|>", "\\ back <| slash", "x" * 50_000, "😀 ΑΣ İ ﬁ",
]


def odd_documents(spark):
    """NULL and repeated keys, NULL, empty and long texts, repeated rows, and columns named like results."""
    rows = [(k if k != 3 else None, t) for k, t in enumerate(ODD_TEXTS)] + [(5, "A!"), (None, None)]
    names = "n_tokens int, ids string, spans int, score string, rejected int, found int, fingerprint int, _score int, _leaks int, _found int, _parts int"
    extra = [7, "x", 1, "s", 0, 2, 3, 4, 5, 6, 7]
    return spark.createDataFrame([(*r, "en" if k % 2 else None, *extra) for k, r in enumerate(rows)], f"doc_id bigint, text string, lang string, {names}")


def empty_documents(spark):
    return odd_documents(spark).limit(0)


def shingle_sets(rows, k):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    lower = {c: c + 32 for c in range(65, 91)}
    out = []
    for _, text in rows:
        w = split.findall((text or "").translate(lower))
        out.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def exact_components(rows, k, percent=80):
    """(n_shingles, component) of each row by comparing all sets that share a rare shingle (exact prefix filter)."""
    sets = shingle_sets(rows, k)
    count = collections.Counter(s for x in set(sets) for s in x)
    members = collections.defaultdict(list)
    for n, s in enumerate(sets):
        members[s].append(n)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    places = collections.defaultdict(list)
    for s, own in sorted(members.items(), key=lambda x: len(x[0])):
        if not s:
            continue
        for n in own[1:]:
            parent[root(n)] = root(own[0])
        rare = sorted(s, key=lambda g: (count[g], g))[: len(s) - (percent * len(s) + 99) // 100 + 1]
        for other in {o for g in rare for o in places[g]}:
            shared = len(s & other)
            if 100 * shared >= percent * (len(s) + len(other) - shared):
                parent[root(members[other][0])] = root(own[0])
        for g in rare:
            places[g].append(s)
    least: dict[int, int] = {}
    for n, (key, _) in enumerate(rows):
        if key is not None and sets[n]:
            least[root(n)] = min(key, least.get(root(n), key))
    return [(key, len(s), least.get(root(n)) if s else key) for n, ((key, _), s) in enumerate(zip(rows, sets, strict=True))]


def copies(seed=3):
    """Exact copies, a crowd of near copies, chains of drifting copies, and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    out = []
    base = text(120)
    out += [" ".join(base)] * 60
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = word()
        out.append(" ".join(t))
    for _ in range(20):
        t = text(100)
        for _ in range(6):
            out.append(" ".join(t))
            t = list(t)
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = word()
    passage = text(60)
    for _ in range(150):
        out.append(" ".join(text(rng.randint(10, 60)) + passage))
    out += [" ".join(text(rng.randint(1, 6))) for _ in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))

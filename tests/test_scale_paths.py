"""The paths that large or skewed data takes, forced on small data and checked by brute force."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnfold.operators import encode, ensemble, geo, joins, neighbors, ordering, text, windows

RNG = random.Random(7)


def skewed(spark, n=600):
    """One key owns half of the rows, one value a third of those."""
    rows = []
    for i in range(n):
        g = "hot" if i % 2 else f"g{i % 37}"
        x = 5.0 if i % 3 == 0 else round(RNG.random() * 50, 2)
        rows.append((i, g, x, int(RNG.random() < 0.4)))
    return rows, spark.createDataFrame(rows, "id long, g string, x double, y int")


@pytest.mark.parametrize("ranges", [1, 7, 64, 400])
def test_split_running_totals(spark, ranges):
    rows, df = skewed(spark)
    vals = df.groupBy("g", "x").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    out = ordering.running_totals(vals, ["g"], "x", ["n", "p"], ranges=ranges, plain_rows=0).collect()
    for r in out:
        mine = [v for v in rows if v[1] == r.g]
        upto = [v for v in mine if v[2] <= r.x]
        assert (r.n_upto, r.n_all) == (len(upto), len(mine))
        assert (r.p_upto, r.p_all) == (sum(v[3] for v in upto), sum(v[3] for v in mine))
    assert len(out) == len({(v[1], v[2]) for v in rows})


def test_split_running_totals_without_groups(spark):
    rows, df = skewed(spark)
    vals = df.groupBy("x").agg(F.count("*").alias("n"))
    out = ordering.running_totals(vals, [], "x", ["n"], ranges=50, plain_rows=0).collect()
    assert all(r.n_upto == sum(v[2] <= r.x for v in rows) and r.n_all == len(rows) for r in out)


def test_range_sizes_are_bounded(spark):
    """No range of a split group may hold much more than its fair share."""
    vals = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") * F.col("id")).cast("double").alias("x"), F.lit(1).alias("n"))
    out = ordering.running_totals(vals, ["g"], "x", ["n"], ranges=200, plain_rows=0)
    assert out.agg(F.max("n_upto"), F.count("*")).first()[:] == (20_000, 20_000)


@pytest.fixture
def no_broadcast(monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)


@pytest.mark.parametrize("share", [1, 10, 1000])
def test_lookup_with_hot_and_cold_keys(spark, monkeypatch, no_broadcast, share):
    monkeypatch.setattr(joins, "HOT_SHARE", share)
    rows, df = skewed(spark)
    df = df.union(spark.createDataFrame([(-1, None, 1.0, 0), (-2, "never", 1.0, 0)], df.schema))
    dim = df.filter("g <> 'never'").groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m"))
    out = joins.lookup(df, dim, "g", weight="n")
    assert "_hot" not in out.columns and out.columns == [*df.columns, "m"]
    got = {r.id: r.m for r in out.collect()}
    assert len(got) == len(rows) + 2 and got[-1] is None and got[-2] is None
    for i, g, _, _ in rows:
        mine = [v[2] for v in rows if v[1] == g]
        assert got[i] == pytest.approx(sum(mine) / len(mine))


def test_lookup_spreads_a_key_that_only_the_probing_side_has(spark, no_broadcast):
    """A third of the rows has a key that is absent from the other side, another third one that is rare there."""
    n = 30_000
    g = F.when(F.col("id") % 3 == 0, "absent").when(F.col("id") % 3 == 1, "rare").otherwise(F.concat(F.lit("g"), (F.col("id") % 500).cast("string")))
    df = spark.range(n).select("id", g.alias("g"))
    dim = spark.range(-1, 500).select(F.when(F.col("id") < 0, "rare").otherwise(F.concat(F.lit("g"), F.col("id").cast("string"))).alias("g"), F.col("id").alias("m"), F.lit(1).alias("n"))
    assert len(joins.hot_keys(df, ["g"])) <= joins.HOT_SHARE and {spark.range(1).select(F.xxhash64(F.lit(k))).first()[0] for k in ("absent", "rare")} <= set(joins.hot_keys(df, ["g"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for weight in ("n", None):
            out = joins.lookup(df, dim, "g", weight=weight).withColumn("p", F.spark_partition_id())
            sizes = [r[1] for r in out.groupBy("p").count().collect()]
            assert sum(sizes) == n and max(sizes) < 2 * n / 8
            got = {r.g: (r.m, r.n_rows) for r in out.groupBy("g").agg(F.max("m").alias("m"), F.count("*").alias("n_rows")).collect()}
            assert got["absent"] == (None, n // 3) and got["rare"] == (-1, n // 3) and got["g2"][0] == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lookup_salt_is_a_shuffle_key(spark, no_broadcast):
    _, df = skewed(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dim = df.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m"))
        plan = joins.lookup(df, dim, "g", weight="n")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "_salt" in plan and any(
        "hashpartitioning(g" in line and "_salt" in line for line in plan.splitlines()
    )


def test_target_encoding_on_the_shuffled_path(spark, no_broadcast):
    rows, df = skewed(spark)
    df = windows.stratified_folds(df, "y", 4)
    out = encode.target_encode_oof(df, ["g"], "y", "fold", 5.0).collect()
    g0 = sum(v[3] for v in rows) / len(rows)
    for r in out:
        rest = [v.y for v in out if v.g == r.g and v.fold != r.fold]
        assert r.g_te == pytest.approx((sum(rest) + 5 * g0) / (len(rest) + 5))


def km(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(h)))


def world(n=250):
    rows = []
    for i in range(n):
        lat = RNG.uniform(-90, 90) if i % 3 else RNG.choice([-1, 1]) * RNG.uniform(84, 90)
        rows.append((i, lat, RNG.uniform(-180, 180)))
    return rows


@pytest.mark.parametrize("radius", [30.0, 500.0, 3000.0])
@pytest.mark.parametrize("cell_rows", [1, 20_000])
def test_cell_join_equals_brute_force(spark, monkeypatch, radius, cell_rows):
    monkeypatch.setattr(geo, "CELL_ROWS", cell_rows)
    rows = world()
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    got = sorted((r.id, r.n_id) for r in geo.radius_join(df, df, radius, exclude_self=True).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and km(a, b) <= radius)
    assert got == want


def dense(n=900):
    """Two crowded towns, a pile of exact copies and scattered points."""
    rows = []
    for i in range(n):
        if i % 9 == 0:
            rows.append((i, 10.0, 20.0, "a", 1.0, i % 2, i % 3))
        elif i % 9 == 1:
            rows.append((i, RNG.uniform(-60, 60), RNG.uniform(-180, 180), RNG.choice("ab"), RNG.gauss(0, 1), i % 2, i % 3))
        elif i % 2:
            rows.append((i, 10 + RNG.gauss(0, 0.05), 20 + RNG.gauss(0, 0.05), RNG.choice("ab"), RNG.gauss(0, 1), int(RNG.random() < 0.3), i % 3))
        else:
            rows.append((i, 10.4 + RNG.gauss(0, 0.3), 20.4 + RNG.gauss(0, 0.3), RNG.choice("abc"), RNG.gauss(0, 1), int(RNG.random() < 0.3), i % 3))
    return rows


def brute(rows, wanted, weights, order, fold=False):
    n = len(rows)
    mean = sum(r[4] for r in rows) / n
    std = math.sqrt(sum((r[4] - mean) ** 2 for r in rows) / (n - 1)) + 1e-8
    out = {}
    far = max(d for _, d in wanted)
    for a in rows:
        near = []
        for b in rows:
            if a[0] == b[0] or (fold and a[6] == b[6]):
                continue
            d = km(a, b)
            if d <= far:
                mixed = weights[0] * d / 1000 + weights[1] * (a[3] != b[3]) + weights[2] * abs(a[4] - b[4]) / std
                near.append((mixed if order == "combined" else d, b[0], d, b[5]))
        near.sort()
        row = {}
        for k, lim in wanted:
            first = [v for v in near if v[2] <= lim][:k]
            row[f"nn{k}_max{lim}_target_mean"] = sum(v[3] for v in first) / len(first) if first else None
            row[f"nn{k}_max{lim}_count"] = len(first)
            row[f"nn{k}_max{lim}_dist_mean"] = sum(v[2] for v in first) / len(first) if first else None
        for name, label in (("positive", 1), ("negative", 0)):
            row[f"dist_to_nearest_{name}"] = next((v[2] for v in near if v[3] == label), None)
        out[a[0]] = row
    return out


@pytest.mark.parametrize(
    "order, direct_rows, cell_rows, fold",
    [("combined", 40, 50, True), ("distance", 10, 20_000, False), ("distance", 10**9, 50, False)],
)
def test_neighbour_search_by_level_equals_brute_force(spark, monkeypatch, order, direct_rows, cell_rows, fold):
    monkeypatch.setattr(geo, "DIRECT_ROWS", direct_rows)
    monkeypatch.setattr(neighbors, "CELL_ROWS", cell_rows)
    rows = dense()
    wanted, weights = [(3, 50), (5, 200)], (1.0, 0.7, 0.4)
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double, c string, x double, y int, fold int")
    out = geo.neighbor_features(
        df, None, wanted, ["c"], ["x"], *weights, order=order, fold="fold" if fold else None
    ).collect()
    want = brute(rows, wanted, weights, order, fold)
    assert len(out) == len(rows)
    for r in out:
        for name, value in want[r.id].items():
            got = r[name]
            assert got is None if value is None else got == pytest.approx(value, abs=1e-6), (r.id, name)


def test_neighbour_search_from_small_bounds_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(geo, "LEVEL_ROWS", 1)
    test_neighbour_search_by_level_equals_brute_force(spark, monkeypatch, "combined", 40, 50, True)


def test_keyword_index_equals_trying_every_keyword(spark, monkeypatch):
    parts = ["ab", "bc", "a b", "", "x", "äö", "nation", "tion", "zzzz", "The", "the ", "e\nf", "abcab", "ß", "日本語"]
    rows = [(f"l{i % 7}", ["en", "de", "*"][i % 3] if i % 3 < 2 else "en", parts[i % len(parts)] + parts[i * 7 % len(parts)]) for i in range(90)] + [("n", "en", None), ("d", "en", "ab"), ("d", "en", "ab")]
    dictionary = text.weighted_dictionary(spark.createDataFrame(rows, "label string, lang string, keyword string"))
    bodies = ["".join(RNG.choice([*parts, " ", "\n"]) for _ in range(RNG.randint(0, 12))) for _ in range(80)]
    docs = spark.createDataFrame([(i, b if i else None, ["en", "de", "fr", None][i % 4]) for i, b in enumerate(bodies)], "id long, text string, lang string")

    def results(lang):
        scores = sorted(map(tuple, text.keyword_scores(docs, dictionary, lang=lang).collect()))
        best = sorted((r.id, r.label, r.score) for r in text.keyword_classify(docs, dictionary, lang=lang).collect())
        return scores, best

    few = [results(x) for x in ("lang", None)]
    monkeypatch.setattr(text, "FEW_KEYWORDS", 0)
    assert [results(x) for x in ("lang", None)] == few and few[0][0]
    monkeypatch.setattr(text, "PIECE_ROWS", 20)
    assert [results(x) for x in ("lang", None)] == few


def test_many_keywords_take_little_longer_than_few(spark):
    """Keywords that do not occur are not tried: 100 times as many cost a fraction more."""
    docs = spark.createDataFrame([(i, " ".join(f"w{RNG.randrange(900)}" for _ in range(300)), "en") for i in range(200)], "id long, text string, lang string")
    bodies = [r.text for r in docs.collect()]
    taken = {}
    for n in (1_000, 100_000):
        index = text.KeywordIndex((f"l{k % 50}", f"w{k}" if k < 1000 else f"q{k:06d}x{k * 7 % 1000}", 1.0) for k in range(n))
        start = time.perf_counter()
        found = [index.scores(b) for b in bodies]
        taken[n] = time.perf_counter() - start
        expected = [sum(f"w{k}" in b for k in range(1000)) for b in bodies[:20]]
        assert [sum(f.values()) for f in found[:20]] == expected
    assert taken[100_000] < 3 * taken[1_000]


def test_winner_of_a_blend_needs_few_exact_scores(spark):
    rows = [(i, int(RNG.random() < 0.4), RNG.random(), RNG.gauss(0, 1)) for i in range(3_000)]
    rows = [(i, y, round(a + 0.3 * y, 3), b - (0.4 * y)) for i, y, a, b in rows] + [(-1, 1, None, 0.5)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    grid = ensemble.weight_grid([0.0, 0.5, 1.0], [-1.0, -0.5, -0.1, 0.0, 0.2, 1.0])
    board = ensemble.blend_search(df, ["a", "b"], grid)
    exact = {r.config_id: r.composite for r in board.collect()}
    for bins in (4, 64, 1024):
        bounds = {r.config_id: (r.low, r.high) for r in ensemble.blend_bounds(df, ["a", "b"], grid, bins=bins).collect()}
        assert all(low - 1e-9 <= exact[k] <= high + 1e-9 for k, (low, high) in bounds.items())
        best = ensemble.best_blend(df, ["a", "b"], grid, bins=bins).first()
        assert tuple(best) == tuple(ensemble.choose_best(board).first())
    assert sum(high >= max(low for low, _ in bounds.values()) for _, high in bounds.values()) < len(grid) / 2


def test_long_dictionary_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, " ".join(RNG.choice(["aa1", "bb2", "cc3", "dd4", "ee5"]) for _ in range(3)), "en") for i in range(60)],
        "id long, text string, lang string",
    )
    words = {f"label{w}": {"en": [w]} for w in ("aa1", "bb2", "cc3", "dd4", "ee5")}
    dictionary = text.weighted_dictionary(text.dictionary_frame(spark, words))
    whole = {r.id: (r.label, r.score) for r in text.keyword_classify(docs, dictionary).collect()}
    scores = sorted(tuple(r) for r in text.keyword_scores(docs, dictionary).collect())
    labels = text.dictionary_frame(spark, words).select("label")
    asked = docs.select("id", F.substring("text", 1, 3).alias("response"))
    matched = sorted(tuple(r) for r in text.match_label(asked, labels, mode="overlap").collect())
    monkeypatch.setattr(text, "PIECE_ROWS", 2)
    assert {r.id: (r.label, r.score) for r in text.keyword_classify(docs, dictionary).collect()} == whole
    assert sorted(tuple(r) for r in text.keyword_scores(docs, dictionary).collect()) == scores
    assert sorted(tuple(r) for r in text.match_label(asked, labels, mode="overlap").collect()) == matched


def _cell(seed, refs, queries, slots, **more):
    """One cell as a task of the neighbour search gets it, and the search."""
    rng = np.random.default_rng(seed)
    n = refs + queries
    kind = [rng.choice(list("abc"), n), rng.choice(list("xy"), n)]
    num = [rng.normal(size=n).round(2), np.where(rng.random(n) < 0.03, np.nan, rng.normal(size=n))]
    columns = {
        "_cell": np.zeros(n, np.int64), "_part": np.zeros(n, np.int64), "_pattern": np.full(n, more.pop("pattern", -1), np.int32),
        "_tag": np.repeat([0, 1], [refs, queries]).astype(np.int8), "id": np.r_[np.arange(refs), np.arange(queries)],
        "_lat": rng.uniform(0, 3, n).round(2), "_lon": rng.uniform(178, 181, n).round(2), "_fold": rng.integers(0, 3, n),
        "fold": np.zeros(n, np.int64), "c": kind[0], "e": kind[1], "u": num[0], "v": num[1],
        "_code_c": np.array([ord(x) for x in kind[0]]), "_code_e": np.array([ord(x) for x in kind[1]]),
        "_label": rng.integers(0, 2, n).astype(float), "_open": rng.integers(1, 1 << min(len(slots), 4), n),
    }
    table = pa.table({k: pa.array(v, from_pandas=True) for k, v in columns.items()})
    orders = more.pop("orders", ((1.0, 0.5, 0.25, 0.5, 0.1),))
    return table, neighbors.Search(("c", "e"), ("u", "v"), orders, slots, "y", **more)


SLOTS = (neighbors.Slot(60.0, 60.0, 4), neighbors.Slot(150.0, 150.0, 7), neighbors.Slot(-1.0, 150.0, 1, label=1), neighbors.Slot(-2.0, 150.0, 1, label=0))
GRID = tuple((g, a, b, u, v) for g in (0.5, 1.0) for a in (0.0, 0.5) for b in (0.0, 1.0) for u, v in ((0.0, 0.0), (0.5, 0.0), (0.25, 0.25)))
GRID_SLOTS = tuple(neighbors.Slot(0.0, 150.0, k, i, one) for i in range(len(GRID)) for k, one in ((5, None), (1, 1), (1, 0)))


@pytest.mark.parametrize(
    "slots, more",
    [
        (SLOTS, {}), (SLOTS, {"fold": "fold"}), (SLOTS, {"itself": False}), (SLOTS, {"bound": 0.4}), (SLOTS, {"bound": 0.9, "pattern": 2}),
        (SLOTS, {"orders": ((1.0, 0.0, 0.0, 0.0, 0.0),)}), (SLOTS, {"orders": ((0.0, 1.0, 0.0, 1.0, 0.0),)}), (GRID_SLOTS, {"orders": GRID, "pairs": True}),
    ],
)
def test_a_full_cell_computes_few_pairs_exactly_and_finds_the_same(monkeypatch, slots, more):
    table, search = _cell(3, 1500, 200, slots, **more)
    computed, exact = [], neighbors.km_between

    def counted(lat, lon, a, b):
        computed.append(len(a))
        return exact(lat, lon, a, b)

    monkeypatch.setattr(neighbors, "km_between", counted)

    def found():
        computed.clear()
        batches = neighbors._task(search, search.columns())(iter(table.to_batches()))
        rows = [tuple(r.values())[:2] + (r[f"c{4 + len(search.columns())}"],) for b in batches for r in b.to_pylist()]
        return sorted(rows), sum(computed)

    few, n = found()
    assert n < 1500 * 200 / 4
    monkeypatch.setattr(neighbors, "BOUNDED_PAIRS", 1 << 40, raising=False)
    every, n = found()
    assert n == 1500 * 200 and few == every and len(few) > 200


@pytest.mark.parametrize(
    "more",
    [
        {}, {"fold": "fold"}, {"itself": False}, {"bound": 0.4}, {"bound": 0.9, "pattern": 2}, {"bound": 0.6, "pattern": 0},
        {"orders": ((1.0, 0.0, 0.0, 0.0, 0.0),)}, {"orders": ((0.5, 1.0, 0.0, 1.0, 0.0),)},
    ],
)
def test_a_fuller_cell_looks_at_few_of_its_pairs_and_finds_the_same(monkeypatch, more):
    table, search = _cell(5, 8000, 1000, SLOTS, **more)
    table = table.set_column(table.schema.get_field_index("_open"), "_open", pa.array(np.full(9000, 15)))
    looked, square = [], neighbors.Chords.square

    def counted(self, queries):
        out = square(self, queries)
        looked.append(out.size)
        return out

    monkeypatch.setattr(neighbors.Chords, "square", counted)

    def found():
        batches = neighbors._task(search, search.columns())(iter(table.to_batches()))
        return sorted(tuple(r.values())[:2] + (r[f"c{4 + len(search.columns())}"],) for b in batches for r in b.to_pylist())

    few = found()
    assert sum(looked) < 8000 * 1000 / 2
    monkeypatch.setattr(neighbors, "BOUNDED_PAIRS", 1 << 40)
    assert few == found() and len(few) > 200


@pytest.mark.parametrize("more", [{}, {"fold": "fold"}, {"itself": False}])
def test_several_orders_compute_few_pairs_of_a_row_exactly_and_find_the_same(monkeypatch, more):
    table, search = _cell(11, 4000, 300, GRID_SLOTS, orders=GRID, pairs=True, **more)
    computed, exact = [], neighbors.km_between

    def counted(lat, lon, a, b):
        computed.append(len(a))
        return exact(lat, lon, a, b)

    monkeypatch.setattr(neighbors, "km_between", counted)

    def found():
        computed.clear()
        batches = neighbors._task(search, search.columns())(iter(table.to_batches()))
        return sorted((r["c0"], r[f"c{4 + len(search.columns())}"]) for b in batches for r in b.to_pylist()), sum(computed)

    few, n = found()
    # the limits of the orders leave little more than the first rows, and not those of every set of differing categories
    assert n < 1.1 * len(few)
    monkeypatch.setattr(neighbors, "BOUNDED_PAIRS", 1 << 40)
    every, n = found()
    assert n == 4000 * 300 and few == every and len(few) > 300


@pytest.mark.parametrize("k, slab", [(1, 1 << 16), (3, 1 << 16), (5, 64)])
def test_every_choice_of_weights_ranks_the_pairs_of_a_row(monkeypatch, k, slab):
    monkeypatch.setattr(geo, "SLAB", slab, raising=False)
    rng = np.random.default_rng(k)
    rows = []
    for i in range(120):
        rows.append((i, None, float(i % 2), None, None, None))  # the row's own
        for j in range(int(rng.integers(0, 4) ** 3)):
            number = None if rng.random() < 0.1 else round(float(rng.integers(0, 4)) / 2, 1)
            rows.append((i, j, float(rng.integers(0, 3)), float(rng.integers(0, 5)) * 10, float(rng.integers(0, 2)), number))
    table = pa.table({c: pa.array([r[n] for r in rows], t) for n, (c, t) in enumerate(zip(("id", "n_id", "y", "km", "a", "u"), (pa.int64(), pa.int64(), *[pa.float64()] * 4)))})
    orders = [(1.0, 0.0, 0.0), (1.0, 0.01, 0.0), (0.5, 0.5, 1.0), (0.0, 0.0, 1.0)]
    got: dict = {}
    for batch in geo._configurations(orders, ["a", "u"], k)(iter(table.to_batches())):
        for r in batch.to_pylist():
            got.setdefault(r["config_id"], []).append([r["y"], *[r[f"f{i}"] for i in range(5)]])
    for number, (g, a, u) in enumerate(orders, start=1):
        want = []
        for i in range(120):
            mine = [r for r in rows if r[0] == i and r[1] is not None]
            value = lambda r: round(g * r[3] / 1000 + a * r[4] + (0.0 if not u else math.inf if r[5] is None else u * r[5]), 12)  # noqa: B023, E731
            mine.sort(key=lambda r: (value(r), r[1]))
            first = mine[:k]
            mean = lambda n: sum(r[n] for r in first) / len(first) if first else None  # noqa: B023, E731
            nearest = [next((r[3] for r in mine if r[2] == one), None) for one in (1.0, 0.0)]
            want.append([float(i % 2), mean(2), float(len(first)), mean(3), *nearest])
        assert [[None if x is None else round(x, 9) for x in r] for r in got[number]] == [[None if x is None else round(x, 9) for x in r] for r in want]


def test_grid_search_over_cut_cells_is_the_same(spark, monkeypatch):
    rng = random.Random(23)
    rows = [
        (i, rng.choice("abc"), rng.choice(["x", "y", None]), rng.choice([None, *map(float, range(20))]), rng.uniform(0, 3), rng.uniform(178, 181), int(rng.random() < 0.3))
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, "id long, c string, e string, u double, latitude double, longitude double, y int")

    def found():
        out = geo.neighbor_grid_search(df, [[], ["c"], ["c", "e"]], [[], ["u"]], [(1.0, 0.5, 0.5), (0.5, 1.0, 0.5)])
        return sorted((r.config_id, r.cat_cols, r.num_cols, round(r.best_corr, 9)) for r in out.collect())

    whole = found()
    monkeypatch.setattr(neighbors, "CELL_ROWS", 40)
    assert found() == whole and len(whole) == 12
    monkeypatch.setattr(neighbors, "BOUNDED_PAIRS", 1 << 40)
    assert found() == whole

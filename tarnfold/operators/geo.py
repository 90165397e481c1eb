"""Great-circle joins and neighbour features without all-pairs work in dense places.

Neighbour features are complete per row and radius. Where few rows are near, a row is compared with all
of them. Where many are, it starts among rows of its own categories in a cell so small that they can just fill
its slots: with a bound b on the order value, all rows below b are found by looking, for every set of
categories that may differ, as far as the rest of b reaches. A slot with enough rows below b is settled; the
others go on with a bound four times as large. Levels end where the data has no more crowded cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarnfold.operators import neighbors
from tarnfold.operators.encode import fit_scaling, standardize
from tarnfold.operators.joins import cross_grid, grid_literal, lookup, measured
from tarnfold.operators.neighbors import EARTH_KM, Ring, Search, Slot
from tarnfold.operators.stats import pearson
from tarnfold.operators.windows import seeded_sample
from tarnfold.session import cut_lineage, shuffle_partitions

# Reference rows of one cell that meet in one task before the cell is split.
CELL_ROWS = 20_000
# A row is compared with all rows within reach if they are no more than this.
DIRECT_ROWS = 4_096
# Rows of equal categories in a cell from which on a search by numbers, too, begins in it.
LEVEL_ROWS = 1_024
# Cells are not made smaller than this; rows that crowd such a cell stand at one place.
FINEST_KM = 1e-4
NEAREST_POSITIVE, NEAREST_NEGATIVE = -1.0, -2.0
# Pairs that are ranked for all choices of weights at a time.
SLAB = 1 << 16


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Great-circle distance between two pairs of degree columns."""
    return F.expr(
        f"{2 * EARTH_KM}D * asin(sqrt(least(1D, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"
    )


def _step(km: float) -> float:
    return math.degrees(km / EARTH_KM) * (1 + 1e-9)


def _reach(lat: str, km: float) -> str:
    """Degrees of longitude a circle of ``km`` around ``lat`` can span to either side."""
    sine = math.sin(min(km / EARTH_KM, math.pi / 2))
    return (
        f"if(abs({lat}) + {_step(km)!r}D < 90D,"
        f" degrees(asin(least(1D, {sine!r}D / cos(radians({lat}))))) + 1e-9D, 180D)"
    )


def _columns(band: str, km: float) -> str:
    """Longitude cells in a latitude band: as wide as the reach at its pole-side edge."""
    step = f"{_step(km)!r}D"
    edge = f"least(90D, greatest(abs({band} * {step} - 90D), abs(({band} + 1) * {step} - 90D)))"
    return f"greatest(1L, floor(360D / ({_reach(edge, km)})))"


def cell_sql(lat: str, lon: str, km: float) -> str:
    band = f"floor(({lat} + 90D) / {_step(km)!r}D)"
    columns = _columns(band, km)
    return f"{band} * {1 << 32}L + pmod(floor(({lon} + 180D) * {columns} / 360D), {columns})"


def around_sql(lat: str, lon: str, km: float) -> str:
    """Every cell a point within ``km`` can lie in, across the date line and the poles."""
    step, reach = f"{_step(km)!r}D", _reach(lat, km)
    row = (
        f"struct(band, {_columns('band', km)} as columns)"
    )
    span = (
        f"sequence(floor(({lon} - r + 180D) * x.columns / 360D), least(floor(({lon} + r + 180D) * x.columns / 360D),"
        f" floor(({lon} - r + 180D) * x.columns / 360D) + x.columns - 1))"
    )
    return (
        f"array_distinct(flatten(transform(transform(sequence(floor(({lat} - {step} + 90D) / {step}),"
        f" floor(({lat} + {step} + 90D) / {step})), band -> {row}),"
        f" x -> transform({span.replace(' r ', f' ({reach}) ')}, i -> x.band * {1 << 32}L + pmod(i, x.columns)))))"
    )


def cell_of(lat: str, lon: str, km: float) -> Column:
    return F.expr(cell_sql(lat, lon, km))


def cells_around(lat: str, lon: str, km: float) -> Column:
    return F.expr(around_sql(lat, lon, km))


def _ref_side(ref: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return ref.select(*[F.col(c).alias(n) for c, n in names.items()])


def _meet(probe: DataFrame, ref: DataFrame, cell: str, ref_key: str) -> DataFrame:
    """Join on ``cell``. Every cell of ``ref`` with more than CELL_ROWS rows is dealt out over several
    tasks by key hash, and the probing rows go to each of them."""
    sizes = ref.groupBy(cell).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > CELL_ROWS)
    sizes, n = measured(sizes.withColumn("_parts", F.ceil(F.col("_rows") / CELL_ROWS).cast("int")))
    if n == 0:
        return probe.join(ref, cell).drop(cell)
    one = {"_parts": 1}
    ref = lookup(ref, sizes, cell, one, weight="_rows", rows=n)
    ref = ref.withColumn("_part", F.pmod(F.xxhash64(ref_key), F.col("_parts")).cast("int")).drop("_parts")
    probe = lookup(probe, sizes, cell, one, weight="_rows", rows=n)
    probe = probe.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return probe.join(ref, [cell, "_part"]).drop(cell, "_part")


def radius_join(
    left: DataFrame,
    right: DataFrame,
    km: float,
    key: str = "id",
    lat: str = "latitude",
    lon: str = "longitude",
    exclude_self: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Pairs within ``km``: all columns of ``left``, ``n_<column>`` of ``right``, ``km``.

    An equi-join on cells the size of the radius. A cell of ``right`` with many rows is
    dealt out over several tasks by id hash, and the probing rows go to each of them.
    """
    names = {c: f"n_{c}" for c in dict.fromkeys([key, lat, lon, *carry])}
    ref = _ref_side(right, names).withColumn("_cell", cell_of(f"n_{lat}", f"n_{lon}", km))
    ref = ref.filter(F.col("_cell").isNotNull())
    pairs = _meet(left.withColumn("_cell", F.explode(cells_around(lat, lon, km))), ref, "_cell", f"n_{key}")
    pairs = pairs.withColumn("km", haversine_km(lat, lon, f"n_{lat}", f"n_{lon}")).filter(F.col("km") <= km)
    if exclude_self:
        pairs = pairs.filter(F.col(key) != F.col(f"n_{key}"))
    return pairs.select(*left.columns, *[n for n in names.values()], "km")


def _mean(parts: Sequence[str]) -> str:
    return f"(({' + '.join(parts)}) / {len(parts)}D)" if parts else "0D"


def mixed_distance(
    cats: Sequence[str], nums: Sequence[str], geo: float, cat: float, num: float
) -> Column:
    """``geo * km/1000 + cat * share of differing categories + num * mean |difference|``.

    Categories compare as text, so NULL equals NULL; an unknown number sorts last.
    """
    differ = [f"if({c} <=> n_{c}, 0D, 1D)" for c in cats]
    gaps = [f"abs({c} - n_{c})" for c in nums]
    total = f"{float(geo)}D * km / 1000D + {float(cat)}D * {_mean(differ)} + {float(num)}D * {_mean(gaps)}"
    return F.expr(f"coalesce({total}, double('infinity'))")


def _limits(wanted: Sequence[tuple[int, float]]) -> dict[float, int]:
    limits: dict[float, int] = {}
    for k, d in wanted:
        limits[float(d)] = max(k, limits.get(float(d), 0))
    return limits


def _features(first: DataFrame, by: Sequence[str], wanted: Sequence[tuple[int, float]]) -> DataFrame:
    cells = []
    for k, d in wanted:
        here, name = f"d = {float(d)}D and rank <= {k}", f"nn{k}_max{d:g}"
        cells += [
            F.expr(f"avg(label) filter (where {here}) as {name}_target_mean"),
            F.expr(f"count(*) filter (where {here}) as {name}_count"),
            F.expr(f"avg(km) filter (where {here}) as {name}_dist_mean"),
        ]
    cells += [
        F.expr(f"min(km) filter (where d = {NEAREST_POSITIVE}D) as dist_to_nearest_positive"),
        F.expr(f"min(km) filter (where d = {NEAREST_NEGATIVE}D) as dist_to_nearest_negative"),
    ]
    return first.groupBy(*by).agg(*cells)


def pair_grid(ks: Sequence[int], dists: Sequence[float]) -> list[tuple[int, float]]:
    return [(k, d) for k in ks for d in dists]


def neighbor_features(
    df: DataFrame,
    ref: DataFrame | None = None,
    wanted: Sequence[tuple[int, float]] = ((5, 200), (10, 200), (5, 500), (10, 500)),
    cats: Sequence[str] = (),
    nums: Sequence[str] = (),
    geo: float = 1.0,
    cat: float = 0.0,
    num: float = 0.0,
    y: str = "y",
    key: str = "id",
    lat: str = "latitude",
    lon: str = "longitude",
    fold: str | None = None,
    default: Column | float | None = None,
    order: str = "combined",
) -> DataFrame:
    """Label mean, count and mean distance of the k most similar rows within each radius.

    Columns ``nn<k>_max<d>_{target_mean,count,dist_mean}`` plus the distance to the first
    positive and first negative row in the same order (``order="distance"``: the nearest).
    ``ref=None`` compares the table with itself, each row left out of its own neighbours.
    ``fold`` also leaves out the row's own fold. ``default`` replaces a missing label mean.
    Numbers are scaled by the mean and deviation of ``ref``.
    """
    itself = ref is None
    scaling = fit_scaling(df if itself else ref, nums) if nums else None
    zs = [f"{c}_z" for c in nums]
    kept = [key, lat, lon, *cats, *zs] + ([fold] if fold else [])

    def prepared(frame: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        if nums:
            frame = standardize(frame, scaling, nums, suffix="_z")
        columns = [F.col(key).alias("id") if c == key else F.col(c) for c in [*kept, *extra]]
        return frame.select(*columns).filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())

    # used by the density check, both join sides and the levels: computed once
    # and dealt out evenly, since the work per row is many times its bytes
    tasks = shuffle_partitions(df.sparkSession)
    points = cut_lineage(prepared(df if itself else ref, [y]).repartition(tasks, "id"))
    queries = points.drop(y) if itself else cut_lineage(prepared(df).repartition(tasks, "id"))
    limits = _limits(wanted)
    far = max(limits)
    shared = (cat, num) if order == "combined" else (0.0, 0.0)
    weights = (geo if order == "combined" else 1.0, *[shared[0] / len(cats) for _ in cats], *[shared[1] / len(zs) for _ in zs])
    slots = [Slot(d, d, k) for d, k in limits.items()]
    slots += [Slot(NEAREST_POSITIVE, far, 1, label=1), Slot(NEAREST_NEGATIVE, far, 1, label=0)]
    search = Search(tuple(cats), tuple(zs), (weights,), tuple(slots), y, fold, None, itself)

    # Rows that are equal in all that counts are at equal distance from everything and ties go by id, so only the
    # first k + 1 of them can ever be chosen. Exact, and a pile of copies costs nothing.
    same = [lat, lon, y, *([fold] if fold else [])] + [c for c, w in zip([*cats, *zs], weights[1:]) if w]
    alike = W.partitionBy(*dict.fromkeys(same)).orderBy("id")
    most = max([1, *limits.values()])
    points = points.withColumn("_copy", F.row_number().over(alike)).filter(F.col("_copy") <= most + 1).drop("_copy")
    points = cut_lineage(points.repartition(tasks, "id"))

    def ranked(pairs: DataFrame, below: float | None = None) -> DataFrame:
        """The exact ranking of a few candidates per slot."""
        pairs = pairs.withColumn("km", haversine_km(lat, lon, f"n_{lat}", f"n_{lon}"))
        pairs = pairs.filter(F.col("km") <= F.when(F.col("d") > 0, F.col("d")).otherwise(far))
        if itself:
            pairs = pairs.filter(F.col("id") != F.col("n_id"))
        if fold:
            pairs = pairs.filter(~F.col(fold).eqNullSafe(F.col(f"n_{fold}")))
        value = mixed_distance(cats, zs, geo, cat, num) if order == "combined" else F.col("km")
        pairs = pairs.withColumn("_value", value)
        if below is not None:
            pairs = pairs.filter(F.col("_value") < (below if order == "combined" else 1000 * below))
        # dealt out by id once, for the ranks and for the features of a row
        pairs = pairs.select("id", "d", "n_id", "km", "_value", F.col(f"n_{y}").alias("label")).repartition(tasks, "id")
        rank = F.row_number().over(W.partitionBy("id", "d").orderBy("_value", "n_id"))
        first = pairs.withColumn("rank", rank).filter(F.col("rank") <= most)
        return first.filter(F.col("rank") <= _asked(slots)).select("id", "n_id", "km", "label", "d", "rank")

    first = _nearest(points, queries, search, ranked, lat, lon)
    found = _features(first, ["id"], wanted)
    means = [f"nn{k}_max{d:g}_target_mean" for k, d in wanted]
    out = df.join(found.withColumnRenamed("id", key) if key != "id" else found, key, "left")
    fills: dict[str, object] = {f"nn{k}_max{d:g}_count": F.lit(0).cast("long") for k, d in wanted}
    if default is not None:
        fills.update({m: default if isinstance(default, Column) else F.lit(float(default)) for m in means})
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in fills.items()})


def _asked(slots: Sequence[Slot]) -> Column:
    """How many rows the slot of column ``d`` wants."""
    k = F.lit(1)
    for slot in slots:
        k = F.when(F.col("d") == slot.code, slot.k).otherwise(k)
    return k


def _bits(slots: Sequence[Slot], want) -> int:
    return sum(1 << i for i, slot in enumerate(slots) if want(slot))


def _nearest(points: DataFrame, queries: DataFrame, search: Search, ranked, lat: str, lon: str) -> DataFrame:
    """The rows of every slot, slot by slot the cheapest way that is certain to be complete."""

    def own(km: float) -> Column:
        return cell_of(lat, lon, km)

    def around(km: float) -> Column:
        return cells_around(lat, lon, km)

    def pairs(refs: DataFrame, some: DataFrame, rings: Sequence[Ring], bound: float | None = None, crowded=None) -> DataFrame:
        return neighbors.candidates(refs, some, rings, replace(search, bound=bound), own, around, lat, lon, crowded)

    slots = search.slots
    radii = sorted({slot.km for slot in slots}, reverse=True)
    todo = queries.withColumn("_open", F.lit(_bits(slots, lambda s: True)).cast("long"))
    done = []
    for km in radii:
        sizes = neighbors.sizes(points, todo, Ring(km), own, around)
        crowded = measured(sizes.filter((F.col("refs") > DIRECT_ROWS) | (F.col("queries") > neighbors.CELL_ROWS)))
        if crowded[1] == 0:
            done.append(ranked(pairs(points, todo, [Ring(km)], crowded=crowded)))
            return reduce(DataFrame.unionByName, done)
        cells = crowded[0].filter(F.col("refs") > DIRECT_ROWS).select(F.col("cell").alias("_cell"), "queries", F.lit(True).alias("_dense"))
        told = lookup(todo.withColumn("_cell", own(km)), cells, "_cell", weight="queries").drop("_cell")
        near = F.lit(_bits(slots, lambda s: s.km <= km)).cast("long")  # noqa: B023
        told = cut_lineage(told.withColumn("_now", F.when(F.col("_dense").isNull(), F.col("_open").bitwiseAND(near)).otherwise(F.lit(0))))
        now = told.filter("_now <> 0").withColumn("_open", F.col("_now")).drop("_now", "_dense")
        if not now.isEmpty():
            done.append(ranked(pairs(points, now, [Ring(km)])))
        todo = told.withColumn("_open", F.col("_open") - F.col("_now")).filter("_open <> 0").drop("_now", "_dense")
    if todo.isEmpty():
        return reduce(DataFrame.unionByName, done)
    if any(search.orders[0][1:]):
        # blocks of near rows are kept by class, so one search finds the slots of all rows and those of the classes
        done += _by_level(points, todo, search, ranked, pairs, own, slots)
        return reduce(DataFrame.unionByName, done)
    # The classes are looked for among their own rows: where one is rare, its rows are few.
    for refs, mine in (
        (points, _bits(slots, lambda s: s.label is None)),
        (points.filter(F.col(search.label) == 1), _bits(slots, lambda s: s.label == 1)),
        (points.filter(F.col(search.label) == 0), _bits(slots, lambda s: s.label == 0)),
    ):
        asked = todo.withColumn("_open", F.col("_open").bitwiseAND(F.lit(mine).cast("long"))).filter("_open <> 0")
        done += _by_level(refs, asked, replace(search, slots=slots), ranked, pairs, own, [s for i, s in enumerate(slots) if mine >> i & 1])
    return reduce(DataFrame.unionByName, done)


def _by_level(refs: DataFrame, asked: DataFrame, search: Search, ranked, pairs, own, slots: Sequence[Slot]) -> list[DataFrame]:
    """Search from small bounds to large ones, and within the radius itself what no bound settles."""
    weights = search.orders[0]
    far, most = max(s.km for s in slots), max(s.k for s in slots)
    prices = {c: w for c, w in zip(search.cats, weights[1:]) if w > 0}
    plain = not any(weights[1:])  # the order is the distance: a level covers its circle
    base = weights[0] * far / 1000.0
    # where numbers count, few of the rows near by are below a bound; blocks of them are ruled out at little cost
    enough = max(2 * most, LEVEL_ROWS) if any(weights[1 + len(search.cats) :]) else 2 * most
    bit = {s.code: 1 << search.slots.index(s) for s in slots}
    done: list[DataFrame] = []

    def bound(j: int) -> float:
        return base / 4.0**j

    def rings(b: float) -> list[Ring]:
        reach = lambda left: min(far, 1000.0 * left / weights[0])
        if not prices:
            return [Ring(reach(b))]
        sets = [x for n in range(len(prices) + 1) for x in combinations(prices, n)]
        return [Ring(reach(left), x) for x in sets if (left := b - sum(prices[c] for c in x)) > 0]

    def key(j: int) -> Column:
        return F.xxhash64(F.lit(j), own(rings(bound(j))[0].km), *[F.col(c).cast("string") for c in prices])

    open_ = asked.withColumn("_level", F.lit(0))
    finest = int(math.log2(far / FINEST_KM) / 2)
    levels = range(1, 7)
    while weights[0] > 0 and levels:
        at = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), key(j).alias("at")) for j in levels])).alias("_k")
        crowded = refs.select(at).groupBy("_k.at").agg(F.count("*").alias("_n")).filter(F.col("_n") >= enough)
        crowded, n = measured(crowded)
        if n == 0:
            break
        told = lookup(asked.select("id", at).select("id", "_k.j", "_k.at"), crowded.withColumn("_met", F.col("_n")), "at", weight="_n", rows=n)
        start = told.filter("_met is not null").groupBy("id").agg(F.max("j").alias("_start"))
        open_ = open_.join(start, "id", "left").withColumn("_level", F.coalesce("_start", "_level")).drop("_start")
        levels = range(levels[-1] + 1, finest + 1)
    open_ = cut_lineage(open_)
    last = 0 if plain else -1  # a bound of four times the base is the largest
    while weights[0] > 0:
        j = open_.agg(F.max("_level")).first()[0]
        if j is None or j < last:
            break
        now, b = open_.filter(F.col("_level") == j), bound(j)
        first = cut_lineage(ranked(pairs(refs, now.drop("_level"), rings(b), b if not plain else None), None if plain and j == 0 else b))
        if plain:
            # inside the level's circle everything is seen
            complete = [s for s in slots if s.km < 1000.0 * b / weights[0] or j == 0]
        else:
            complete = []
        whole = first.groupBy("id", "d").agg(F.count("*").alias("n")).filter(F.col("n") >= _asked(slots)).select("id", "d")
        if complete:
            known = now.select("id", F.explode(F.array(*[F.lit(s.code) for s in complete])).alias("d"))
            whole = whole.union(known).distinct()
        done.append(first.join(whole, ["id", "d"], "left_semi"))
        flag = F.lit(0)
        for s in slots:
            flag = F.when(F.col("d") == s.code, bit[s.code]).otherwise(flag)
        closed = whole.groupBy("id").agg(F.sum(flag.cast("long")).alias("_closed"))
        here = F.col("_level") == j
        left = F.when(here, F.col("_open").bitwiseAND(F.bitwise_not(F.coalesce("_closed", F.lit(0).cast("long"))))).otherwise(F.col("_open"))
        open_ = open_.join(closed, "id", "left").withColumn("_open", left).withColumn("_level", F.when(here, j - 1).otherwise(F.col("_level")))
        open_ = cut_lineage(open_.filter("_open <> 0").drop("_closed"))
    for km in sorted({s.km for s in slots}):
        bits = F.lit(sum(bit[s.code] for s in slots if s.km == km)).cast("long")
        rest = open_.withColumn("_open", F.col("_open").bitwiseAND(bits)).filter("_open <> 0").drop("_level")
        if not rest.isEmpty():
            done.append(ranked(pairs(refs, rest, [Ring(km)])))
    return done


def neighbor_grid_search(
    df: DataFrame,
    cat_sets: Sequence[Sequence[str]],
    num_sets: Sequence[Sequence[str]],
    weightings: Sequence[tuple[float, float, float]],
    k: int = 5,
    km: float = 200.0,
    y: str = "y",
    key: str = "id",
    lat: str = "latitude",
    lon: str = "longitude",
    sample: int | None = None,
    seed: int = 42,
    min_values: int = 10,
) -> DataFrame:
    """Score every (categories, numbers, weights) choice by its best feature correlation.

    Every row looks at its neighbours by distance, for all choices at once, and stops where no farther one can be
    among the first of any choice. The few pairs that are left are ranked per choice next to each other.
    """
    if sample is not None:
        df = seeded_sample(df, sample, key=key, seed=seed)
    cats = list(dict.fromkeys(c for s in cat_sets for c in s))
    nums = list(dict.fromkeys(c for s in num_sets for c in s))
    zs = [f"{c}_z" for c in nums]
    grid, configs = [], list(product(cat_sets, num_sets, weightings))
    for i, (cs, ns, (wg, wc, wn)) in enumerate(configs, start=1):
        row: dict[str, object] = {"config_id": i, "_geo": float(wg)}
        row.update({f"_w_{c}": float(wc) / len(cs) if c in cs else 0.0 for c in cats})
        row.update({f"_w_{z}": float(wn) / len(ns) if c in ns else 0.0 for c, z in zip(nums, zs)})
        grid.append(row)
    base = standardize(df, fit_scaling(df, nums), nums, suffix="_z") if nums else df
    base = base.select(F.col(key).alias("id"), lat, lon, *cats, *zs, F.col(y).alias("y"))
    base = cut_lineage(base.repartition(shuffle_partitions(df.sparkSession), "id"))
    orders = tuple((r["_geo"], *[r[f"_w_{c}"] for c in [*cats, *zs]]) for r in grid)
    slots = [Slot(0.0, float(km), n, i, one) for i in range(len(orders)) for n, one in ((k, None), (1, 1), (1, 0))]
    search = Search(tuple(cats), tuple(zs), orders, tuple(slots), "y", pairs=True)
    located = base.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    # of rows that are equal in all that counts only the first k + 1 can be chosen
    alike = W.partitionBy(lat, lon, *cats, *zs, "y").orderBy("id")
    refs = located.withColumn("_copy", F.row_number().over(alike)).filter(F.col("_copy") <= k + 1).drop("_copy")
    refs = cut_lineage(refs.repartition(shuffle_partitions(df.sparkSession), "id"))
    pairs = neighbors.candidates(
        refs, located.withColumn("_open", F.lit(0).cast("long")), [Ring(float(km))], search,
        lambda r: cell_of(lat, lon, r), lambda r: cells_around(lat, lon, r), lat, lon,
    )
    pairs = pairs.withColumn("km", haversine_km(lat, lon, f"n_{lat}", f"n_{lon}")).filter(F.col("km") <= km)
    terms = [F.expr(f"if({c} <=> n_{c}, 0D, 1D)").alias(c) for c in cats] + [F.expr(f"abs({z} - n_{z})").alias(z) for z in zs]
    pairs = pairs.select("id", "n_id", F.col("n_y").alias("y"), "km", *terms)
    # a row of its own for every row, whether it has neighbours or not
    void = F.lit(None).cast("double")
    alone = base.select("id", F.lit(None).cast(dict(base.dtypes)["id"]).alias("n_id"), F.col("y").cast("double"), *[void.alias(c) for c in ("km", *cats, *zs)])
    both = pairs.union(alone).repartition(shuffle_partitions(df.sparkSession), "id").sortWithinPartitions("id", F.asc_nulls_first("n_id"))
    features = ["target_mean", "count", "dist_mean", "positive", "negative"]
    schema = ", ".join(["config_id int", "y double", *[f"{c} double" for c in features]])
    wide = both.mapInArrow(_configurations(orders, [*cats, *zs], k), schema)
    scores = wide.groupBy("config_id").agg(
        *[F.when(F.count(c) > min_values, F.abs(pearson(c, "y"))).alias(c) for c in features]
    )
    best = scores.select("config_id", F.coalesce(F.greatest(*features), F.lit(0.0)).alias("best_corr"))
    named = [
        {
            "config_id": i, "cat_cols": ", ".join(cs) or "none", "num_cols": ", ".join(ns) or "none",
            "weight_geo": float(wg), "weight_cat": float(wc), "weight_num": float(wn),
        }
        for i, (cs, ns, (wg, wc, wn)) in enumerate(configs, start=1)
    ]
    return best.withColumn("_c", F.get(grid_literal(named), F.col("config_id").cast("int") - 1)).select(
        "_c.*", "best_corr"
    )


def _configurations(orders: Sequence[Sequence[float]], terms: Sequence[str], k: int):
    """Features of every row under every choice of weights, from its candidate pairs (sorted by id).

    Rows with about as many pairs lie in one matrix, a row of it for each, and the first of a choice are taken out one by one:
    the least value, and of equal ones the first by id.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in neighbors.whole_groups(batches, ("id",)):
            value = {c: table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "y", "km", *terms)}
            ids = value["id"]
            group = np.cumsum(np.concatenate([[False], ids[1:] != ids[:-1]]))
            pair = ~np.isnan(value["km"])
            n = int(group[-1]) + 1
            own = np.full(n, np.nan)
            own[group[~pair]] = value["y"][~pair]
            at = np.flatnonzero(pair)
            size = np.bincount(group[at], minlength=n)
            begin = np.cumsum(size) - size
            by_size = np.argsort(size, kind="stable")
            features = np.full((len(orders), 5, n), np.nan)
            features[:, 1] = 0.0
            first = int(np.searchsorted(size[by_size], 1))
            while first < n:
                # as many rows as fit beside the first, not much wider than it
                widest = max(2 * int(size[by_size[first]]), 16)
                last = max(first + 1, int(np.searchsorted(size[by_size], widest, side="right")))
                last = min(last, first + max(1, SLAB // widest))
                rows, first = by_size[first:last], last
                width = int(size[rows].max())
                real = np.arange(width) < size[rows, None]
                index = at[np.where(real, begin[rows, None] + np.arange(width), 0)]
                features[:, :, rows] = ranked({c: value[c][index] for c in ("y", "km", *terms)}, real, size[rows])
            for number in range(len(orders)):
                arrays = [pa.array(c, mask=np.isnan(c)) for c in (own, *features[number])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number + 1, np.int32)), *arrays], names=["config_id", "y", *[f"f{i}" for i in range(5)]]
                )

    def ranked(value: dict[str, np.ndarray], real: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Label mean, number, mean distance and distances to the first of both labels, by order and row."""
        km, label, line = value["km"], value["y"], np.arange(len(size))
        out = np.empty((len(orders), 5, len(size)))
        count = np.minimum(size, k)
        absent = np.where(real, 0.0, np.inf)
        others = [np.where(real & (label == one), 0.0, np.inf) for one in (1, 0)]
        scaled: dict[tuple[str, float], np.ndarray] = {}
        for number, (first, *rest) in enumerate(orders):
            if ("km", first) not in scaled:
                scaled["km", first] = first * km / 1000
            mixed = scaled["km", first]
            for w, c in zip(rest, terms):
                if w:
                    if (c, w) not in scaled:
                        scaled[c, w] = w * value[c]
                    mixed = mixed + scaled[c, w]
            mixed = np.round(mixed, 12)
            np.copyto(mixed, neighbors.UNKNOWN, where=~(mixed < neighbors.UNKNOWN))
            for slot, other in enumerate(others):
                its = mixed + other
                nearest = its.argmin(axis=1)
                out[number, 3 + slot] = np.where(its[line, nearest] < np.inf, km[line, nearest], np.nan)
            mixed += absent
            means = np.zeros(len(size)), np.zeros(len(size))
            for place in range(min(k, mixed.shape[1])):
                nearest = mixed.argmin(axis=1)
                inside = place < count
                for total, x in zip(means, (label, km)):
                    total += np.where(inside, x[line, nearest], 0.0)
                mixed[line, nearest] = np.inf
            out[number, 0], out[number, 1], out[number, 2] = means[0] / count, count, means[1] / count
        return out

    return score


def k_distance_sweep(
    features: DataFrame, y: str, ks: Sequence[int], dists: Sequence[float], min_values: int = 10
) -> DataFrame:
    """Absolute correlation and coverage of the label mean for every (k, radius): one aggregate."""
    wanted = pair_grid(ks, dists)
    names = [f"nn{k}_max{d:g}_target_mean" for k, d in wanted]
    wide = features.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.abs(pearson(c, y)).alias("correlation"),
                F.avg(F.col(c).isNotNull().cast("double")).alias("coverage"),
            ).alias(c)
            for c in names
        ]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"), F.lit(float(d)).alias("max_dist"), F.col(f"{c}.n").alias("n"),
                F.col(f"{c}.correlation").alias("correlation"), F.col(f"{c}.coverage").alias("coverage"),
            )
            for (k, d), c in zip(wanted, names)
        ]
    )
    return wide.select(F.inline(cells)).filter(F.col("n") > min_values).drop("n")

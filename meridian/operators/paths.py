"""Whole paths: reconstruction, discrete Frechet distance, density clusters and their medoids."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.shared import stored
from . import chunks
from .components import components


def reconstruct(pings: DataFrame, route: str, tie: str) -> DataFrame:
    """(route, path): each route's places in order of time, as array of struct<lng, lat>."""
    ordered = F.sort_array(F.collect_list(F.struct("event_time", tie, "lng", "lat")))
    path = F.transform(ordered, lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat")))
    return pings.groupBy(route).agg(path.alias("path"))


def reconstruct_chunks(pings: DataFrame, route: str, tie: str, most: int = chunks.MOST) -> DataFrame:
    """(route, part, path): reconstruct() in rows of at most ``most`` places; joined in order of part they are the path."""
    return chunks.chunked(pings.select(route, "event_time", tie, "lng", "lat"), route, ["event_time", tie, "lng", "lat"], F.struct("lng", "lat"), "path", most)


def frechet_m(a: Column, b: Column) -> Column:
    """Discrete Frechet distance in metres of two paths, row by row of the coupling table; null if one is empty."""

    def metres(p: Column, q: Column) -> Column:
        return geo.distance_m(p["lat"], p["lng"], q["lat"], q["lng"])

    def row(above: Column, p: Column) -> Column:
        first = F.size(above) == 0

        def cell(done: Column, j: Column) -> Column:
            left = F.get(done, j - 1)
            best = F.when(first & (j == 0), F.lit(0.0)).when(first, left).when(j == 0, F.get(above, j)).otherwise(F.least(left, F.get(above, j), F.get(above, j - 1)))
            return F.concat(done, F.array(F.greatest(best, metres(p, F.get(b, j)))))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array().cast("array<double>"), cell)

    table = F.aggregate(a, F.array().cast("array<double>"), row)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.get(table, F.size(b) - 1))


#: coupling-table cells that are filled at once (a diagonal of each table), and pairs of paths at most
CELLS, PAIRS = 1 << 15, 1024
#: diagonals after which pairs that are too far are given up
GIVE_UP = 16


def _globe(path: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(3, places) coordinates on the globe in metres, and the paths' offsets."""
    lat, lng = (np.radians(path.values.field(c).to_numpy(zero_copy_only=False)) for c in ("lat", "lng"))
    xyz = geo.EARTH_RADIUS_M * np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)])
    return xyz, path.offsets.to_numpy().astype(np.int64)


def _padded(xyz: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(3, longest, rows) coordinates of some paths; the last place of a shorter one is repeated, which changes no distance."""
    size = offsets[rows + 1] - offsets[rows]
    return xyz[:, offsets[rows] + np.minimum(np.arange(size.max())[:, None], size - 1)]


def _straight(metres: float) -> float:
    """The squared straight line through the globe of a distance along its surface."""
    return (2 * geo.EARTH_RADIUS_M * np.sin(min(metres / geo.EARTH_RADIUS_M, np.pi) / 2)) ** 2


def _curved(squared: np.ndarray) -> np.ndarray:
    return 2 * geo.EARTH_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(squared) / (2 * geo.EARTH_RADIUS_M)))


def _fill(new: np.ndarray, older: np.ndarray, last: np.ndarray, p: np.ndarray, q: np.ndarray, lo: int, hi: int, k: int) -> None:
    """Diagonal k of coupling tables, rows lo to hi, from the two before it; p and q: the places that meet there."""
    lines = p - q
    lines *= lines
    squared = np.add(lines[0], lines[1], out=lines[0])
    squared += lines[2]
    cells = new[lo + 1 : hi + 1]
    if k:
        np.minimum(last[lo:hi], last[lo + 1 : hi + 1], out=cells)
        np.minimum(cells, older[lo:hi], out=cells)
        np.maximum(cells, squared, out=cells)
    else:
        cells[:] = squared
    # what an earlier diagonal left there
    new[lo] = np.inf


def frechet_many(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most_m: float) -> np.ndarray:
    """Discrete Frechet distances (nan: over most_m) of pairs of paths, row i of a (or its only path) to row i of b.

    The coupling tables of a block of pairs are filled together, one anti-diagonal at a time.
    Straight lines through the globe order as distances along its surface do. Pairs whose last
    two diagonals are too far are given up.
    """
    n, out = len(b[1]) - 1, np.full(len(b[1]) - 1, np.nan)
    size = np.maximum(np.diff(a[1]), np.diff(b[1]))
    order = np.argsort(size, kind="stable")
    most = _straight(most_m)
    at = 0
    while at < n:
        longest = size[order[min(at + PAIRS, n) - 1]]
        rows = order[at : at + max(1, min(PAIRS, CELLS // longest))]
        at += len(rows)
        p, q = _padded(*a, np.minimum(rows, len(a[1]) - 2)), _padded(*b, rows)[:, ::-1]
        rows_p, rows_q = p.shape[1], q.shape[1]
        # at i + 1: the diagonal's cell in row i
        older, last, new = (np.full((rows_p + 1, len(rows)), np.inf) for _ in range(3))
        for k in range(rows_p + rows_q - 1):
            lo, hi = max(0, k - rows_q + 1), min(k, rows_p - 1) + 1
            _fill(new, older, last, p[:, lo:hi], q[:, rows_q - 1 - k + lo : rows_q - 1 - k + hi], lo, hi, k)
            older, last, new = last, new, older
            if k % GIVE_UP == GIVE_UP - 1:
                live = np.minimum(older[lo:].min(0), last[lo:].min(0)) <= most
                if not live.all():
                    rows, p, q, older, last, new = rows[live], p[:, :, live], q[:, :, live], older[:, live], last[:, live], new[:, live]
                    if not len(rows):
                        break
        found = last[rows_p] if len(rows) else np.zeros(0)
        good = found <= most
        out[rows[good]] = _curved(found[good])
    return out


def _only(paths: tuple[np.ndarray, np.ndarray], i: int) -> tuple[np.ndarray, np.ndarray]:
    xyz, offsets = paths
    return xyz[:, offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i]


def _two_sides(group: pa.Table) -> Iterator[tuple[pa.Array, tuple[np.ndarray, np.ndarray]]]:
    """Ids and places on the globe of the paths that are ``mine``, then of the others."""
    mine = group.column("mine")
    for side in (group.filter(mine), group.filter(pc.invert(mine))):
        yield side.column("r").combine_chunks(), _globe(side.column("path").combine_chunks())


def _corner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared straight lines that no coupling of pairs of paths stays below, from the first places of both, (3, depth, pairs); b's last come first.

    Every coupling goes through the coupling table's first diagonals, and so through one of the last two of them.
    """
    depth = b.shape[1]
    older, last, new = (np.full((depth + 1, b.shape[2]), np.inf) for _ in range(3))
    for k in range(depth):
        _fill(new, older, last, a[:, : k + 1], b[:, depth - 1 - k :], 0, k + 1, k)
        older, last, new = last, new, older
    return np.minimum(older.min(0), last.min(0))


def _both_ends(xyz: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places, (3, depth, paths) from each end, of paths that _ends_only() has cut."""
    inward = np.minimum(np.arange(depth)[:, None], np.diff(offsets) // 2 - 1)
    return xyz[:, offsets[:-1] + inward], xyz[:, offsets[1:] - 1 - inward]


AXES = "xyz"


def _located(paths: DataFrame, route: str) -> DataFrame:
    """(r, path) of the paths that have places with coordinates, and these alone."""
    known = F.filter("path", lambda p: p["lat"].isNotNull() & p["lng"].isNotNull())
    return paths.select(F.col(route).alias("r"), known.alias("path")).filter(F.size("path") > 0)


def _on_globe(p: Column) -> Column:
    radius, lat, lng = F.lit(float(geo.EARTH_RADIUS_M)), F.radians(p["lat"]), F.radians(p["lng"])
    return F.struct((radius * F.cos(lat) * F.cos(lng)).alias("x"), (radius * F.cos(lat) * F.sin(lng)).alias("y"), (radius * F.sin(lat)).alias("z"))


def _cell(p: Column, width: float) -> Column:
    return F.struct(*[F.floor(p[c] / width).alias(c) for c in AXES])


def _sides(located: DataFrame, most_m: float) -> DataFrame:
    """(r, box, cell): every cell that a path has places in; box: bounds, start and end."""
    sides = located.withColumn("at", F.transform("path", _on_globe))
    first, last = F.get("at", F.lit(0)), F.get("at", F.size("at") - 1)
    box = F.array(*[end(F.col("at")[c]) for c in AXES for end in (F.array_min, F.array_max)], *[p[c] for c in AXES for p in (first, last)])
    cells = F.array_distinct(F.transform("at", lambda p: _cell(p, _wide(most_m))))
    return stored(sides.select("r", box.alias("box"), F.explode(cells).alias("cell")), "path-cells")


def _wide(most_m: float) -> float:
    """A hair wider, for rounding."""
    return most_m + 0.01


def _probes(sides: DataFrame, among: DataFrame) -> DataFrame:
    """(r, box_a, cell): the rarest cell of each path of sides, and those around it; rare among the paths of ``among``."""
    often = among.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    ranked = sides.join(often, "cell").groupBy("r").agg(F.min(F.struct("n", "cell")).alias("rarest"), F.first("box").alias("box_a"))
    steps = product((-1, 0, 1), repeat=3)
    around = F.array(*[F.struct(*[(F.col(f"rarest.cell.{c}") + i).alias(c) for c, i in zip(AXES, by, strict=True)]) for by in steps])
    return ranked.select("r", "box_a", F.explode(around).alias("cell"))


def _boxes_near(most_m: float) -> Column:
    near = F.lit(True)
    for i in range(12):
        near &= F.abs(F.get("box_a", F.lit(i)) - F.get("box_b", F.lit(i))) <= _wide(most_m)
    return near


def _verified(pairs: DataFrame, located: DataFrame, most_m: float) -> DataFrame:
    """(a, b, metres) of the pairs (a, b) within a Frechet distance."""
    # few bytes but much work, so by number and not by size
    tasks = 4 * pairs.sparkSession.sparkContext.defaultParallelism
    whole = pairs.join(located.select(F.col("r").alias("a"), F.col("path").alias("pa")), "a").join(located.select(F.col("r").alias("b"), F.col("path").alias("pb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                found = frechet_many(_globe(part.column(2)), _globe(part.column(3)), most_m)
                kept = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], names=["a", "b", "metres"])
                yield kept.filter(pa.array(~np.isnan(found)))

    kind = located.schema["r"].dataType.simpleString()
    return whole.select("a", "b", "pa", "pb").repartition(tasks, "a", "b").mapInArrow(run, f"a {kind}, b {kind}, metres double")


def similar(paths: DataFrame, route: str, most_m: float) -> DataFrame:
    """(a, b, metres): routes a < b within a Frechet distance.

    In coordinates on the globe in metres, cut in cells of that width, every place of one of
    two paths so close lies in or next to a cell of the other. So the rarest cell of the first
    is enough to find the second: it is looked up, with its neighbours, among the cells of
    all paths (none is lost; a cell that many paths share is asked for only by paths
    that have no rarer one). What is found is told apart by starts, ends and bounding boxes
    before the paths are fetched. Places without coordinates are left out.
    """
    located = _located(paths, route)
    sides = _sides(located, most_m)
    right = sides.select(F.col("r").alias("b"), F.col("box").alias("box_b"), "cell")
    found = _probes(sides, sides).withColumnRenamed("r", "a").join(right, "cell").filter((F.col("a") < F.col("b")) & _boxes_near(most_m))
    return _verified(found.select("a", "b").distinct(), located, most_m)


#: paths of like ends that the others of their kind are compared with
PIVOTS = 8


def _near_pivots(keyed: DataFrame, kinds: DataFrame, most_m: float) -> DataFrame:
    """(a, b) of paths (r, ends, path) in reach of pivots of their kind.

    Blocks of a kind's paths get its pivots, so a path is shuffled once and not once a pair.
    """
    parts = keyed.groupBy("ends").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    # a path is copied to every block of its kind if it is a pivot
    pivots = kinds.select(F.explode("pivots").alias("r")).join(keyed, "r").join(parts, "ends")
    pivots = pivots.select("ends", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("mine"), "r", "path")
    rest = keyed.join(parts, "ends").select("ends", F.pmod(F.xxhash64("r"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("mine"), "r", "path")
    kind = keyed.schema["r"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        (firsts, a), (seconds, b) = _two_sides(group)
        found = [(seconds.filter(pa.array(~np.isnan(frechet_many(_only(a, i), b, most_m)))), firsts[i]) for i in range(len(firsts))]
        near = [(pa.repeat(pivot, len(to)), to) for to, pivot in found]
        return pa.table({"a": pa.chunked_array([x for x, _ in near], firsts.type), "b": pa.chunked_array([y for _, y in near], firsts.type)})

    tasks = 4 * keyed.sparkSession.sparkContext.defaultParallelism
    near = pivots.union(rest).repartition(tasks, "ends", "part").groupBy("ends", "part").applyInArrow(run, f"a {kind}, b {kind}")
    return near.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def balls(located: DataFrame, most_m: float, fewest: int) -> DataFrame:
    """(r, ball): paths that are known to be cores, by the cluster that they are known to share, named by its least.

    Of the paths with start and end in the same cells a few, dealt out by a hash, are
    pivots: each path is compared with these, and one pivot of each kind with those of
    other kinds in reach. So work and tables grow with the paths, not with their pairs. What
    is found are links; a path with links to ``fewest`` paths, itself included, is a core
    whatever else there is, and linked cores are in one cluster.
    """
    ends = [_cell(_on_globe(F.get("path", at)), most_m) for at in (F.lit(0), F.size("path") - 1)]
    keyed = located.select("r", F.struct(*[e.alias(n) for e, n in zip(ends, ("start", "stop"), strict=True)]).alias("ends"))
    dealt = F.pmod(F.xxhash64("r"), F.lit(PIVOTS))
    least = F.array_compact(F.array(*[F.min(F.when(dealt == k, F.col("r"))) for k in range(PIVOTS)]))
    kinds = stored(keyed.groupBy("ends").agg(least.alias("pivots")), "kinds")
    near = _near_pivots(keyed.join(located, "r"), kinds, most_m)
    firsts = located.join(kinds.select(F.get("pivots", F.lit(0)).alias("r")), "r", "left_semi")
    links = stored(near.union(similar(firsts, "r", most_m).select("a", "b")).distinct(), "pivot-links")
    both = links.union(links.select("b", "a"))
    cores = stored(both.groupBy(F.col("a").alias("r")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") + 1 >= fewest).select("r"), "known-cores")
    inner = links.join(cores.select(F.col("r").alias("a")), "a", "left_semi").join(cores.select(F.col("r").alias("b")), "b", "left_semi")
    roots = components(inner, "a", "b").select(F.col("node").alias("r"), "root")
    return cores.join(roots, "r", "left").select("r", F.coalesce("root", "r").alias("ball"))


def links_outside_balls(located: DataFrame, members: DataFrame, most_m: float) -> tuple[DataFrame, DataFrame]:
    """(links of paths outside the balls with any path, links between paths of different balls), each (a, b).

    Paths of two balls are compared only where a path's rarest cell, or one next to it, is a cell
    of the other ball.
    """
    sides = _sides(located, most_m)
    outside = sides.join(members.select("r"), "r", "left_anti")
    right = sides.join(members, "r", "left").select(F.col("r").alias("b"), F.col("box").alias("box_b"), "cell", F.col("ball").alias("other"))
    once = (F.col("r") != F.col("b")) & (F.col("other").isNotNull() | (F.col("r") < F.col("b")))
    found = _probes(outside, sides).join(right, "cell").filter(once & _boxes_near(most_m))
    ends = [F.least("r", "b").alias("a"), F.greatest("r", "b").alias("b")]
    loose = stored(_verified(found.select(*ends).distinct(), located, most_m).select("a", "b"), "loose-links")
    inside = right.filter("other is not null")
    meeting = _probes(sides.join(members, "r", "left_semi"), sides).join(members, "r").join(inside.select("cell", "other").distinct(), "cell").filter("ball < other")
    pairs = meeting.join(inside, ["cell", "other"]).filter(_boxes_near(most_m)).select(*ends).distinct()
    return loose, _verified(pairs, located, most_m).select("a", "b")


def dense_clusters(paths: DataFrame, route: str, most_m: float, fewest: int = 3) -> DataFrame:
    """(route, cluster): clusters() of similar() paths, without the pairs inside balls.

    Paths of a ball are cores of one cluster whatever else there is, so a hub of N paths
    takes PIVOTS times N comparisons. The others' neighbours are found and counted exactly.
    """
    located = stored(_located(paths, route), "located")
    members = stored(balls(located, most_m, fewest), "members")
    loose, between = links_outside_balls(located, members, most_m)
    both = loose.select(F.col("a").alias("r"), F.col("b").alias("o")).union(loose.select(F.col("b").alias("r"), F.col("a").alias("o")))
    counted = both.groupBy("r").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") + 1 >= fewest).select("r")
    if fewest <= 1:
        counted = located.select("r")
    cores = stored(counted.union(members.select("r")).distinct(), "cores")
    inner = loose.join(cores.select(F.col("r").alias("a")), "a", "left_semi").join(cores.select(F.col("r").alias("b")), "b", "left_semi")
    spokes = members.filter("r <> ball").select(F.col("ball").alias("a"), F.col("r").alias("b"))
    roots = components(inner.select("a", "b").union(between).union(spokes), "a", "b").select(F.col("node").alias("r"), "root")
    named = stored(cores.join(roots, "r", "left").select("r", F.coalesce("root", "r").alias("cluster")), "named")
    edge = both.join(cores, "r", "left_anti").join(named.select(F.col("r").alias("o"), "cluster"), "o").groupBy("r").agg(F.min("cluster").alias("cluster"))
    return paths.select(F.col(route).alias("r")).distinct().join(named.union(edge), "r", "left").select(F.col("r").alias(route), "cluster")


def clusters(routes: DataFrame, links: DataFrame, route: str, fewest: int = 3) -> DataFrame:
    """(route, cluster): density clusters over links (a, b) of routes within reach; null cluster: noise.

    A route with ``fewest`` routes in reach, itself included, is a core; cores in reach of
    each other share a cluster, named by its least core; others join the least cluster
    that they touch. Routes are longs.
    """
    both = links.select(F.col("a").alias("r"), F.col("b").alias("o")).union(links.select(F.col("b").alias("r"), F.col("a").alias("o")))
    cores = both.groupBy("r").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") + 1 >= fewest).select("r")
    if fewest <= 1:
        cores = routes.select(F.col(route).alias("r"))
    inner = links.join(cores.select(F.col("r").alias("a")), "a", "left_semi").join(cores.select(F.col("r").alias("b")), "b", "left_semi")
    roots = components(inner, "a", "b").select(F.col("node").alias("r"), "root")
    named = cores.join(roots, "r", "left").select("r", F.coalesce("root", "r").alias("cluster"))
    edge = both.join(cores, "r", "left_anti").join(named.select(F.col("r").alias("o"), "cluster"), "o").groupBy("r").agg(F.min("cluster").alias("cluster"))
    return routes.select(F.col(route).alias("r")).distinct().join(named.union(edge), "r", "left").select(F.col("r").alias(route), "cluster")


def medoids(members: DataFrame, links: DataFrame, route: str) -> DataFrame:
    """(cluster, route, n): each cluster's size and the route with most links inside it, of these the nearest on average."""
    both = links.select(F.col("a").alias("r"), F.col("b").alias("o"), "metres").union(links.select(F.col("b").alias("r"), F.col("a").alias("o"), "metres"))
    inside = members.filter("cluster is not null").select(F.col(route).alias("r"), "cluster")
    other = inside.select(F.col("r").alias("o"), F.col("cluster").alias("c2"))
    scored = both.join(inside, "r").join(other, "o").filter("cluster = c2").groupBy("cluster", "r").agg(F.count(F.lit(1)).alias("links"), F.avg("metres").alias("mean"))
    best = scored.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("links"), "mean", "r"))).filter("rn = 1")
    sizes = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return best.join(sizes, "cluster").select("cluster", F.col("r").alias(route), "n")


#: paths of a block, of whose pairs of blocks each is one task's work (only ends are compared in blocks four times as large)
BLOCK = 1024
#: so many places from both ends bound a distance, one look after the other
DEPTHS = (1, 8, 24)
#: paths that are measured after each look, and the size up to which a cluster's paths are all measured
FIRST, FEW = 4, 256


def _ends_only(path: Column, depth: int) -> Column:
    """At most ``depth`` places from the start, then as many that end the path."""
    return F.concat(F.slice(path, 1, depth), F.slice(path, F.greatest(F.size(path) - depth, F.lit(0)) + 1, depth))


def _scored(tried: DataFrame, inside: DataFrame, most_m: float, depth: int | None = None) -> DataFrame:
    """(cluster, r, links, nm) of the paths tried (cluster, r): links to paths of the cluster and their lengths' sum, in whole nanometres.

    With ``depth`` only so many places from both ends are looked at: links are then at
    least as many as there are, and nm is at most the sum if they are as many. Pairs are
    made and summed in blocks, so only paths and sums are shuffled.
    """
    block = 4 * BLOCK if depth == 1 else BLOCK
    path = F.col("path") if depth is None else _ends_only(F.col("path"), depth).alias("path")
    counts = [rows.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name)) for rows, name in ((tried, "ones"), (inside, "twos"))]
    parts = counts[0].join(counts[1], "cluster")

    def dealt(rows: DataFrame, own: str, other: str, mine: bool) -> DataFrame:
        places = {own: F.pmod(F.xxhash64("r"), F.col(f"{own}s")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))}
        return rows.select("cluster", "r", path).join(parts, "cluster").select("cluster", *[places[c].alias(c) for c in ("one", "two")], F.lit(mine).alias("mine"), "r", "path")

    def run(group: pa.Table) -> pa.Table:
        (ids_a, a), (ids_b, b) = ((ids.to_numpy(), places) for ids, places in _two_sides(group))
        links, nm = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_a), np.int64)
        if depth is not None:
            (heads_a, tails_a), (heads_b, tails_b) = _both_ends(*a, depth), (np.ascontiguousarray(x[:, ::-1]) for x in _both_ends(*b, depth))
        for i in range(len(ids_a)):
            if depth is None:
                metres = frechet_many(_only(a, i), b, most_m)
            else:
                metres = _curved(np.maximum(_corner(heads_a[:, :, i : i + 1], heads_b), _corner(tails_a[:, :, i : i + 1], tails_b)))
                metres[metres > _wide(most_m)] = np.nan
            near = ~np.isnan(metres) & (ids_b != ids_a[i])
            links[i], nm[i] = near.sum(), np.floor(metres[near] * 1e9).astype(np.int64).sum()
        first = group.column("cluster").slice(0, 1).combine_chunks()
        return pa.table({"cluster": pa.repeat(first[0], len(ids_a)), "r": ids_a, "links": links, "nm": nm})

    rows = dealt(tried.join(inside, ["cluster", "r"]), "one", "two", True).union(dealt(inside, "two", "one", False))
    # few bytes but much work, so by number and not by size
    tasks = 4 * tried.sparkSession.sparkContext.defaultParallelism
    summed = rows.repartition(tasks, "cluster", "one", "two").groupBy("cluster", "one", "two").applyInArrow(run, "cluster long, r long, links long, nm long")
    return summed.groupBy("cluster", "r").agg(F.sum("links").alias("links"), F.sum(F.col("nm").cast("decimal(20,0)")).cast("decimal(38,0)").alias("nm"))


def central(members: DataFrame, paths: DataFrame, route: str, most_m: float) -> DataFrame:
    """(cluster, route, n): medoids() of members (route, cluster) by similar() paths, without a table of all links.

    Ends alone bound how many links a path can have and how short they can be, so most
    paths can't be their cluster's medoid. Looks at more and more places from both ends
    leave fewer paths; after each those that promise most are measured, and paths are
    dropped that are worse by their bounds than one measured. Those left are measured
    against the whole cluster. Routes are longs.
    """
    of = members.filter("cluster is not null").select(F.col(route).alias("r"), "cluster")
    inside = stored(_located(paths, route).join(of, "r").select("cluster", "r", "path"), "inside")
    sizes = stored(inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "sizes")
    large = sizes.filter(F.col("n") > FEW)
    left, measured = inside.select("cluster", "r"), None
    if not large.isEmpty():
        few = left.join(large, "cluster", "left_anti")
        left = left.join(large, "cluster", "left_semi")
        promise = Window.partitionBy("cluster").orderBy(F.desc("links"), "nm", "r")
        for depth in DEPTHS:
            bounds = stored(_scored(left, inside, most_m, depth), "bounds")
            first = bounds.withColumn("rn", F.row_number().over(promise)).filter(F.col("rn") <= FIRST)
            now = stored(_scored(first.select("cluster", "r"), inside, most_m), "measured")
            measured = now if measured is None else measured.union(now)
            best = measured.groupBy("cluster").agg(F.min(F.struct((-F.col("links")).alias("links"), "nm")).alias("best"))
            # a micrometre a link for rounding
            longer = F.col("nm") - F.col("best.nm") > 1000 * F.col("links")
            better = (F.col("links") > -F.col("best.links")) | ((F.col("links") == -F.col("best.links")) & ~longer)
            left = bounds.join(best, "cluster").filter(better).join(measured, "r", "left_anti").select("cluster", "r")
        left = left.union(few)
    scored = _scored(left, inside, most_m)
    if measured is not None:
        scored = scored.union(measured)
    best = scored.filter("links > 0").groupBy("cluster").agg(F.min(F.struct((-F.col("links")).alias("links"), "nm", "r")).alias("best"))
    return best.join(sizes, "cluster").select("cluster", F.col("best.r").alias(route), "n")

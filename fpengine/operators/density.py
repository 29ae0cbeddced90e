"""Density hierarchy (ML1, ML3-ML5): clusters of different density, from one parameter, the smallest cluster.

1. Equal vectors collapse to one weighted point. Points are dealt to blocks of a few hundred to ``BLOCK`` neighbours (nearest of at
   most ``MAX_CELLS`` pivots, large cells split by hash). All distances are computed inside tiles of two blocks, by
   numpy; a tile gives back a few rows per point, and no table of pairs exists.
2. Core distance of a point: the distance within which ``min_samples`` members (itself counted) lie. The own block gives an upper bound; tiles of
   two blocks whose cells are farther apart than the bounds of both are left out.
3. Links: per tile the minimum spanning tree under mutual reachability, max(core a, core b, distance). A link that no tile keeps is the
   heaviest of a cycle, so the union of these trees holds the minimum spanning tree of all points. Equal weights are ordered by the ids of the link,
   which makes that tree unique. A block's own tree is built once; its links bound from above at which level a point reaches the tree's root. Between
   two blocks only links no heavier than the bound of one of their ends can matter, and the lightest of all others. A matrix
   product tells most pairs apart; the distances of the few left are then computed exactly.
4. Contraction rounds in the manner of Boruvka: every vertex below the smallest cluster size looks at its lightest link. Two that
   choose the same link merge; one whose link leads to a large vertex falls in at that level; its other links, all heavier, move along.
   Rounds go on until at most ``local_links`` links are left (none need be); that rest, or a small table from the start, is
   merged in link order in one task per group.
5. Merges of two large sides form the condensed tree. Stabilities are sums over points; clusters are chosen from the leaves up by larger stability (a
   tree's root is never one). Points below a chosen cluster get its number, others -1; a group of noise alone is cluster 0.

Numbers are dense per group, in the order of the smallest member id. Null vectors and ids are left out; vectors of one call have one length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_tables, stage_table
from .relational import lookup
from .windows import distributed_row_number

BLOCK = 1536
MAX_CELLS = 256
PIVOT_SAMPLE = 2048
PIVOT_ROUNDS = 5
PAIRS = 200_000  # pairs whose distances are computed at once
LOCAL_LINKS = 200_000
FLOOR = 1e-9  # levels below this count as this, so that copies have a finite density


def pair_distances(x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows. Each entry is summed in the order of its own row, so a pair has the same value in every tile."""
    out = np.empty((len(x), len(x)))
    for i in range(len(x)):
        out[i] = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    return out


def some_distances(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The entries (a, b) of ``pair_distances``, to the last bit."""
    out = np.empty(len(a))
    for i in range(0, len(a), PAIRS):
        out[i:i + PAIRS] = np.sqrt(((x[a[i:i + PAIRS]] - x[b[i:i + PAIRS]]) ** 2).sum(axis=1))
    return out


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of the rows of ``x`` and ``y`` by a matrix product, and how far rounding may take one off."""
    mid = x.mean(axis=0)
    x, y = x - mid, y - mid
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = np.column_stack([x, xx, np.ones(len(x))]) @ np.column_stack([-2 * y, np.ones(len(y)), yy]).T
    return out, 1e-14 * (x.shape[1] + 6) * float(xx.max() + yy.max())


def forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the links (a < b, of n vertices) that the minimum spanning forest keeps, ties by (a, b): rounds of Boruvka on the links in order."""
    order = np.lexsort((b, a, w))
    comp, kept, u, v, at = np.arange(n), [], a[order], b[order], order
    while True:
        cu, cv = comp[u], comp[v]
        open_ = cu != cv
        u, v, at, cu, cv = u[open_], v[open_], at[open_], cu[open_], cv[open_]
        if not len(u):
            return np.unique(np.concatenate(kept)) if kept else np.zeros(0, dtype=np.int64)
        first = np.full(n, len(u))
        rank = np.arange(len(u))
        np.minimum.at(first, cu, rank)
        np.minimum.at(first, cv, rank)
        tip = np.flatnonzero(first < len(u))
        pick = first[tip]
        kept.append(at[pick])
        to = np.arange(n)
        to[tip] = np.where(cu[pick] == tip, cv[pick], cu[pick])
        both = (to[to] == np.arange(n)) & (np.arange(n) < to)  # two that chose the same link: the smaller is the root
        to[both] = np.flatnonzero(both)
        while (to[to] != to).any():
            to = to[to]
        comp = to[comp]


def spanning_links(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of a full symmetric matrix whose rows are in the order of their ids: (low, high, weight), ties by (low, high)."""
    n = len(weight)
    idx = np.arange(n)
    best, low, high = weight[0].copy(), np.zeros(n, dtype=np.int64), idx.copy()
    out = np.zeros(n, dtype=bool)
    out[0] = True
    best[0] = np.inf
    got = []
    for _ in range(n - 1):
        m = best[~out].min()
        tie = np.flatnonzero((best == m) & ~out)
        v = tie[np.argmin(low[tie] * n + high[tie])] if len(tie) > 1 else tie[0]
        got.append((low[v], high[v], m))
        out[v] = True
        lo, hi = np.minimum(v, idx), np.maximum(v, idx)
        better = ~out & ((weight[v] < best) | ((weight[v] == best) & (lo * n + hi < low * n + high)))
        best[better], low[better], high[better] = weight[v][better], lo[better], hi[better]
    a, b, w = zip(*got) if got else ((), (), ())
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(w, dtype=float)


def _with_blocks(points: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Points (g, pid, w, vec) with cell, distance to its pivot and block; and the distances between pivots."""
    n = points.count()
    cells = int(min(MAX_CELLS, max(1, -(-n // BLOCK))))
    share = max(1, n // PIVOT_SAMPLE)  # the sample is between PIVOT_SAMPLE and twice as many rows, whatever n
    sample = np.array([r["vec"] for r in points.where(F.pmod(F.xxhash64("pid"), F.lit(share)) == 0).orderBy("pid").select("vec").collect()], dtype=float)
    sample = sample if len(sample) else np.array([points.first()["vec"]], dtype=float)
    pivots = sample[np.unique(np.linspace(0, len(sample) - 1, cells).astype(int))]
    for _ in range(PIVOT_ROUNDS):  # means of the sample's cells: compact and of like size; any pivots give the same clusters
        near = np.stack([np.linalg.norm(sample - p, axis=1) for p in pivots], axis=1).argmin(axis=1)
        pivots = np.stack([sample[near == c].mean(axis=0) if (near == c).any() else pivots[c] for c in range(len(pivots))])
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def cell_of(frames):
        for pdf in frames:
            x = np.stack(pdf["vec"].to_numpy()) if len(pdf) else np.zeros((0, pivots.shape[1]))
            d = np.stack([np.linalg.norm(x - p, axis=1) for p in shared.value], axis=1)
            yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), rad=d.min(axis=1) if len(pdf) else d.sum(axis=1))

    placed = stage_table(points.select("g", "pid", "w", "vec").mapInPandas(cell_of, "g string, pid long, w long, vec array<double>, cell int, rad double"))
    parts = placed.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    block = F.concat_ws("|", "cell", F.pmod(F.xxhash64("pid", F.lit(5)), F.col("parts")), "g")
    gaps = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2)
    return placed.join(F.broadcast(parts), ["g", "cell"]).withColumn("block", block).drop("parts"), gaps


def _in_tiles(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every point once per tile of its block."""
    both = tiles.select(F.col("ti").alias("block"), "ti", "tj").unionByName(
        tiles.where("ti <> tj").select(F.col("tj").alias("block"), "ti", "tj"))
    return points.join(both, "block")


def _nearest(k: int):
    """Per point of a tile the distances below its bound to members of the other block (of its own in a home tile), nearest first, as many
    as ``k`` members need."""
    def across(pid, x, w, ub, side) -> pd.DataFrame:
        i, j = np.flatnonzero(side), np.flatnonzero(~side)
        d2, off = squares(x[i], x[j])
        far = ub * ub * (1 + 1e-9) + off
        # not larger, so that a pair whose square is no number stays
        a, b = np.nonzero(~(d2 > np.maximum(far[i][:, None], far[j][None, :])))
        a, b = i[a], j[b]
        d = some_distances(x, a, b)
        a, b, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
        ok = d < ub[a]
        a, b, d = a[ok], b[ok], d[ok]
        o = np.lexsort((b, d, a))
        a, b, d = a[o], b[o], d[o]
        new = np.flatnonzero(np.diff(a, prepend=-1))
        before = np.cumsum(w[b]) - w[b]  # members nearer than this one
        before -= np.repeat(before[new], np.diff(np.append(new, len(a)))) if len(a) else 0
        need = before + w[a] < k
        a, b, d = a[need], b[need], d[need]
        new = np.flatnonzero(np.diff(a, prepend=-1))
        cuts = [*new.tolist(), len(a)]
        ds, ms = d.tolist(), w[b].tolist()
        rows = [(p, ds[s:e], ms[s:e]) for p, s, e in zip(pid[a[new]].tolist(), cuts[:-1], cuts[1:])]
        return pd.DataFrame(rows, columns=["pid", "d", "m"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        x, w, ub = np.stack(pdf["vec"].to_numpy()), pdf["w"].to_numpy(), pdf["ub"].to_numpy()
        if pdf["ti"].iloc[0] != pdf["tj"].iloc[0]:
            return across(pdf["pid"].to_numpy(), x, w, ub, (pdf["block"] == pdf["ti"]).to_numpy())
        d = pair_distances(x)
        rows = []
        for i, pid in enumerate(pdf["pid"]):
            cand = np.flatnonzero((np.arange(len(x)) != i) & (d[i] < ub[i]))
            cand = cand[np.argsort(d[i][cand], kind="stable")]
            stop = int(np.searchsorted(np.cumsum(w[cand]) + w[i], k)) + 1
            cand = cand[:stop]
            if len(cand):
                rows.append((pid, d[i][cand].tolist(), w[cand].tolist()))
        return pd.DataFrame(rows, columns=["pid", "d", "m"])
    return run


def core_distances(points: DataFrame, gaps: np.ndarray, min_samples: int) -> DataFrame:
    """(pid, core); infinite where a group has fewer members than ``min_samples``."""
    spark = points.sparkSession
    home = points.select(F.col("block").alias("ti"), F.col("block").alias("tj")).distinct()
    kernel, kind = _nearest(min_samples), "pid long, d array<double>, m array<long>"

    def merged(found: DataFrame, out: str) -> DataFrame:
        each = found.groupBy("pid").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "m")))).alias("all"))
        start = F.struct(F.col("w").alias("n"), F.when(F.col("w") >= min_samples, F.lit(0.0)).alias("at"))
        step = F.aggregate("all", start, lambda s, e: F.struct((s["n"] + e["m"]).alias("n"), F.coalesce(
            s["at"], F.when(s["n"] + e["m"] >= min_samples, e["d"])).alias("at")))["at"]
        own = F.when(F.col("w") >= min_samples, F.lit(0.0)).otherwise(F.lit(float("inf")))
        return points.join(each, "pid", "left").select("g", "block", "cell", "rad", "pid", "w", "vec", F.coalesce(step, own).alias(out))

    first = _in_tiles(points.withColumn("ub", F.lit(float("inf"))), home).groupBy("ti", "tj").applyInPandas(kernel, kind)
    found = stage_table(first)
    bound = stage_table(merged(found, "ub"))
    blocks = bound.groupBy("g", "block", "cell").agg(F.max("rad").alias("r"), F.max("ub").alias("ub"))
    gap = F.broadcast(spark.createDataFrame([(int(i), int(j), float(gaps[i, j])) for i in range(len(gaps)) for j in range(len(gaps))], "ci int, cj int, gap double"))
    i = blocks.select("g", F.col("block").alias("ti"), F.col("cell").alias("ci"), F.col("r").alias("ri"), F.col("ub").alias("ui"))
    j = blocks.select("g", F.col("block").alias("tj"), F.col("cell").alias("cj"), F.col("r").alias("rj"), F.col("ub").alias("uj"))
    # cells are compared, not points; slack covers the rounding of sums
    near = i.join(j, "g").where("ti < tj").join(gap, ["ci", "cj"]).where("gap - ri - rj <= greatest(ui, uj) * 1.000001 + 1e-9").select("ti", "tj")
    cross = _in_tiles(bound, near).groupBy("ti", "tj").applyInPandas(kernel, kind)
    return merged(found.unionByName(cross), "core").select("pid", "core")


def _home_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """The points with the spanning tree of their block, rooted at its densest point: per point the point above it, the level of that link, and the
    heaviest level on the way to the root (-1 for the root, which has no link)."""
    pdf = pdf.sort_values("pid")
    pid, core = pdf["pid"].to_numpy(), pdf["core"].to_numpy()
    m = np.maximum(pair_distances(np.stack(pdf["vec"].to_numpy())), np.maximum(core[:, None], core[None, :]))
    beside = [[] for _ in pid]
    for a, b, w in zip(*(c.tolist() for c in spanning_links(m))):
        beside[a].append((b, w))
        beside[b].append((a, w))
    root = int(core.argmin())
    up, lvl, top = np.full(len(pid), -1), np.full(len(pid), -1.0), np.full(len(pid), -1.0)
    todo = [(root, -1)]
    while todo:
        v, over = todo.pop()
        for n, w in beside[v]:
            if n != over:
                up[n], lvl[n], top[n] = pid[v], w, max(top[v], w)
                todo.append((n, v))
    return pdf[["block", "g", "pid", "vec", "core"]].assign(up=up, up_lvl=lvl, top=top)


def cross_links(pid, x, core, side, up, up_lvl, top) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links between two blocks that the spanning tree of both together holds: (low, high, weight) as places of ``pid``, which is sorted.

    A link that is heavier than ``top`` of both its ends, and not the first of all such links, is the heaviest of a cycle: over both roots
    and that first link. So the tree is that of the blocks' own trees, the links up to ``top`` and that one."""
    i, j = np.flatnonzero(side), np.flatnonzero(~side)
    d2, off = squares(x[i], x[j])
    if not (np.isfinite(core).all() and np.isfinite(d2).all()):
        a, b, w = spanning_links(np.maximum(pair_distances(x), np.maximum(core[:, None], core[None, :])))
        keep = side[a] != side[b]
        return a[keep], b[keep], w[keep]

    def exact(a, b):
        lo, hi = np.minimum(i[a], j[b]), np.maximum(i[a], j[b])
        return lo, hi, np.maximum(some_distances(x, lo, hi), np.maximum(core[lo], core[hi]))

    slack = 1 + 1e-9
    c2, bound = core * core, np.where(top >= 0, top * top * slack + off, -np.inf)
    np.maximum(d2, c2[i][:, None], out=d2)  # squared weights
    np.maximum(d2, c2[j][None, :], out=d2)
    a, b = np.nonzero(d2 <= np.maximum(bound[i][:, None], bound[j][None, :]))
    lo, hi, w = exact(a, b)
    within = w <= np.maximum(top[lo], top[hi])
    d2[a[within], b[within]] = np.inf
    lo, hi, w = lo[within], hi[within], w[within]
    least = d2.min()
    if np.isfinite(least):
        p, q, r = exact(*np.nonzero(d2 <= least * slack + 2 * off))
        one = np.lexsort((q, p, r))[:1]
        if not len(lo):
            return p[one], q[one], r[one]
        lo, hi, w = np.append(lo, p[one]), np.append(hi, q[one]), np.append(w, r[one])
    own = np.flatnonzero(up_lvl >= 0)
    over = np.searchsorted(pid, up[own])
    a, b = np.concatenate([lo, np.minimum(own, over)]), np.concatenate([hi, np.maximum(own, over)])
    kept = forest(len(pid), a, b, np.concatenate([w, up_lvl[own]]))
    kept = kept[kept < len(lo)]
    return lo[kept], hi[kept], w[kept]


def _tile_links(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pid")
    pid = pdf["pid"].to_numpy()
    a, b, w = cross_links(pid, np.stack(pdf["vec"].to_numpy()), pdf["core"].to_numpy(), (pdf["block"] == pdf["ti"]).to_numpy(),
                          pdf["up"].to_numpy(), pdf["up_lvl"].to_numpy(), pdf["top"].to_numpy())
    return pd.DataFrame({"a": pid[a], "b": pid[b], "lvl": w})


def reach_links(points: DataFrame, min_samples: int) -> DataFrame:
    """Links (a, b, lvl), a < b, that hold the minimum spanning tree of every group under mutual reachability."""
    blocked, gaps = _with_blocks(points)
    blocked = stage_table(blocked)
    full = stage_table(blocked.join(core_distances(blocked, gaps, min_samples), "pid"))
    kind = "block string, g string, pid long, vec array<double>, core double, up long, up_lvl double, top double"
    full = stage_table(full.groupBy("block").applyInPandas(_home_links, kind))
    own = full.where("up_lvl >= 0").select(F.least("pid", "up").alias("a"), F.greatest("pid", "up").alias("b"), F.col("up_lvl").alias("lvl"))
    blocks = full.select("g", "block").distinct()
    tiles = blocks.select("g", F.col("block").alias("ti")).join(blocks.select("g", F.col("block").alias("tj")), "g").where("ti < tj").select("ti", "tj")
    cross = _in_tiles(full.drop("g"), tiles).groupBy("ti", "tj").applyInPandas(_tile_links, "a long, b long, lvl double")
    return stage_table(own.unionByName(cross))


# --- contraction ---------------------------------------------------------------------------------

def _lightest(links: DataFrame, small: DataFrame) -> DataFrame:
    arcs = links.select(F.col("u").alias("v"), F.col("v").alias("to"), "key").unionByName(links.select("v", F.col("u").alias("to"), "key"))
    return arcs.join(small, "v").groupBy("v").agg(F.min(F.struct("key", "to")).alias("m")).select("v", F.col("m.to").alias("to"), F.col("m.key").alias("key"))


def contract(points: DataFrame, links: DataFrame, size: int, local_links: int) -> tuple[DataFrame, DataFrame]:
    """Rounds of merging small vertices. Returns members (pid, g, w, vertex, level: the key of the link by which the point came to be among ``size``
    members, null while its vertex is small) and the links left (u, v, key) between vertices; key is (lvl, a, b), the order of links."""
    start = F.struct(F.lit(0.0).alias("lvl"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))  # before any link
    members = points.select("g", "pid", "w", F.col("pid").alias("vertex"), F.when(F.col("w") >= size, start).alias("level"))
    members = stage_table(members)
    left = stage_table(links.select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct("lvl", "a", "b").alias("key")))
    while left.count() > local_links:
        sizes = stage_table(members.groupBy("vertex").agg(F.sum("w").alias("n")))
        small = sizes.where(F.col("n") < size).select(F.col("vertex").alias("v"))
        pick = stage_table(_lightest(left, small))
        if pick.isEmpty():
            break
        target = sizes.select(F.col("vertex").alias("to"), (F.col("n") >= size).alias("big"), F.col("n").alias("tn"))
        pick = pick.join(target, "to")
        other = pick.select(F.col("v").alias("to"), F.col("to").alias("v"), F.col("key").alias("same"))
        mutual = pick.where("NOT big").join(other, ["v", "to"]).where("key = same").join(sizes.select(F.col("vertex").alias("v"), "n"), "v")
        # both ends of a mutual link move to the smaller number; the level counts once the sum is large
        moves = mutual.select("v", F.least("v", "to").alias("into"), F.when(F.col("n") + F.col("tn") >= size, F.col("key")).alias("lv"))
        fall = stage_table(pick.where("big").select("v", F.col("to").alias("into"), F.col("key").alias("lv")))
        rest = pick.where("NOT big")
        # whoever points at a vertex that falls in, falls in after it, at its own level: follow the pointers to their end
        more = rest.join(fall.select(F.col("v").alias("to"), "into"), "to").select("v", "into", F.col("key").alias("lv"))
        while not (more := stage_table(more.join(fall.select("v"), "v", "left_anti"))).isEmpty():
            fall = stage_table(fall.unionByName(more))
            more = rest.join(more.select(F.col("v").alias("to"), "into"), "to").select("v", "into", F.col("key").alias("lv"))
        moves = stage_table(moves.join(fall.select("v"), "v", "left_anti").unionByName(fall))
        to = moves.select(F.col("v").alias("vertex"), "into", "lv")
        members = stage_table(members.join(to, "vertex", "left").select("g", "pid", "w", F.coalesce("into", "vertex").alias("vertex"), F.coalesce("level", "lv").alias("level")))
        old = left
        mu, mv = moves.select(F.col("v").alias("u"), F.col("into").alias("iu")), moves.select("v", F.col("into").alias("iv"))
        moved = left.join(mu, "u", "left").join(mv, "v", "left").select(F.coalesce("iu", "u").alias("x"), F.coalesce("iv", "v").alias("y"), "key").where("x <> y")
        left = stage_table(moved.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.min("key").alias("key")))
        drop_tables(old, sizes)
    return members, left


def merge_in_order(vertices: list[tuple[int, int]], links: list[tuple[int, int, tuple]], size: int):
    """Merge (vertex, members) along ``links`` (u, v, key) in their order. Returns {vertex: (node, key at which it joins it, None for a vertex
    that was large before)} and the condensed tree [(node, parent or None, key at which it joins its parent or None)]."""
    place, parent, top, held, node, weight = {}, [], [], {}, {}, {}
    root = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def new_node():
        parent.append(None)
        top.append(None)
        return len(parent) - 1

    for v, n in vertices:
        root[v], weight[v], held[v], node[v] = v, n, [v], None
        if n >= size:
            node[v], held[v] = new_node(), []
            place[v] = (node[v], None)
    for a, b, key in links:
        a, b = find(a), find(b)
        if a == b:
            continue
        if len(held[a]) < len(held[b]):
            a, b = b, a
        root[b] = a
        weight[a] += weight.pop(b)
        waiting, na, nb = held[a] + held.pop(b), node[a], node.pop(b)  # fewer than ``size`` wait on either side
        if na is not None and nb is not None:
            up = new_node()
            for c in (na, nb):
                parent[c], top[c] = up, key
            node[a], held[a] = up, []
            continue
        at = na if na is not None else nb
        if at is None and weight[a] >= size:
            at = new_node()
        node[a], held[a] = at, waiting
        if at is not None:
            place.update((v, (at, key)) for v in waiting)
            held[a] = []
    return place, [(i, parent[i], top[i]) for i in range(len(parent))]


def select_clusters(tree: list[tuple[int, int | None, float | None]], members: dict[int, tuple[float, float]]) -> dict[int, int]:
    """{node: chosen cluster's node, -1 for none}. ``members``: per node the number of members that fall out of it and the sum of their densities.
    A node that is a parent has a larger number than its children."""
    dense = [0.0 if t is None else 1 / max(t, FLOOR) for _, _, t in tree]  # a node's birth
    total = [members.get(i, (0.0, 0.0))[0] for i, _, _ in tree]
    value = [members.get(i, (0.0, 0.0))[1] - members.get(i, (0.0, 0.0))[0] * dense[i] for i, _, _ in tree]
    below = [0.0] * len(tree)
    has = [False] * len(tree)
    chosen = [False] * len(tree)
    for i, up, _ in tree:
        if up is not None:
            total[up] += total[i]
            value[up] += total[i] * (dense[i] - dense[up])  # the child leaves its parent whole
    best = list(value)
    for i, up, _ in tree:
        if up is None:
            continue  # a root is never a cluster
        if has[i] and below[i] > value[i]:
            best[i] = below[i]
        else:
            chosen[i] = True
        below[up] += best[i]
        has[up] = True
    label = {}
    for i, up, _ in reversed(tree):
        over = label.get(up, -1) if up is not None else -1
        label[i] = over if over != -1 else (i if chosen[i] else -1)
    return label


def _finish(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["g"].iloc[0]
        vert = pdf[pdf["kind"] == 0]
        link = pdf[pdf["kind"] == 1].sort_values(["lvl", "a", "b"])
        keys = zip(link["lvl"], link["a"].astype("int64"), link["b"].astype("int64"))
        place, tree = merge_in_order([(int(v), int(n)) for v, n in zip(vert["u"], vert["n"])],
                                     list(zip(link["u"].astype("int64"), link["v"].astype("int64"), keys)), size)
        none = (None, None, None)
        rows = [(g, 0, v, node, None, *(key or none)) for v, (node, key) in place.items()]
        rows += [(g, 1, None, i, up, *(key or none)) for i, up, key in tree]
        return pd.DataFrame(rows, columns=["g", "kind", "vertex", "node", "parent", "lvl", "a", "b"]).astype(
            {"kind": "int32", "vertex": "Int64", "node": "Int64", "parent": "Int64", "lvl": "float64", "a": "Int64", "b": "Int64"})
    return run


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    none = [None if pd.isna(p) else int(p) for p in pdf["parent"]]
    tree = [(int(i), up, None if up is None else float(t)) for i, up, t in zip(pdf["node"], none, pdf["lvl"])]
    label = select_clusters(tree, {int(i): (n, s) for i, n, s in zip(pdf["node"], pdf["members"], pdf["density"])})
    return pd.DataFrame({"g": pdf["g"], "node": pdf["node"], "chosen": [label[int(i)] for i in pdf["node"]]})


def density_clusters(points: DataFrame, *, min_cluster_size: int = 20, min_samples: int | None = None, id_col: str = "id", vec_col: str = "vec",
                     group_col: str | None = None, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(id, cluster, level) and ``group_col`` if given: the cluster of every point in its group, and the distance at which it came to be among
    ``min_cluster_size`` members (null if its group has fewer)."""
    k = min_samples or min_cluster_size
    g = F.coalesce(F.col(group_col).cast("string"), F.lit("")) if group_col else F.lit("")
    place = F.struct(g.alias("g"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = points.select(F.col(id_col).cast("long").alias("id"), place.alias("at")).where(
        F.col("id").isNotNull() & F.coalesce(F.forall("at.vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False)))
    rows = stage_table(rows)
    if rows.isEmpty():
        out = rows.select("id", F.lit(0).alias("cluster"), F.lit(None).cast("double").alias("level"), *([F.col("at.g").alias(group_col)] if group_col else []))
        return out
    same = stage_table(rows.groupBy("at").agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w")))
    single = same.select("at.g", "pid", "w", "at.vec")
    members, left = contract(single, reach_links(single, k), min_cluster_size, local_links)
    vertices = stage_table(members.groupBy("g", "vertex").agg(F.sum("w").alias("n")))
    of_link = left.join(vertices.select(F.col("vertex").alias("u"), "g"), "u")
    none = F.lit(None).cast("long")
    rest = vertices.select("g", F.lit(0).alias("kind"), F.col("vertex").alias("u"), none.alias("v"), "n", F.lit(None).cast("double").alias("lvl"), none.alias("a"), none.alias("b")) \
        .unionByName(of_link.select("g", F.lit(1).alias("kind"), "u", "v", none.alias("n"), "key.lvl", "key.a", "key.b"))
    done = stage_table(rest.groupBy("g").applyInPandas(_finish(min_cluster_size), "g string, kind int, vertex long, node long, parent long, lvl double, a long, b long"))
    key = F.when(F.col("lvl").isNotNull(), F.struct("lvl", "a", "b"))
    tree = done.where("kind = 1").select("g", "node", "parent", key.alias("need"))
    at = done.where("kind = 0").select("g", "vertex", "node", key.alias("joined"))
    placed = members.join(at, ["g", "vertex"], "left").select("g", "pid", "w", "node", F.coalesce("level", "joined").alias("level"))
    placed = stage_table(_climb(stage_table(placed), tree))
    sums = placed.where("node IS NOT NULL").groupBy("g", "node").agg(
        F.sum("w").cast("double").alias("members"), F.sum(F.col("w") / F.greatest("level.lvl", F.lit(FLOOR))).alias("density"))
    choice = tree.select("g", "node", "parent", "need.lvl").join(sums, ["g", "node"], "left").na.fill(0.0, ["members", "density"]) \
        .groupBy("g").applyInPandas(_choose, "g string, node long, chosen long")
    found = stage_table(placed.join(choice, ["g", "node"], "left").select("g", "pid", "level.lvl", F.coalesce("chosen", F.lit(-1)).alias("chosen")))
    first = stage_table(found.where("chosen >= 0").groupBy("g", "chosen").agg(F.min("pid").alias("first")))
    number = distributed_row_number(first, ["g"], ["first"], out="number").select("g", "chosen", (F.col("number") - 1).alias("number"))
    noise = first.groupBy("g").agg(F.lit(-1).alias("noise"))
    label = found.join(number, ["g", "chosen"], "left").join(noise, "g", "left").select(
        "pid", F.coalesce("number", "noise", F.lit(0)).cast("int").alias("cluster"), F.col("lvl").alias("level"))
    # copies of one vector may be a large part of the rows
    out = lookup(rows, same.select("at", "pid").join(label, "pid").select("at", "cluster", "level"), "at")
    return out.select("id", "cluster", "level", *([F.col("at.g").alias(group_col)] if group_col else []))


def _climb(placed: DataFrame, tree: DataFrame) -> DataFrame:
    """Move every member from its vertex's node up to the node that holds it when it joins: the highest ancestor made by a link before
    the member's own, in steps of falling powers of two."""
    hops = [stage_table(tree.where("parent IS NOT NULL").select("g", "node", F.col("parent").alias("up"), "need"))]
    while not hops[-1].isEmpty():
        far = hops[-1]
        nxt = far.select("g", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("need").alias("need2"))
        hops.append(stage_table(far.join(nxt, ["g", "up"]).select("g", "node", F.col("up2").alias("up"), F.col("need2").alias("need"))))
    for hop in reversed(hops[:-1]):
        placed = placed.join(hop, ["g", "node"], "left").select(
            "g", "pid", "w", F.when(F.col("need") < F.col("level"), F.col("up")).otherwise(F.col("node")).alias("node"), "level")
    return placed

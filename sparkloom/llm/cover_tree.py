"""Near-duplicate vectors by dual traversal of cover trees.

A bounded sample fixes the upper levels: centres chosen farthest-first, and
below each of them its own, in number proportional to the input. Vectors go to
their nearest centre at each level, which gives cells; neighbouring cells share
a block, and a cell that holds too many is dealt into blocks of its own. Each
cell of a block has a covering ball, or a few. Balls are compared first, by ids: blocks
meet only if two of their balls' centres lie no farther apart than both radii
and the threshold; blocks all of whose balls lie nearer than that by their radii link whole,
without their vectors. Only for the rest vectors are brought together.
There two cover trees, built with nested levels of halving radii, are traversed
by the same rule, down to leaves that are compared in double precision. Equal
vectors are one point with a weight, so copies are never paired one by one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .graph import components
from .ngram_join import bounds, runs

#: Points and bytes (in double precision) of a block, mean points of a cell, points of a leaf.
BLOCK, BLOCK_BYTES, CELL, LEAF = 4096, 1 << 22, 512, 256
#: Upper centres tried for each vector; most groups of near centres.
PROBES, NETS = 8, 4096
#: Most balls of a cell, and what they have to shrink its radius to.
BALLS, SHRINK = 12, 0.6
#: Most centres for each length of vector (beyond, cells get larger and are dealt into blocks), sampled points for each, bytes of a sample or of a slice of balls.
CENTRES, SAMPLED, SLICE_BYTES = 32_768, 4, 1 << 25
#: Children that one level may give a node; a set that needs more has no structure at that radius and becomes a leaf.
CHILDREN = 64
_SAFE = 1e-7


def unit(blobs: list[bytes], dtype: str, dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype).reshape(-1, dims).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def at_least(x: np.ndarray, y: np.ndarray, cosine: float, fx: np.ndarray, fy: np.ndarray) -> np.ndarray:
    """Which products of rows of x and y reach cosine, as double precision has it: single precision (fx, fy) decides where its error can't matter."""
    p = fx @ fy.T
    error = 2e-7 * (x.shape[1] + 8)
    out = p >= cosine
    i, j = np.nonzero(np.abs(p - cosine) <= error)
    for at in range(0, len(i), 1 << 16):
        k, m = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        out[k, m] = np.einsum("ij,ij->i", x[k], y[m]) >= cosine
    return out


class Node:
    __slots__ = ("start", "end", "centre", "radius", "children")

    def __init__(self, start: int, end: int, centre: np.ndarray, radius: float):
        self.start, self.end, self.centre, self.radius, self.children = start, end, centre, radius, []


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - c) ** 2).sum(1), 0))


def build(x: np.ndarray, order: np.ndarray, start: int, end: int, level: float, finest: float) -> Node:
    """The cover tree of x[order[start:end]]; order is rearranged so that each node's points stand together."""
    pts = x[order[start:end]]
    centre = pts[0]
    far = _distance(pts, centre)
    node = Node(start, end, centre, float(far.max()))
    while level > finest and node.radius <= level:
        level /= 2
    if end - start <= LEAF or level <= finest:
        return node
    owner = np.full(end - start, -1)
    for k in range(CHILDREN):  # a net of this level's radius: each centre lies outside the balls before it
        left = np.flatnonzero(owner < 0)
        if not len(left):
            break
        owner[left[_distance(pts[left], pts[left[0]]) <= level]] = k
    if (owner < 0).mean() > 0.5:
        return node
    owner[owner < 0] = CHILDREN
    sort = np.argsort(owner, kind="stable")
    order[start:end] = order[start:end][sort]
    cuts = np.flatnonzero(np.diff(owner[sort])) + 1
    for lo, hi in zip([0, *cuts], [*cuts, end - start], strict=True):
        if hi - lo == end - start:
            return node
        node.children.append(build(x, order, start + int(lo), start + int(hi), level / 2, finest))
    return node


class Links:
    """Counts of linked weight, and labels of what connects, over the points of one or two blocks."""

    def __init__(self, n: int):
        self.count, self.label = np.zeros(n, np.int64), np.arange(n)

    def join(self, members: np.ndarray) -> None:
        found = np.unique(self.label[members])
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]


def traverse(x: np.ndarray, wx: np.ndarray, y: np.ndarray | None, wy: np.ndarray | None, cosine: float) -> Links:
    """All links between two blocks (points of y follow those of x), or within x if y is None."""
    eps = float(np.sqrt(max(2 - 2 * cosine, 0)))
    ox = np.arange(len(x))
    fx = x.astype(np.float32)
    a = build(x, ox, 0, len(x), 1.0, eps / 8)
    if y is None:
        oy, b, y, wy, shift, fy = ox, a, x, wx, 0, fx
    else:
        oy, shift, fy = np.arange(len(y)), len(x), y.astype(np.float32)
        b = build(y, oy, 0, len(y), 1.0, eps / 8)
    out = Links(len(x) + (len(y) if shift else 0))
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        d = float(np.sqrt(max(((p.centre - q.centre) ** 2).sum(), 0)))
        if d > p.radius + q.radius + eps + _SAFE:
            continue
        i, j = ox[p.start : p.end], oy[q.start : q.end]
        same = not shift and p is q
        if d + p.radius + q.radius < eps - _SAFE and not same:
            out.count[i] += wy[j].sum()
            out.count[j + shift] += wx[i].sum()
            out.join(np.concatenate([i, j + shift]))
        elif same and p.children:
            todo += [(u, v) for k, u in enumerate(p.children) for v in p.children[k:]]
        elif p.children and (not q.children or p.radius >= q.radius):
            todo += [(u, q) for u in p.children]
        elif q.children:
            todo += [(p, v) for v in q.children]
        else:
            for at in range(0, len(i), 512):
                rows = i[at : at + 512]
                hit = at_least(x[rows], y[j], cosine, fx[rows], fy[j])
                if same:
                    hit[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
                if not hit.any():
                    continue
                out.count[rows] += hit @ wy[j]
                if not same:
                    out.count[j + shift] += wx[rows] @ hit
                for k in np.flatnonzero(hit.any(1)):
                    out.join(np.append(j[hit[k]] + shift, rows[k]))
    return out


def _points(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """id, point (a print; null if the vector links with nothing), vector as bytes."""
    dtype = "f4" if "float" in vectors.schema[vec_col].dataType.simpleString() else "f8"
    kind = vectors.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            lists, n = b.column(1), b.num_rows
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            flat = lists.flatten()
            values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            points, blobs = [None] * n, [None] * n
            for k in np.unique(size[size > 0]):
                own = np.flatnonzero(size == k)
                x = values[begin[own, None] + np.arange(k)] + 0.0  # + 0.0: no negative zeros
                most = np.abs(x).max(1)
                good = np.isfinite(most) & (most > 0)
                if dtype == "f8":  # powers of two, so that nothing is rounded
                    x[good] = np.ldexp(x[good], -np.frexp(most[good])[1][:, None])
                rows = x.astype(dtype)
                for i, row in zip(own[good].tolist(), rows[good], strict=True):
                    blobs[i] = row.tobytes()
                    h = xxhash.xxh64_intdigest(blobs[i])
                    points[i] = h - (1 << 64) if h >= 1 << 63 else h
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(points, pa.int64()), pa.array(blobs, pa.binary())], names=[id_col, "point", "vector"])

    return vectors.select(id_col, vec_col).mapInArrow(work, f"`{id_col}` {kind}, point bigint, vector binary"), dtype


def _farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    chosen, far = [0], _distance(x, x[0])
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distance(x, x[chosen[-1]]))
    return x[chosen]


def cover(x: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Balls (centre, radius) that hold all points of a cell: one, or the fewest up to BALLS that bring the covering radius down to SHRINK of it, as where a few points strayed in."""
    mean = x.mean(0)
    far = _distance(x, mean)
    whole = float(far.max())
    chosen, near, owner = [int(far.argmin())], _distance(x, x[far.argmin()]), np.zeros(len(x), np.int64)
    while len(chosen) < BALLS and near.max() > SHRINK * whole:
        chosen.append(int(near.argmax()))
        d = _distance(x, x[chosen[-1]])
        owner[d < near] = len(chosen) - 1
        near = np.minimum(near, d)
    if near.max() > SHRINK * whole or whole == 0:
        return [(mean, whole)]
    own = [x[owner == k] for k in range(len(chosen))]
    return [(c.mean(0), float(_distance(c, c.mean(0)).max())) for c in own if len(c)]


class Top:
    """Two levels of centres for vectors of one length. Cells are numbered so that near ones follow each other."""

    def __init__(self, x: np.ndarray, n: int, near: float):
        self.upper = _farthest_first(x, math.isqrt(n))
        owner = np.argmax(self._closeness(x, self.upper), 1)
        share = [x[owner == k] for k in range(len(self.upper))]
        self.lower = [_farthest_first(s, max(1, round(n * len(s) / len(x)))) for s in share if len(s)]
        self.upper = self.upper[[k for k, s in enumerate(share) if len(s)]]
        centres = np.concatenate(self.lower)
        group = np.full(len(centres), NETS)  # a net of radius `near`, so that what belongs together shares a block
        for k in range(NETS):
            left = np.flatnonzero(group == NETS)
            if not len(left):
                break
            group[left[_distance(centres[left], centres[left[0]]) <= near]] = k
        rank = np.empty(len(centres), np.int64)
        rank[np.argsort(group, kind="stable")] = np.arange(len(centres))
        self.number = np.split(rank, np.cumsum([len(c) for c in self.lower])[:-1])

    @staticmethod
    def _closeness(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return x @ centres.T - (centres**2).sum(1) / 2

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The nearest lower centre of the PROBES nearest upper ones."""
        close = self._closeness(x, self.upper)
        probes = np.argpartition(-close, min(PROBES, len(self.upper)) - 1, 1)[:, :PROBES]
        best, out = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
        for k in range(len(self.upper)):
            own = np.flatnonzero((probes == k).any(1))
            if len(own):
                c = self._closeness(x[own], self.lower[k])
                at, top = c.argmax(1), c.max(1)
                new = top > best[own]
                best[own[new]], out[own[new]] = top[new], self.number[k][at[new]]
        return out


def _per_block(size: int, dtype: str) -> int:
    return max(1, min(BLOCK, BLOCK_BYTES * np.dtype(dtype).itemsize // (8 * size)))


def _tops(nodes: DataFrame, dtype: str, eps: float) -> dict[int, Top]:
    """By number of bytes of a vector, the upper levels, from a sample by hash of SAMPLED points for each centre."""
    counts = {r["size"]: r["n"] for r in nodes.groupBy(F.length("vector").alias("size")).agg(F.count("*").alias("n")).collect()}
    wanted = {size: max(1, min(CENTRES, SLICE_BYTES // (SAMPLED * size), math.ceil(n / CELL))) for size, n in counts.items()}
    if not wanted:
        return {}
    share = F.create_map(*(x for size, c in wanted.items() for x in (F.lit(size), F.lit(min(1.0, SAMPLED * c / counts[size])))))
    picked = nodes.where(F.pmod(F.xxhash64("point"), F.lit(1 << 24)) < F.element_at(share, F.length("vector")) * (1 << 24))
    sample: dict[int, list[bytes]] = {}
    for r in picked.select("point", "vector").orderBy("point").collect():
        sample.setdefault(len(r["vector"]), []).append(bytes(r["vector"]))
    return {size: Top(unit(blobs, dtype, size // np.dtype(dtype).itemsize), wanted[size], 2 * eps) for size, blobs in sample.items()}


def _blocks(points: DataFrame, tops: dict[int, Top], dtype: str) -> DataFrame:
    """One row for each block: block, size, points, weights, vectors, centres and radii of its balls, weight (of all its points), lead (its first point)."""
    shared = points.sparkSession.sparkContext.broadcast(tops)  # SLICE_BYTES at most for each length of vector, twice that in double precision

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(2).to_pylist()
            cells = np.zeros(len(blobs), np.int64)
            for size in {len(x) for x in blobs}:
                own = [i for i, x in enumerate(blobs) if len(x) == size]
                if size in shared.value:
                    cells[own] = shared.value[size].cells(unit([blobs[i] for i in own], dtype, size // np.dtype(dtype).itemsize))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in blobs], pa.int32()), pa.array(cells, pa.int32())], names=["point", "weight", "vector", "size", "cell"])

    seen = written(points.select("point", "weight", "vector").mapInArrow(assign, "point bigint, weight bigint, vector binary, size int, cell int"), "cells")
    counts = seen.groupBy("size", "cell").agg(F.count("*").alias("n")).collect()  # CENTRES rows at most for each length of vector
    dealt_to, block = [], -1
    for size, rows in itertools.groupby(sorted((r["size"], r["cell"], r["n"]) for r in counts), key=lambda r: r[0]):
        most, held = _per_block(size, dtype), math.inf
        for _, cell, n in rows:
            if held + n > most:
                block, held = block + 1, 0
            dealt_to.append((size, cell, block, math.ceil(n / most)))
            block, held = block + math.ceil(n / most) - 1, held + n
    plan = seen.sparkSession.createDataFrame(dealt_to, "size int, cell int, first bigint, parts int")
    place = (F.col("first") + F.pmod(F.xxhash64("point"), F.col("parts"))).alias("block")
    dealt = seen.join(F.broadcast(plan) if len(dealt_to) <= 8 * CENTRES else plan, ["size", "cell"]).select(place, "cell", "size", "point", "weight", "vector")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 1):
            edge = bounds(t, 1)
            for k in range(len(edge) - 1):
                part = t.slice(edge[k], edge[k + 1] - edge[k])
                size, cells = part.column(2)[0].as_py(), part.column(1).to_numpy()
                ids, weights, blobs = part.column(3).to_numpy().astype("i8"), part.column(4).to_numpy().astype("i8"), part.column(5).to_pylist()
                x = unit(blobs, dtype, size // np.dtype(dtype).itemsize)
                balls = [b for c in np.unique(cells) for b in cover(x[cells == c])]
                centres, radii = np.stack([c for c, _ in balls]), np.array([r for _, r in balls])
                row = (part.column(0)[0].as_py(), size, ids.tobytes(), weights.tobytes(), b"".join(blobs), centres.tobytes(), radii.tobytes(), int(weights.sum()), int(ids[0]))
                types = [pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], names=["block", "size", "points", "weights", "vectors", "centres", "radii", "weight", "lead"])

    packed = dealt.repartition("block").sortWithinPartitions("block", "cell", "point")
    return written(packed.mapInArrow(pack, "block bigint, size int, points binary, weights binary, vectors binary, centres binary, radii binary, weight bigint, lead bigint"), "blocks")


def _near_balls(blocks: DataFrame, eps: float) -> DataFrame:
    """i, j, whole, and the weight and lead of both: pairs of blocks (i <= j) that their balls can't rule out; whole: all their points link.

    Only balls are read, about one for CELL points, and one slice of them is sent to all tasks at a time.
    """
    spark = blocks.sparkSession
    balls = blocks.select("block", "size", "centres", "radii", "weight", "lead")
    count, bytes_ = balls.agg(F.count("*"), F.coalesce(F.sum(F.length("centres")), F.lit(0))).first()
    slices, out = max(1, math.ceil(bytes_ / SLICE_BYTES)), None
    for k in range(slices):
        here: dict[int, tuple] = {}
        for size, rows in itertools.groupby(balls.where(F.pmod("block", F.lit(slices)) == k).orderBy("size", "block").collect(), key=lambda r: r["size"]):
            rows = list(rows)
            radii = [np.frombuffer(r["radii"]) for r in rows]
            n = [len(r) for r in radii]
            facts = [np.array([r[c] for r in rows]) for c in ("block", "weight", "lead")]
            here[size] = (*facts, np.cumsum([0, *n])[:-1], np.concatenate(radii), np.concatenate([np.frombuffer(r["centres"]) for r in rows]).reshape(sum(n), -1))
        shared = spark.sparkContext.broadcast(here)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
            for b in batches:
                for r in b.to_pylist():
                    if r["size"] not in shared.value:
                        continue
                    block, weight, lead, first, radius, centres = shared.value[r["size"]]
                    radii = np.frombuffer(r["radii"])
                    nearest, farthest = np.full(len(block), np.inf), np.zeros(len(block))  # of points in both blocks, by the balls' bounds
                    for centre, own in zip(np.frombuffer(r["centres"]).reshape(len(radii), -1), radii, strict=True):
                        far = _distance(centres, centre)
                        nearest = np.minimum(nearest, np.minimum.reduceat(far - radius - own, first))
                        farthest = np.maximum(farthest, np.maximum.reduceat(far + radius + own, first))
                    at = np.flatnonzero((block >= r["block"]) & ((nearest <= eps + _SAFE) | (block == r["block"])))
                    n = len(at)
                    cols = [[r["block"]] * n, block[at], farthest[at] < eps - _SAFE, [r["weight"]] * n, weight[at], [r["lead"]] * n, lead[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["i", "j", "whole", "weight_i", "weight_j", "lead_i", "lead_j"])

        found = balls.repartition(max(1, min(int(count), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(work, "i bigint, j bigint, whole boolean, weight_i bigint, weight_j bigint, lead_i bigint, lead_j bigint")
        out = found if out is None else out.union(found)
    return written(out, "ball_pairs")


def _compared(pairs: DataFrame, blocks: DataFrame, dtype: str, cosine: float) -> DataFrame:
    """u, v, n: points with n links found, and one that each connects to. Of two blocks one is sent to the other, once for each pair."""
    side = lambda k: blocks.select(F.col("block").alias(k), "size", *(F.col(c).alias(f"{c}_{k}") for c in ("points", "weights", "vectors")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                dims = r["size"] // np.dtype(dtype).itemsize
                ids, ws, xs = [], [], []
                for k in "ij" if "vectors_j" in r else "i":
                    ids.append(np.frombuffer(r[f"points_{k}"], "i8"))
                    ws.append(np.frombuffer(r[f"weights_{k}"], "i8"))
                    xs.append(unit([r[f"vectors_{k}"]], dtype, dims))
                links = traverse(xs[0], ws[0], *((xs[1], ws[1]) if len(xs) > 1 else (None, None)), cosine)
                point = np.concatenate(ids)
                at = np.flatnonzero(links.count)
                if len(at):
                    to = links.label[at]
                    yield pa.RecordBatch.from_arrays([pa.array(point[at]), pa.array(point[to], mask=to == at), pa.array(links.count[at])], names=["u", "v", "n"])

    alone = pairs.where("i = j").select("i").join(side("i"), "i")
    both = pairs.where("i <> j").select("i", "j").join(side("i"), "i").join(side("j").drop("size"), "j")
    return alone.mapInArrow(work, "u bigint, v bigint, n bigint").union(both.mapInArrow(work, "u bigint, v bigint, n bigint"))


def _wholes(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """u, v, n as _compared has them, of pairs whose points all link: each point counts the other block's weight and connects to its block's lead, and the leads connect."""
    extra = pairs.select(F.col("i").alias("block"), F.col("weight_j").alias("w"), (F.col("i") == F.col("j")).cast("int").alias("own"))
    extra = extra.union(pairs.where("i <> j").select("j", "weight_i", F.lit(0)))
    sums = extra.groupBy("block").agg(F.sum("w").alias("w"), F.max("own").alias("own"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, own = np.frombuffer(r["points"], "i8"), np.frombuffer(r["weights"], "i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), r["lead"])), pa.array(r["w"] - own * r["own"])], names=["u", "v", "n"])

    inside = sums.join(blocks.select("block", "points", "weights", "lead"), "block").mapInArrow(work, "u bigint, v bigint, n bigint")
    return inside.union(pairs.where("i <> j").select("lead_i", "lead_j", F.lit(0).cast("bigint")))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (smallest id reachable by links, itself included), kept.

    Null, empty and zero vectors, and those with null or non-finite components,
    link with nothing; nor do vectors of different length. Each row counts, also
    where rows repeat a vector or an id. Null ids link but never name a
    component; one alone gets null, and so does its kept. No rows give no rows.
    """
    small_batches(vectors.sparkSession)
    points, dtype = _points(vectors, id_col, vec_col)
    own = written(points, "points")
    nodes = written(own.where("point is not null").groupBy("point").agg(F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min(id_col).alias("least")), "distinct")
    eps = float(np.sqrt(max(2 - 2 * cosine, 0)))
    blocks = _blocks(nodes, _tops(nodes, dtype, eps), dtype)
    pairs = _near_balls(blocks, eps)
    found = written(_compared(pairs.where("not whole"), blocks, dtype, cosine).union(_wholes(pairs.where("whole"), blocks)), "links")
    counts = found.groupBy("u").agg(F.sum("n").alias("links")).withColumnRenamed("u", "point")
    groups = components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "point")
    least = nodes.select("point", "weight", "least").join(groups, "point", "left").join(counts, "point", "left")
    named = least.where("component is not null").groupBy("component").agg(F.min("least").alias("name"))
    per = least.join(named, "component", "left").select("point", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("name", "least").alias("name"))
    component = F.coalesce("name", F.col(id_col))
    return own.select(id_col, "point").join(per, "point", "left").select(
        id_col, F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), (F.col(id_col) == component).alias("kept")
    )

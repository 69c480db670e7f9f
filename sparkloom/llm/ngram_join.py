"""Jaccard self-join of word shingles by token-combination prefixes.

Shingles are ordered rare ones first. Two sets that reach the threshold share a
shingle within their prefixes. If the first one they share is rare, indexing
single shingles finds the pair. If it is frequent, then all they share are
frequent, and prefixes extended by one share two of them: for frequent shingles
pairs are indexed, within classes of size. Candidates are thinned by size, place
in the prefix and a bit table of a quarter of the shingles, gathered into
clusters, and verified on the sets themselves: first with the centre of their
cluster, then block against block for what doesn't link with it.

Documents with equal sets are one node throughout. Only what connects is kept:
the results are components, so a dense group needs no list of its pairs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _mix, frugal, set_print, shingle_sets, small_batches, written
from .graph import components

#: Counters of the frequency table (4 MB whatever the input) and the parts it is merged in.
COUNTERS, SLICES, FAN_IN = 1 << 20, 8, 64
#: A shingle is frequent if its counter exceeds RARE + SLACK times the mean counter.
RARE, SLACK = 64, 2.0
#: Most combinations of frequent shingles that a size class may index by two; larger sets use one.
COMBINATIONS = 1024
#: Documents and shingles of a block in verification; bits of the table of candidates.
BLOCK_DOCS, BLOCK_SHINGLES, BLOOM_BITS = 96, 1 << 19, 1 << 25
#: Keys of frequent shingles that a task remembers.
KEYS_HELD = 250_000


@dataclass(frozen=True)
class Rule:
    """Sets link when den * |intersection| >= num * |union|. Above a half, so that different sets that link share two shingles at least."""

    words: int = 5
    num: int = 80
    den: int = 100

    def __post_init__(self) -> None:
        if not 0 < self.den < 2 * self.num <= 2 * self.den or self.words < 1:
            raise ValueError("the similarity has to lie above a half and at 1 at most, and shingles need a word")

    def least(self, n: np.ndarray | int):  # noqa: ANN201
        """Fewest shingles that a set of n shares with any partner."""
        return -((-self.num * n) // self.den)

    def need(self, total):  # noqa: ANN001, ANN201
        """Fewest shingles that two sets of `total` together share."""
        return -((-self.num * total) // (self.den + self.num))

    def size_class(self, n: int) -> int:
        return int(math.log(n) / (math.log(self.den / self.num) * 1.0001)) if self.num < self.den else n

    def combined(self, size_class: int) -> bool:
        if self.num == self.den:
            return True
        top = int((self.den / self.num) ** ((size_class + 1) * 1.0001)) + 1
        f = top - int(self.least(top)) + 2
        return f * (f - 1) // 2 <= COMBINATIONS


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray | pa.Array]]:
    """Whole runs of equal first `keys` columns of sorted batches, many runs at a time; a run is never split."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        last = [t.column(i)[-1] for i in range(keys)]
        same = np.ones(t.num_rows, bool)
        for i in range(keys):
            same &= t.column(i).to_numpy() == last[i].as_py()
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def bounds(t: pa.Table, keys: int) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for i in range(keys):
        c = t.column(i).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), t.num_rows)


# Tables of fixed size, merged as a tree


def _blob(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _merged(rows: DataFrame, dtype: str, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[bytes]:
    """rows: slice, part, blob. Merges FAN_IN parts at a time, so that no task and no driver holds more; the parts in order."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        out = None
        for b in p["blob"]:
            a = np.frombuffer(zlib.decompress(b), dtype)
            out = a.copy() if out is None else merge(out, a)
        return pd.DataFrame({"slice": p["slice"].iloc[:1], "part": p["part"].iloc[:1] // FAN_IN, "blob": [_blob(out)]})

    most = rows.agg(F.max("part")).first()[0] or 0
    while True:
        rows = rows.groupBy("slice", (F.col("part") / FAN_IN).cast("int").alias("__g")).applyInPandas(one, "slice int, part int, blob binary")
        most //= FAN_IN
        if not most:
            return [zlib.decompress(r["blob"]) for r in sorted(rows.select("slice", "blob").collect(), key=lambda r: r["slice"])]
        rows = written(rows, "merged")


# The three passes over the texts


def _prints(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """kind 0: id, n, node, bits of each document; kind 1: part, slice and blob of each task's frequency table."""
    kind = docs.schema[id_col].dataType.simpleString()

    def bits(h: np.ndarray) -> bytes:
        size = 1 << max(6, int(len(h) - 1).bit_length())
        flags = np.zeros(size, np.uint8)
        x = h[(h >> np.uint64(20)) % np.uint64(4) == 0]
        flags[((x >> np.uint64(24)) % np.uint64(size)).astype(np.int64)] = 1
        return np.packbits(flags, bitorder="little").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table, seen, any_row = np.zeros(COUNTERS, np.uint32), set(), False
        names = ["kind", id_col, "n", "node", "bits", "part", "slice", "blob"]
        ids_type = None
        for b in batches:
            sizes, nodes, marks, fresh = [], [], [], []
            for h in shingle_sets(b.column(1), rule.words):
                node = set_print(h) if len(h) else None
                sizes.append(len(h))
                nodes.append(node)
                marks.append(bits(h) if len(h) else None)
                if len(h) and node not in seen:
                    seen.add(node)
                    fresh.append(h)
            if fresh:
                any_row = True
                table += np.bincount((np.concatenate(fresh) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            k, ids_type = len(sizes), b.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), b.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(marks, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if any_row:
            blobs = [_blob(x) for x in np.split(table, SLICES)]
            k = SLICES
            yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, ids_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([part] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    return docs.select(id_col, text_col).mapInArrow(frugal(work), f"kind int, `{id_col}` {kind}, n bigint, node bigint, bits binary, part int, slice int, blob binary")


def _index(docs: DataFrame, rule: Rule, frequent, text_col: str) -> DataFrame:  # noqa: ANN001
    """kind 0: key, node, n, place of each rare shingle in a prefix. kind 1: key of frequent shingles and node. kind 2: two nodes (key, node) that shared such a key in this task, which posts each key once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, held = np.frombuffer(frequent.value, bool), set(), {}
        for b in batches:
            keys, nodes, sizes, places, kinds = [], [], [], [], []
            for h in shingle_sets(b.column(0), rule.words):
                n = len(h)
                if not n or (node := set_print(h)) in seen:
                    continue
                seen.add(node)
                often = table[(h % np.uint64(COUNTERS)).astype(np.int64)]
                rare = h[~often]
                p = n - int(rule.least(n)) + 1
                take = rare[:p]
                keys.append(_signed(take))
                nodes.append(np.full(len(take), node))
                sizes.append(np.full(len(take), n))
                places.append(np.arange(len(take)))
                kinds.append(np.zeros(len(take), np.int64))
                if len(rare) >= p:
                    continue
                found, links = [], set()
                s = rule.size_class(n)
                for c in (s, s - 1):
                    two = rule.combined(c)
                    f = h[often][: p - len(rare) + two]
                    salt = np.uint64((c + 2) * 0x9E3779B9)
                    if two:
                        i, j = np.triu_indices(len(f), 1)
                        with np.errstate(over="ignore"):
                            ks = _mix(f[i] * np.uint64(0xC2B2AE3D27D4EB4F) + f[j] + salt)
                    else:
                        with np.errstate(over="ignore"):
                            ks = _mix(f + salt)
                    for k in _signed(ks).tolist():
                        other = held.get(k)
                        if other is None:
                            if len(held) < KEYS_HELD:  # else other tasks' rows join it, and so does this one
                                held[k] = node
                            found.append(k)
                        else:
                            links.add(other)
                keys += [np.array(found, np.int64), np.array(sorted(links), np.int64)]
                nodes += [np.full(len(found) + len(links), node)]
                sizes += [np.zeros(len(found) + len(links), np.int64)]
                places += [np.zeros(len(found) + len(links), np.int64)]
                kinds += [np.full(len(found), 1), np.full(len(links), 2)]
            if keys:
                cols = [np.concatenate(x) for x in (keys, kinds, nodes, sizes, places)]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(cols, types, strict=True)], names=["key", "kind", "node", "n", "place"])

    return docs.select(text_col).mapInArrow(frugal(work), "key bigint, kind int, node bigint, n int, place int")


def _sets(docs: DataFrame, rule: Rule, bloom, text_col: str) -> DataFrame:  # noqa: ANN001
    """node and set of the documents whose node is in the table of candidates (and of some that only seem to be)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.frombuffer(bloom.value, np.uint8), set()
        for b in batches:
            nodes, sets = [], []
            for h in shingle_sets(b.column(0), rule.words):
                if not len(h) or (node := set_print(h)) in seen:
                    continue
                seen.add(node)
                at = _bloom_places(np.array([node], np.int64))
                if ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all():
                    nodes.append(node)
                    sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.select(text_col).mapInArrow(frugal(work), "node bigint, shingles binary")


def _bloom_places(nodes: np.ndarray) -> np.ndarray:
    x = nodes.view(np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([_mix(x + np.uint64(k * 0x51ED27)) % np.uint64(BLOOM_BITS) for k in range(3)]).astype(np.int64)


def _bloom(nodes: DataFrame) -> bytes:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(BLOOM_BITS, bool)
        for b in batches:
            table[_bloom_places(b.column(0).to_numpy()).ravel()] = True
        part = TaskContext.get().partitionId()
        blobs = [_blob(x) for x in np.split(np.packbits(table, bitorder="little"), SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "part", "blob"])

    return b"".join(_merged(nodes.mapInArrow(frugal(work), "slice int, part int, blob binary"), "u1", np.bitwise_or))


# Candidates


def _candidates(rows: DataFrame, rule: Rule) -> DataFrame:
    """u, v, sure: pairs that share a rare shingle and pass the bounds on size and place (of runs in which most do, a sure star), and sure stars of nodes that share a key of frequent shingles.

    A run of a rare shingle is as long as its frequency, which the counters
    bound; one of a frequent key has a row for each task of the index at most.
    """

    def pairs(n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        us, vs, total = [], [], 0
        for at in range(0, len(n), 512):  # so many rows at a time bound the memory
            i = slice(at, at + 512)
            most = np.minimum(n[i, None] - place[i, None], n[None] - place[None])
            ok = (most >= rule.need(n[i, None] + n[None])) & (np.arange(at, min(at + 512, len(n)))[:, None] < np.arange(len(n))[None])
            a, b = np.nonzero(ok)
            us.append(a + at)
            vs.append(b)
            total += len(a)
            if len(n) > 8 and total > len(n) ** 2 / 4:
                return np.zeros(len(n) - 1, np.int64), np.arange(1, len(n)), True
        return np.concatenate(us), np.concatenate(vs), False

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            edge = bounds(t, 2)
            key, kind, node, n, place = (t.column(i).to_numpy() for i in range(5))
            out: dict[tuple[int, int], bool] = {}
            for k in np.flatnonzero((np.diff(edge) > 1) | (kind[edge[:-1]] == 2)):
                i = slice(edge[k], edge[k + 1])
                own, first = np.unique(node[i], return_index=True)
                if kind[edge[k]] == 2:
                    other = int(key[edge[k]])
                    out |= {(min(x, other), max(x, other)): True for x in own.tolist()}
                elif len(own) > 1 and kind[edge[k]] == 1:
                    out |= {(int(own[0]), x): True for x in own[1:].tolist()}
                elif len(own) > 1:
                    a, b, sure = pairs(n[i][first].astype(np.int64), place[i][first].astype(np.int64))
                    for x, y in zip(own[a].tolist(), own[b].tolist(), strict=True):
                        out[x, y] = out.get((x, y), False) or sure
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64()), pa.array(list(out.values()), pa.bool_())], names=["u", "v", "sure"])

    found = rows.repartition("key").sortWithinPartitions("key", "kind", "node").mapInArrow(frugal(work), "u bigint, v bigint, sure boolean")
    return found.groupBy("u", "v").agg(F.max("sure").alias("sure"))


def _likely(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose bit tables allow enough shared shingles. A bit set on one side only stands for a shingle at least that the other lacks."""

    def missing(x: bytes, y: bytes) -> tuple[int, int]:
        a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        if len(a) > len(b):
            a = np.bitwise_or.reduce(a.reshape(-1, len(b)), 0)
        elif len(b) > len(a):
            b = np.bitwise_or.reduce(b.reshape(-1, len(a)), 0)
        return int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, x, m, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                lone, other = missing(x, y)
                need = rule.need(n + m)
                keep.append(n - lone >= need and m - other >= need)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda k, name: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    joined = pairs.join(side("u", "u"), "u").join(side("v", "v"), "v").select("u", "v", "n_u", "bits_u", "n_v", "bits_v")
    return joined.mapInArrow(frugal(work), "u bigint, v bigint")


# Verification


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of incidence tables a bounded number of columns wide."""
    sizes = [len(x) for x in a] + [len(x) for x in b]
    values, column = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((len(a), len(b)), np.float64), 1 << 14
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        table = np.zeros((len(sizes), width), np.float32)
        table[row[lo:hi], column[lo:hi] - at] = 1
        out += table[: len(a)] @ table[len(a) :].T
    return out.astype(np.int64)


def linked(a: list[np.ndarray], b: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the sets that link."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    both = _overlaps(a, b)
    return np.nonzero(rule.den * both >= rule.num * (n[:, None] + m[None] - both))


def _verified(members: DataFrame, rule: Rule) -> DataFrame:
    """members: cluster, p, q, node, block, shingles; the blocks p and q of a cluster come together. u, v: what connects."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            edge = bounds(t, 3)
            us: list[int] = []
            vs: list[int] = []
            for k in range(len(edge) - 1):
                if edge[k + 1] - edge[k] < 2:
                    continue
                part = t.slice(edge[k], edge[k + 1] - edge[k])
                p, q = part.column(1)[0].as_py(), part.column(2)[0].as_py()
                node, block = part.column(3).to_pylist(), part.column(4).to_pylist()
                sets = [np.frombuffer(x, np.uint64) for x in part.column(5).to_pylist()]
                one = [i for i, x in enumerate(block) if x == p]
                two = one if p == q else [i for i, x in enumerate(block) if x == q]
                if not one or not two:
                    continue
                x, y = linked([sets[i] for i in one], [sets[i] for i in two], rule)
                root = list(range(len(node)))

                def find(i: int) -> int:
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    i, j = find(one[i]), find(two[j])
                    if i != j:
                        root[max(i, j)] = min(i, j)
                for i in range(len(node)):
                    if (r := find(i)) != i:
                        us.append(node[i])
                        vs.append(node[r])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return members.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q").mapInArrow(frugal(work), "u bigint, v bigint")


def _links(members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """u, v: what connects within the clusters (members: node, cluster, blocks, block).

    First each block is compared with itself and with its cluster's centre (the
    node it is named after), so a set is sent once. What links with the centre is
    one component by then, and only sets outside it are compared further: with
    each other, and with those inside. A group of copies around a centre costs as
    much as it has members; no pair that may link is left out.
    """
    held = members.join(sets, "node").groupBy("node").agg(*(F.first(c).alias(c) for c in ("cluster", "blocks", "block", "shingles")))  # a set may come once from each task
    held = written(held, "sets")
    own = held.select("cluster", F.col("block").alias("p"), F.col("block").alias("q"), "node", "block", "shingles")
    centre = held.where("node = cluster and blocks > 1").select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"), "node", F.col("block").alias("home"), "shingles").where("p <> home")
    first = written(_verified(own.union(centre.select("cluster", "p", F.col("p").alias("q"), "node", F.col("p").alias("block"), "shingles")), rule), "first_links")
    labels = components(first)
    each = lambda rows: rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")  # noqa: E731  so that joins deal a cluster by its blocks
    wide = held.where("blocks > 1").select("node", "cluster", "blocks", "block", F.length("shingles").alias("bytes")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    inner = each(wide.where("node = cluster").select("cluster", "blocks", F.col("component").alias("inner")))
    wide = written(wide.join(inner, ["cluster", "block"]).withColumn("outside", F.col("component") != F.col("inner")), "labelled")
    parts = wide.where("outside").groupBy("cluster").agg(F.first("blocks").alias("blocks"), F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("bytes") / (8 * BLOCK_SHINGLES))).cast("int").alias("parts"))
    left = wide.select("node", "cluster", "blocks", "block", "outside").join(each(parts), ["cluster", "block"])
    # Blocks 0 to parts - 1 hold what is outside, the others what is inside; every pair of blocks but those of two inner ones
    block = F.when(F.col("outside"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).otherwise(F.col("parts") + F.col("block"))
    last = F.when(F.col("outside"), F.col("parts") + F.col("blocks") - 1).otherwise(F.col("parts") - 1)
    left = written(left.select("node", "cluster", block.alias("block"), last.alias("last")), "left")
    spread = left.join(held.select("node", "shingles"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rest = _verified(spread.select("cluster", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "block", "shingles"), rule)
    return first.union(written(rest, "other_links"))


def _frequent(spark: SparkSession, table: DataFrame):  # noqa: ANN202
    blobs = table.where("kind = 1").select("slice", "part", "blob")
    counts = np.frombuffer(b"".join(_merged(blobs, "u4", np.add)), np.uint32) if blobs.limit(1).count() else np.zeros(COUNTERS, np.uint32)
    return spark.sparkContext.broadcast((counts > RARE + SLACK * counts.mean()).tobytes())


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Null and empty texts, and texts of blanks, have no shingles and link with
    nothing. Rows that repeat an id keep their own n_shingles; each belongs to the
    component of its own text. Equal texts are linked. Null ids link but never
    name a component; one alone gets null. No rows give no rows.

    Shingles and sets are compared by 64-bit hashes. The texts are read three
    times; the driver gets two tables of fixed size (4 MB each).
    """
    spark = docs.sparkSession
    small_batches(spark)
    table = written(_prints(docs, rule, id_col, text_col), "prints")
    own = table.where("kind = 0").select(id_col, "n", "node", "bits")
    nodes = written(own.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(id_col).alias("least"), F.count("*").alias("copies")), "nodes")
    pairs = written(_candidates(_index(docs, rule, _frequent(spark, table), text_col), rule), "candidates")
    edges = written(_likely(pairs.where("not sure").select("u", "v"), nodes, rule).union(pairs.where("sure").select("u", "v")), "likely")
    clusters = components(edges).select("node", F.col("component").alias("cluster"))
    inside = clusters.join(nodes.select("node", "n"), "node")
    # Written, so that its join can be split where a cluster is large; clusters of one block aren't in it
    sizes = written(inside.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1"), "sizes")
    blocks = F.coalesce("blocks", F.lit(1))
    members = written(clusters.join(sizes, "cluster", "left").select("node", "cluster", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")), "members")
    bloom = spark.sparkContext.broadcast(_bloom(members.select("node")))
    found = components(_links(members, _sets(docs, rule, bloom, text_col), rule)).withColumnRenamed("component", "group")
    least = nodes.select("node", "least", "copies").join(found, "node", "left")
    named = least.where("group is not null").groupBy("group").agg(F.min("least").alias("name"))
    ids = least.join(named, "group", "left").where((F.col("copies") > 1) | F.col("group").isNotNull()).select("node", F.coalesce("name", "least").alias("name"))
    return own.join(ids, "node", "left").select(id_col, F.col("n").alias("n_shingles"), F.coalesce("name", F.col(id_col)).alias("component_id"))


def keep_first(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's smallest, one for each group; rows without shingles stay.

    Of rows that repeat the kept id one by one all stay, as they are one document.
    """
    seen = near_duplicates(docs, rule, id_col, text_col)
    drop: Column = F.col("component_id") != F.col(id_col)
    gone = seen.where(drop).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)

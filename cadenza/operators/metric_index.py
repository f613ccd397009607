"""Exact nearest neighbours over a metric block index in shared files.

Vectors are clustered around reference points and written as blocks of bounded
size, one Arrow file each, under the shared folder.  The manifest keeps every
block's centre and ball radius.  A search task holds one unit of queries (as
many blocks as its memory allows), starts with the blocks nearest to them, and
reads another block only if the triangle inequality leaves it a candidate that
can beat some query's running k-th best.  So candidates are never shuffled and
never copied into tasks that do not need them; how often the rest is read
follows from the size of a unit alone.

The number of reference points grows with the vectors; they are fitted on a
bounded sample, and every vector is indexed.  A block that many vectors share a
reference with (copies, a hot group) is dealt to several files.

Inside a block the vectors lie in leaves, split at the mean of their widest
dimension.  Queries of one leaf are compared only with the leaves whose balls
can hold a candidate for one of them: first those whose ball is near enough to
the ball of the queries' leaf, then those near enough to a query.
"""
from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import shared_path

#: Vectors that the reference points are fitted on, at most.
SAMPLE = 16_384
#: Vectors of a block file, at least and at most, those of a leaf inside it, and bytes of one unit of queries.
LEAST_ROWS, BLOCK_ROWS, LEAF_ROWS = 1_024, 16_384, 128
UNIT_BYTES = 256 * 1024 * 1024
#: Partitions that the units are dealt to, at most, a core.
PARTITIONS_PER_CORE = 16
#: Score cells computed at a time, and those of a search (they stay in a core's cache).
CELLS, TILE = 4_000_000, 1 << 18
#: Scores are ordered after rounding to this many places; bounds leave room for it.
PLACES = 9
ROOM = 4e-9


# ---------------------------------------------------------------------- files
def store_of(uri: str):
    """File system and path of the shared folder."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@dataclass
class Block:
    """One block file: its vectors' pack (the groups it may hold), centre, ball radius and greatest norm."""

    pack: str
    ref: int
    name: str
    rows: int
    centre: np.ndarray
    radius: float
    norm: float
    zero: bool


@dataclass
class BlockIndex:
    folder: str
    dim: int
    blocks: list[Block] = field(default_factory=list)

    def table(self, name: str) -> pa.Table:
        store, base = store_of(self.folder)
        with store.open_input_file(f"{base}/{name}.arrow") as f:
            return pa.ipc.open_file(f).read_all()

    def matrix(self, t: pa.Table) -> np.ndarray:
        return t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), self.dim)

    def read(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, matrix and groups (or labels) of a block."""
        t = self.table(name)
        return t["id"].to_numpy(), self.matrix(t), t["grp"].to_pandas().to_numpy(dtype=object)

    def read_leaves(self, name: str, grouped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
        """ids, matrix, groups (if asked for) and the leaf of each vector of a block, by leaf."""
        t = self.table(name)
        return t["id"].to_numpy(), self.matrix(t), t["grp"].to_pandas().to_numpy(dtype=object) if grouped else None, t["leaf"].to_numpy()


# ------------------------------------------------------------------------ fit
def reference_points(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """k means of the sample, each next to a near one, so that neighbours in order are neighbours in space."""
    c = x[np.linspace(0, len(x) - 1, k).astype(np.int64)]
    for _ in range(rounds if k > 1 else 0):
        of = nearest(x, c)
        for j in np.unique(of):
            c[j] = x[of == j].mean(0)
    left, order = list(range(1, k)), [0]
    while left:
        at = int(((c[left] - c[order[-1]]) ** 2).sum(1).argmin())
        order.append(left.pop(at))
    return c[order]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, CELLS // len(c))
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[a : a + step] @ c.T - half).argmax(1) for a in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def leaves_of(x: np.ndarray, size: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by leaf, and the leaf of each row in that order; a leaf has at most ``size`` rows."""
    left, parts = [np.arange(len(x))], []
    while left:
        rows = left.pop()
        if len(rows) <= size:
            parts.append(rows)
            continue
        v = x[rows]
        v = v[:, v.var(0).argmax()]
        low = v <= v.mean()
        if low.all() or not low.any():  # copies
            low = np.arange(len(rows)) < len(rows) // 2
        left += [rows[~low], rows[low]]
    return np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), [len(r) for r in parts])


@dataclass
class Leaves:
    """Runs of rows that lie close together: first rows, centres, ball radii, greatest norms, and whether one holds a zero vector."""

    starts: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    zero: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, leaf: np.ndarray) -> "Leaves":
        starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        many = np.diff(np.append(starts, len(x)))
        centres = np.add.reduceat(x, starts, axis=0) / many[:, None]
        far = np.sqrt(((x - np.repeat(centres, many, axis=0)) ** 2).sum(1))
        norms = np.sqrt((x * x).sum(1))
        return cls(starts, centres, np.maximum.reduceat(far, starts), np.maximum.reduceat(norms, starts), np.minimum.reduceat(norms, starts) == 0)

    def some(self, at: np.ndarray) -> "Leaves":
        return Leaves(*(x[at] for x in (self.starts, self.centres, self.radius, self.norm, self.zero)))


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1.0)  # a zero vector stays zero -> similarity 0


def matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col.to_numpy()]) if len(col) else np.zeros((0, 0))


def fit_references(rows: DataFrame, n: int, metric: str, block_rows: int) -> np.ndarray:
    """Reference points for ``n`` rows (id, vec, grp), from a hashed sample of them."""
    some = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < math.ceil(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))
    x = matrix(rows.where(some).select("vec").toPandas()["vec"])
    if not len(x):
        return np.zeros((1, 1))
    x = unit_rows(x) if metric == "cosine" else x
    return reference_points(x, max(1, min(math.ceil(n / block_rows), len(x) // 8)))


# ---------------------------------------------------------------------- write
@dataclass
class Layout:
    """What an index of other vectors needs to be searched against this one: reference points, and where each group lies."""

    refs: np.ndarray
    large: DataFrame | None = None
    buckets: int = 1

    def pack(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``pack``: a group of its own if it fills a block, else a hash bucket that it shares with others."""
        if self.large is None:
            return rows.withColumn("pack", F.lit("all"))
        bucket = F.concat(F.lit("h:"), F.pmod(F.xxhash64("grp"), F.lit(self.buckets)).cast("string"))
        joined = rows.join(F.broadcast(self.large.withColumn("large", F.lit(True))), "grp", "left")
        return joined.withColumn("pack", F.when(F.col("large"), F.concat(F.lit("g:"), "grp")).otherwise(bucket)).drop("large")


def layout_of(rows: DataFrame, n: int, metric: str, grouped: bool, block_rows: int) -> Layout:
    refs = fit_references(rows, n, metric, block_rows)
    if not grouped:
        return Layout(refs)
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") >= block_rows).select("grp")  # at most n / block_rows groups
    return Layout(refs, large, math.ceil(max(n, 1) / block_rows))


def write_blocks(rows: DataFrame, refs: np.ndarray, metric: str, dim: int, block_rows: int, name: str) -> BlockIndex:
    """Write ``rows`` (id, vec, grp, pack) as block files and return the committed index.

    Files carry a random name, and only those of the returned manifest are
    read, so a task that runs twice does no harm.
    """
    spark = rows.sparkSession
    folder = shared_path(spark, f"blocks-{name}")
    given = spark.sparkContext.broadcast(refs)

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b["vec"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
                ref = nearest(unit_rows(x) if metric == "cosine" else x, given.value).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ref)], names=[*b.schema.names, "ref"])

    dealt = rows.select("id", "vec", "grp", "pack").mapInArrow(refer, "id long, vec array<double>, grp string, pack string, ref int")
    dealt = dealt.withColumn("ref", F.when(F.col("pack").startswith("h:"), 0).otherwise(F.col("ref")))
    sizes = dealt.groupBy("pack", "ref").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))  # as many rows as blocks
    dealt = dealt.join(F.broadcast(sizes), ["pack", "ref"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        held: list[pa.RecordBatch] = []

        def flush() -> dict:
            t = pa.Table.from_batches(held).combine_chunks()
            x = np.ascontiguousarray(t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim))
            x = unit_rows(x) if metric == "cosine" else x
            order, leaf = leaves_of(x)
            t, x = t.take(pa.array(order)), x[order]
            centre = x.mean(0)
            key, file = {c: t[c][0].as_py() for c in ("pack", "ref")}, uuid.uuid4().hex
            out = pa.table({"id": t["id"], "vec": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim), "grp": t["grp"], "leaf": pa.array(leaf)})
            with store.open_output_stream(f"{base}/{file}.arrow") as f, pa.ipc.new_file(f, out.schema) as w:
                w.write_table(out)
            radius, norms = np.sqrt(((x - centre) ** 2).sum(1).max()), np.sqrt((x * x).sum(1))
            return key | {"name": file, "rows": len(t), "centre": centre.tolist(), "radius": float(radius), "norm": float(norms.max()), "zero": bool((norms == 0).any())}

        for b in batches:
            if not b.num_rows:
                continue
            store.create_dir(base, recursive=True)
            keys = list(zip(*(b[c].to_pylist() for c in ("pack", "ref", "part"))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if held and tuple(held[-1][c][0].as_py() for c in ("pack", "ref", "part")) != keys[s]:
                    yield pa.RecordBatch.from_pylist([flush()], schema=_MANIFEST)
                    held = []
                held.append(b.slice(s, e - s))
        if held:
            yield pa.RecordBatch.from_pylist([flush()], schema=_MANIFEST)

    key = ["pack", "ref", "part"]
    files = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "id").select("id", "vec", "grp", *key).mapInArrow(write, _MANIFEST_DDL)
    path = shared_path(spark, f"manifest-{name}")
    files.write.parquet(path)
    found = spark.read.schema(_MANIFEST_DDL).parquet(path).collect()  # one row a block, with its centre
    blocks = [Block(r["pack"], r["ref"], r["name"], r["rows"], np.array(r["centre"]), r["radius"], r["norm"], r["zero"]) for r in found]
    return BlockIndex(folder, dim, sorted(blocks, key=lambda b: (b.pack, b.ref, b.name)))


_MANIFEST = pa.schema([("pack", pa.string()), ("ref", pa.int32()), ("name", pa.string()), ("rows", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("norm", pa.float64()), ("zero", pa.bool_())])
_MANIFEST_DDL = "pack string, ref int, name string, rows bigint, centre array<double>, radius double, norm double, zero boolean"


# --------------------------------------------------------------------- bounds
def best_possible(q: np.ndarray, b: Block, metric: str) -> np.ndarray:
    """Upper bound of each query's value (score, or negative distance) over a block, by the triangle inequality."""
    far = np.sqrt(np.maximum(((q - b.centre) ** 2).sum(1), 0.0))
    gap = np.maximum(far - b.radius, 0.0)
    if metric == "euclidean":
        return -gap + ROOM * (1 + far)
    norm = np.sqrt((q * q).sum(1))
    inner = q @ b.centre + norm * b.radius  # q.c = q.m + q.(c - m)
    if metric == "cosine":  # unit vectors: their product falls with the square of their distance
        by_distance = 1 - gap * gap / 2
        inner = np.minimum(inner, np.maximum(by_distance, 0.0) if b.zero else np.where(norm > 0, by_distance, 0.0))
    return inner + ROOM * (1 + norm * b.norm)


def best_in_leaves(q: np.ndarray, b: Leaves, metric: str) -> np.ndarray:
    """``best_possible`` of each query for each leaf."""
    qq, cc, inner = (q * q).sum(1)[:, None], (b.centres * b.centres).sum(1)[None, :], q @ b.centres.T
    far = np.sqrt(np.maximum((qq + cc) * (1 - 1e-12) - 2.0 * inner, 0.0))  # never more than the distance
    gap = np.maximum(far - b.radius, 0.0)
    if metric == "euclidean":
        return -gap + ROOM * (1 + far)
    norm = np.sqrt(qq)
    inner = inner + norm * b.radius
    if metric == "cosine":
        by_distance = 1 - gap * gap / 2
        inner = np.minimum(inner, np.where(b.zero, np.maximum(by_distance, 0.0), np.where(norm > 0, by_distance, 0.0)))
    return inner + ROOM * (1 + norm * b.norm)


def best_of_leaves(a: Leaves, b: Leaves, metric: str) -> np.ndarray:
    """Upper bound of every value between a vector of each leaf of ``a`` and one of each leaf of ``b``."""
    aa, bb, inner = (a.centres * a.centres).sum(1)[:, None], (b.centres * b.centres).sum(1)[None, :], a.centres @ b.centres.T
    if metric == "dot":
        room = np.sqrt(aa) * b.radius + a.radius[:, None] * np.sqrt(bb) + a.radius[:, None] * b.radius
        return inner + room + ROOM * (1 + a.norm[:, None] * b.norm)
    far = np.sqrt(np.maximum((aa + bb) * (1 - 1e-12) - 2.0 * inner, 0.0))
    gap = np.maximum(far - a.radius[:, None] - b.radius, 0.0)
    if metric == "euclidean":
        return -gap + ROOM * (1 + far + a.radius[:, None])
    by_distance = 1 - gap * gap / 2
    return np.where(a.zero[:, None] | b.zero, np.maximum(by_distance, 0.0), by_distance) + ROOM * (1 + a.norm[:, None] * b.norm)


def values(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Larger is better; cosine takes unit rows."""
    if metric == "euclidean":
        inner, d = 2.0 * q @ c.T, (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :]
        np.subtract(d, inner, out=d)
        np.sqrt(np.maximum(d, 0.0, out=d), out=d)
        return np.negative(d, out=d)
    return q @ c.T


def top_rows(val: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (value, id) of each row by (rounded value, id); -inf and -1 where there are fewer."""
    m, n = val.shape
    if n > k:
        part = np.argpartition(val, n - k, axis=1)[:, n - k :]
        top = np.take_along_axis(val, part, 1)
        least = top.min(1)
        tied = np.flatnonzero((val >= (least - ROOM)[:, None]).sum(1) > k)  # more rows than places near the last place
        v, i = order_rows(top, ids[part])
        for r in tied:
            near = np.flatnonzero(val[r] >= least[r] - ROOM)
            a, b = order_rows(val[r : r + 1, near], ids[None, near])
            v[r], i[r] = a[0, :k], b[0, :k]
    else:
        v, i = order_rows(val, np.broadcast_to(ids, val.shape))
        v = np.pad(v, ((0, 0), (0, k - n)), constant_values=-np.inf)
        i = np.pad(i, ((0, 0), (0, k - n)), constant_values=-1)
    return v, np.where(np.isfinite(v), i, -1)


def order_rows(val: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -np.round(val, PLACES)), axis=-1)
    return np.take_along_axis(val, order, 1), np.take_along_axis(np.ascontiguousarray(ids), order, 1)


# --------------------------------------------------------------------- search
def units_of(index: BlockIndex, unit_rows_: int) -> list[list[Block]]:
    """Blocks put together in order, inside a pack, up to ``unit_rows_`` vectors."""
    units: list[list[Block]] = []
    for b in index.blocks:
        last = units[-1] if units else None
        if last and last[0].pack == b.pack and sum(x.rows for x in last) + b.rows <= unit_rows_:
            last.append(b)
        else:
            units.append([b])
    return units


def read_unit(index: BlockIndex, unit: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [index.read(b.name) for b in unit]
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def read_unit_leaves(index: BlockIndex, unit: list[Block], grouped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    parts = [index.read_leaves(b.name, grouped) for b in unit]
    leaf = np.concatenate([p[3].astype(np.int64) + i * (1 << 32) for i, p in enumerate(parts)])
    return *(np.concatenate([p[i] for p in parts]) if p_ else None for i, p_ in enumerate((True, True, grouped))), leaf


class Running:
    """The k best candidates so far of the queries of one unit; ``leaf`` numbers their runs that lie close together."""

    def __init__(self, ids, q, groups, k: int, metric: str, exclude_self: bool, leaf: np.ndarray | None = None):
        self.ids, self.q, self.groups, self.k, self.metric, self.exclude_self = ids, q, groups, k, metric, exclude_self
        self.leaf = np.zeros(len(ids), np.int64) if leaf is None else leaf
        self.run = np.cumsum(np.concatenate([[False], self.leaf[1:] != self.leaf[:-1]])) if len(ids) else np.zeros(0, np.int64)
        self.runs = Leaves.of(q, self.leaf) if len(ids) else None
        self.val, self.best = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
        self.shared = np.zeros((len(ids), k), bool)  # from a block that other tasks of the unit read too

    def runs_wanting(self, blocks: list[Block]) -> np.ndarray:
        """Whether the ball of each run is near enough to that of each block."""
        if self.runs is None:
            return np.zeros((0, len(blocks)), bool)
        balls = Leaves(np.zeros(len(blocks), np.int64), np.stack([b.centre for b in blocks]), *(np.array([getattr(b, c) for b in blocks]) for c in ("radius", "norm", "zero")))
        return best_of_leaves(self.runs, balls, self.metric) >= np.minimum.reduceat(self.val[:, -1], self.runs.starts)[:, None]

    def wants(self, b: Block, among: np.ndarray | None = None) -> np.ndarray:
        """Queries (of those ``among``) that a candidate of the block could still serve."""
        able = self.runs_wanting([b])[:, 0][self.run]
        at = np.flatnonzero(able if among is None else able & among)
        step = max(1, CELLS // self.q.shape[1])
        keep = [best_possible(self.q[at[a : a + step]], b, self.metric) >= self.val[at[a : a + step], -1] for a in range(0, len(at), step)]
        return at[np.concatenate(keep)] if keep else at

    def offer(self, rows: np.ndarray, ids: np.ndarray, c: np.ndarray, groups: np.ndarray | None, shared: bool = False, leaves: Leaves | None = None) -> None:
        if not len(rows):
            return
        mine = self.exclude_self and bool(np.isin(ids, self.ids[rows]).any())  # a block without the queries themselves needs no look for them
        if leaves is None or len(leaves.starts) < 4:
            return self._offer(rows, ids, c, groups, shared, mine)
        many = np.diff(np.append(leaves.starts, len(ids)))
        cuts = np.flatnonzero(np.concatenate([[True], self.run[rows][1:] != self.run[rows][:-1]]))
        least = np.minimum.reduceat(self.val[rows, -1], cuts)
        bound = best_of_leaves(self.runs.some(self.run[rows[cuts]]), leaves, self.metric)
        for r, kth, best in zip(np.split(rows, cuts[1:]), least, bound):
            if kth == -np.inf:  # start from the nearest leaves
                near = ((leaves.centres - self.q[r].mean(0)) ** 2).sum(1).argsort(kind="stable")
                first = near[: int(np.searchsorted(np.cumsum(many[near]), 4 * self.k)) + 1]
                self._offer_leaves(r, ids, c, groups, shared, np.sort(first), leaves, many, mine)
                kth = self.val[r, -1].min()
                best[first] = -np.inf  # done
            left = np.flatnonzero((best >= kth) & (best > -np.inf))
            if len(left):
                wanted = (best_in_leaves(self.q[r], leaves.some(left), self.metric) >= self.val[r, -1:]).any(0)
                self._offer_leaves(r, ids, c, groups, shared, left[wanted], leaves, many, mine)

    def _offer_leaves(self, rows, ids, c, groups, shared, which: np.ndarray, leaves: Leaves, many: np.ndarray, mine: bool) -> None:
        if len(which) == len(many):
            self._offer(rows, ids, c, groups, shared, mine)
        elif len(which):
            at = np.concatenate([np.arange(s, s + n) for s, n in zip(leaves.starts[which], many[which])])
            self._offer(rows, ids[at], c[at], None if groups is None else groups[at], shared, mine)

    def _offer(self, rows: np.ndarray, ids: np.ndarray, c: np.ndarray, groups: np.ndarray | None, shared: bool, mine: bool) -> None:
        step = max(1, TILE // max(1, len(ids)))
        for a in range(0, len(rows), step):
            r = rows[a : a + step]
            val = values(self.q[r], c, self.metric)
            if mine:
                val[self.ids[r][:, None] == ids[None, :]] = -np.inf
            if groups is not None:
                val[self.groups[r][:, None] != groups[None, :]] = -np.inf
            able = (val >= (self.val[r, -1] - ROOM)[:, None]) & np.isfinite(val)
            many = able.sum(1)
            need = many > 0  # the others have no candidate here
            if not need.any():
                continue
            if not need.all():
                r, val, able, many = r[need], val[need], able[need], many[need]
            if (most := int(many.max())) <= 4 * self.k:  # few are as good as a row's last one
                i, j = np.nonzero(able)
                at = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                v, found = np.full((len(r), most), -np.inf), np.full((len(r), most), -1, np.int64)
                v[i, at], found[i, at] = val[i, j], ids[j]
            else:
                val[~np.isfinite(val)] = -np.inf
                v, found = top_rows(val, ids, self.k)
            both = [np.concatenate(y, 1) for y in ((self.val[r], v), (self.best[r], found), (self.shared[r], np.full(found.shape, shared)))]
            order = np.lexsort((both[1], -np.round(both[0], PLACES)), axis=-1)[:, : self.k]
            self.val[r], self.best[r], self.shared[r] = (np.take_along_axis(y, order, 1) for y in both)

    def frame(self, shared: bool) -> pd.DataFrame:
        """The rows found; what all tasks of a unit have found is given by one of them."""
        r, j = np.nonzero(np.isfinite(self.val) & (shared | ~self.shared))
        v = self.val[r, j]
        return pd.DataFrame({"qid": self.ids[r], "cid": self.best[r, j], "score": -v if self.metric == "euclidean" else v, "blocks": None, "read": None})


_OUT = "qid long, cid long, score double, blocks long, read long"


def search_index(spark: SparkSession, queries: BlockIndex, candidates: BlockIndex, *, k: int, metric: str, exclude_self: bool, grouped: bool, unit_rows_: int) -> DataFrame:
    """(qid, cid, score) of each unit's best, and one row a task with only ``blocks`` it could have read and ``read``.

    A unit starts with the block nearest to each query, so that most others are
    left out by their bounds.  With fewer units than cores every unit is dealt to
    several tasks, each with a share of the candidate blocks; all start from the
    unit's own blocks' best.
    """
    units = units_of(queries, unit_rows_)
    shares = max(1, min(2 * spark.sparkContext.defaultParallelism // max(1, len(units)), len(candidates.blocks)))
    tasks = [(i, u, s) for i, (u, s) in enumerate((u, s) for u in range(len(units)) for s in range(shares))]
    given = spark.sparkContext.broadcast((queries, candidates, units))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, other, all_units = given.value
        for pdf in frames:
            for u, s in zip(pdf["unit"], pdf["share"]):
                unit = all_units[u]
                ids, q, groups, leaf = read_unit_leaves(own, unit, grouped)
                state = Running(ids, q, groups, k, metric, exclude_self, leaf)
                mine = [b for b in other.blocks if b.pack == unit[0].pack]
                middle = np.average([b.centre for b in unit], axis=0, weights=[b.rows for b in unit])
                order = sorted(range(len(mine)), key=lambda j: (float(((mine[j].centre - middle) ** 2).sum()), mine[j].name))
                near, first = None, order[: len(unit)]  # every task of the unit starts from these
                if shares == 1 and mine:  # or each query from its nearest block
                    near, first = nearest(q, np.stack([b.centre for b in mine])), []
                steps = [(j, 0) for j in first] if near is None else [(int(j), 1) for j in np.unique(near)]
                steps += [(j, 2) for j in order[len(first) :][s::shares]]
                able, read = None, set()
                for j, kind in steps:
                    if kind == 2 and able is None:
                        able = state.runs_wanting(mine).any(0)
                    if kind == 2 and not able[j]:
                        continue
                    b = mine[j]
                    rows = np.flatnonzero(near == j) if kind == 1 else state.wants(b, None if near is None else near != j)
                    if len(rows):
                        cid, c, cg, cl = other.read_leaves(b.name, grouped)
                        state.offer(rows, cid, c, cg, kind == 0, Leaves.of(c, cl) if len(cid) > LEAF_ROWS * 2 else None)
                        read.add(j)
                yield state.frame(s == 0)
                yield pd.DataFrame({"qid": [None], "cid": [None], "score": [None], "blocks": [len({j for j, _ in steps})], "read": [len(read)]})

    parts = max(1, min(len(tasks), PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism))
    todo = spark.createDataFrame(tasks, "at int, unit int, share int")
    return todo.repartitionById(parts, F.pmod("at", F.lit(parts)).cast("int")).mapInPandas(scan, _OUT)


def block_index(rows: DataFrame, n: int, dim: int, *, metric: str, layout: Layout | None = None, grouped: bool = False, block_rows: int | None = None, name: str = "vectors") -> tuple[BlockIndex, Layout]:
    """Index of ``rows`` (id, vec, grp) and its layout (a given one, or fitted)."""
    size = block_rows or block_rows_of(n, rows.sparkSession)
    # a vector with a component that is null, NaN or infinite has no finite score with any other
    finite = rows.where((F.size("vec") == dim) & ~F.exists("vec", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == math.inf), F.lit(True))))
    layout = layout or layout_of(finite, n, metric, grouped, size)
    return write_blocks(layout.pack(finite), layout.refs, metric, dim, size, name), layout


def block_rows_of(n: int, spark: SparkSession) -> int:
    """Vectors of a block: few enough that every core has some blocks."""
    return max(LEAST_ROWS, min(BLOCK_ROWS, math.ceil(n / (4 * spark.sparkContext.defaultParallelism))))


def unit_rows_of(dim: int, block_rows: int | None = None, per_task: int | None = None) -> int:
    """Queries of one unit: what memory allows, but no more than a task's share."""
    return block_rows or max(1, min(UNIT_BYTES // (8 * max(1, dim)), per_task or UNIT_BYTES))

"""Embedding near-duplicates through a robust-pruned flat graph.

1. *Classes.*  Equal vectors collapse to one class with its number of copies.
2. *Balls.*  Centres are fitted on a bounded sample.  Every class within half
   the linking angle of a ball's centre joins that ball; two members of a ball
   always link (triangle inequality), so a group of near copies of any size is
   counted without looking at its pairs.  Classes near a ball but outside it
   are compared with its members in tiles, unless the angles already decide.
3. *Build.*  All other classes join the two nearest of the sample's cluster
   centres, so that cluster shards overlap.  Inside a shard (in tiles of two
   parts where it is large) every class gets its nearest neighbours and some
   random ones, robustly pruned: a neighbour goes if another one, kept before,
   is nearer to it by the factor ``ALPHA``.  Reverse edges are added.
4. *Union.*  The adjacency lists of all shards are united by class.
5. *Search.*  Each class searches its home shard over the united lists:
   greedily with a beam from the shard's medoid, then on from every class found
   within range (itself included) until none is new.  Edges that leave the
   shard are followed where the angles allow a link, and verified by a join.
6. *Audit.*  The links of a hashed sample of classes are counted by brute force
   against all classes; while recall is below ``TARGET`` the beam is doubled.
7. *Verify.*  Every link is checked by its cosine in double precision.

Links inside a shard leave a task as counts and a spanning forest, never as
all pairs; only links between homes become rows.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, link with nothing (n_links 0, their own component);
vectors of different dimension do not link; rows that share a vec_id are
vectors of their own; rows without a vec_id count and link, and a component
without any vec_id has component_id null; an empty table gives no rows.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import join_skewed, materialise, tables_by_key
from cadenza.llm.simhash import components

#: Classes of the fitting sample, and of its part that balls are looked for in.
SAMPLE, BALL_SAMPLE = 65_536, 8_192
#: Least sample members of a ball, and most balls.
BALL_LEAST, MAX_BALLS = 8, 1024
#: Classes wanted in a shard, classes of one part of a tile, rows of a part of a ball's surroundings.
SHARD, PART, SHELL = 2_048, 4_096, 65_536
#: Neighbours and random classes offered to pruning, edges kept, pruning factor (of distances).
OFFERED, RANDOM, DEGREE, ALPHA = 32, 8, 16, 1.2
#: First beam of the search, queries searched together, audited classes, recall wanted, audits.
BEAM, TOGETHER, AUDIT, TARGET, AUDITS = 24, 256, 256, 0.95, 3
#: Angles nearer to a bound than this are not decided by the triangle inequality.
SLACK = 1e-6


# -------------------------------------------------------------------- vectors
def vector_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): the components as little-endian float32 or float64; null if the vector cannot link."""
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind, size = (np.float32, 4) if single else (np.float64, 8)

    def pack(batches):
        for b in batches:
            lists = b["vec"]
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().cast(pa.from_numpy_dtype(kind)).to_numpy(zero_copy_only=False).astype(kind)  # null reads as NaN
            cuts = np.concatenate([[0], np.cumsum(n)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            good = (bad[cuts[1:]] == bad[cuts[:-1]]) & (some[cuts[1:]] > some[cuts[:-1]])
            raw = values.tobytes()
            packed = [raw[a * size : e * size] if g else None for a, e, g in zip(cuts[:-1].tolist(), cuts[1:].tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(packed, pa.binary())], names=["vec_id", "vec"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))
    return rows.mapInArrow(pack, "vec_id bigint, vec binary").select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Packed vectors of one dimension as unit rows in double precision; ``width`` is the bytes of a component."""
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, np.float32 if width == 4 else np.float64).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angle(cosine):
    return np.arccos(np.clip(cosine, -1.0, 1.0))


# ------------------------------------------------------------------------ fit
def find_balls(x: np.ndarray, radius: float, least: int, most: int) -> np.ndarray:
    """Centres of groups of ``least`` sample rows or more within ``radius`` of one row, largest first."""
    near = math.cos(radius)
    rows = np.concatenate([(x[a : a + 1024] @ x.T >= near).sum(1) for a in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)
    centres, free = [], np.ones(len(x), bool)
    for i in np.argsort(-rows, kind="stable"):
        if rows[i] < least or len(centres) == most:
            break
        if not free[i]:
            continue
        mine = free & (x @ x[i] >= near)
        if mine.sum() < least:
            continue
        c = x[mine].mean(0)
        c /= np.linalg.norm(c)
        free &= ~(mine | (x @ c >= near))
        centres.append(c)
    return np.array(centres).reshape(-1, x.shape[1])


def cluster_centres(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means on the sample, started from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(np.int64)]
    for _ in range(rounds if k > 1 else 0):
        of = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        order = np.argsort(of, kind="stable")
        start = np.searchsorted(of[order], np.arange(k))
        full = np.diff(np.append(start, len(x))) > 0
        sums = np.add.reduceat(x[order], start[full], axis=0)
        c = c.copy()
        c[full] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


# --------------------------------------------------------------------- assign
def assign(classes: DataFrame, given, width: int, theta: float) -> DataFrame:
    """Classes with ``ball`` (-1: none) and its ``angle``, other balls ``near``, and the shards ``home`` and ``second``."""
    rho = (theta - SLACK) / 2
    names = ["node", "copies", "least", "h1", "h2", "vec"]

    def deal(batches):
        balls, centres = given.value
        for b in batches:
            x = unit_rows(b["vec"], width)
            ball, angle, near = np.full(len(x), -1), np.zeros(len(x)), [[]] * len(x)
            if len(balls):
                far = _angle(x @ balls.T)
                best = far.argmin(1)
                angle = far[np.arange(len(x)), best]
                ball = np.where(angle <= rho, best, -1)
                around = far <= theta + rho + SLACK
                around[np.arange(len(x)), best] &= ball < 0
                near = [[{"ball": int(j), "angle": float(far[i, j])} for j in np.flatnonzero(row)] if row.any() else [] for i, row in enumerate(around)]
            s = x @ centres.T
            home = s.argmax(1)
            s[np.arange(len(x)), home] = -2
            second = s.argmax(1) if s.shape[1] > 1 else home
            cols = [pa.array(ball, pa.int32()), pa.array(angle), pa.array(near, pa.list_(pa.struct([("ball", pa.int32()), ("angle", pa.float64())]))), pa.array(home, pa.int32()), pa.array(second, pa.int32())]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], *cols], names=[*names, "ball", "angle", "near", "home", "second"])

    return classes.select(*names).mapInArrow(deal, "node bigint, copies bigint, least bigint, h1 bigint, h2 bigint, vec binary, ball int, angle double, near array<struct<ball:int,angle:double>>, home int, second int")


# ---------------------------------------------------------------------- balls
def ball_links(assigned: DataFrame, balls: list, width: int, theta: float) -> tuple[DataFrame, DataFrame]:
    """(node, add) links between classes and balls they are not in, and (u, v) one link a class and ball; balls are -1 - ball."""
    spark = assigned.sparkSession
    facts = spark.createDataFrame([(r["ball"], float(r["radius"]), r["copies"], r["members"]) for r in balls], "ball int, radius double, in_ball bigint, members bigint")
    own = F.when(F.col("own") >= 0, -1 - F.col("own")).otherwise(F.col("node")).cast("bigint")
    near = assigned.select("node", "copies", "vec", F.col("ball").alias("own"), F.explode("near").alias("n")).select("node", "copies", "vec", "own", "n.ball", "n.angle")
    near = near.join(F.broadcast(facts), "ball").where(F.col("angle") <= theta + F.col("radius") + SLACK)
    all_link = F.col("angle") + F.col("radius") <= theta - SLACK
    near = near.withColumn("sure", all_link)
    sure = near.where("sure")
    adds = sure.select("node", F.col("in_ball").alias("add"))
    # what a class outside all balls adds to each member: one number a ball (members of balls count for themselves)
    each = sure.where("own < 0").groupBy("ball").agg(F.sum("copies").alias("add"))
    adds = adds.unionByName(assigned.select("node", "ball").join(F.broadcast(each), "ball").select("node", "add"))
    links = sure.select(own.alias("u"), (-1 - F.col("ball")).cast("bigint").alias("v"))

    open_ = near.where(~F.col("sure"))
    sizes = open_.groupBy("ball").agg(F.count(F.lit(1)).alias("outer")).join(F.broadcast(facts), "ball")  # one row a ball
    cuts = sizes.select("ball", F.ceil(F.col("outer") / SHELL).cast("int").alias("outer_parts"), F.ceil(F.col("members") / PART).cast("int").alias("inner_parts"))
    part = lambda n: F.pmod(F.xxhash64(F.lit(5), "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inner = assigned.select("node", "copies", "vec", "ball", F.lit(-1).alias("own")).join(F.broadcast(cuts), "ball")
    inner = inner.select("ball", part("inner_parts").alias("i"), every("outer_parts").alias("o"), F.lit(0).alias("side"), "node", "copies", "own", "vec")
    outer = open_.select("ball", "node", "copies", "own", "vec").join(F.broadcast(cuts), "ball")
    outer = outer.select("ball", every("inner_parts").alias("i"), part("outer_parts").alias("o"), F.lit(1).alias("side"), "node", "copies", "own", "vec")
    keys = ["ball", "i", "o"]
    schema = pa.schema([("node", pa.int64()), ("add", pa.int64()), ("own", pa.int32()), ("ball", pa.int32())])

    def compare(batches):
        at, x, inside, total, held = None, None, None, None, []

        def members():
            t = pa.Table.from_batches(held)
            return unit_rows(t["vec"].combine_chunks(), width), t["node"].to_numpy(), t["copies"].to_numpy()

        for t in tables_by_key(batches, [*keys, "side"]):
            key = tuple(t[k][0].as_py() for k in keys)
            if t["side"][0].as_py() == 0:
                if at is not None and inside is not None and total.any():
                    yield pa.RecordBatch.from_arrays([pa.array(inside), pa.array(total), pa.nulls(len(inside), pa.int32()), pa.nulls(len(inside), pa.int32())], schema=schema)
                held = t.to_batches()
                x, inside, copies = members()
                total, at = np.zeros(len(inside), np.int64), key
                continue
            if key != at:
                continue
            for b in t.to_batches(max_chunksize=2048):
                link = unit_rows(b["vec"], width) @ x.T >= math.cos(theta)
                c, own_ = b["copies"].to_numpy(), b["own"].to_numpy()
                total += (link[own_ < 0].T @ c[own_ < 0]).astype(np.int64)
                add = link @ copies
                some = add > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(b["node"].to_numpy()[some]), pa.array(add[some].astype(np.int64)), pa.array(own_[some], pa.int32()), pa.array(np.full(some.sum(), key[0]), pa.int32())], schema=schema)
        if at is not None and total.any():
            yield pa.RecordBatch.from_arrays([pa.array(inside), pa.array(total), pa.nulls(len(inside), pa.int32()), pa.nulls(len(inside), pa.int32())], schema=schema)

    dealt = inner.unionByName(outer).repartition(_partitions(spark), *keys).sortWithinPartitions(*keys, "side")
    checked = materialise(dealt.mapInArrow(compare, "node bigint, add bigint, own int, ball int"), "shell")
    found = checked.where("ball is not null").select(own.alias("u"), (-1 - F.col("ball")).cast("bigint").alias("v"))
    return adds.unionByName(checked.select("node", "add")), links.unionByName(found).distinct()


# ---------------------------------------------------------------------- build
def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shard_tiles(plain: DataFrame) -> DataFrame:
    """(shard, a, b, part, node, copies, home, vec): the members of each shard, dealt to tiles of parts a <= b."""
    members = plain.withColumn("shard", F.explode(F.array_distinct(F.array("home", "second"))))
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # one row a centre
    members = members.join(F.broadcast(sizes), "shard").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts")).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, "part").alias("a"), F.greatest(q, "part").alias("b")))
    names = [c for c in plain.columns if c not in ("second",)]
    return members.select("shard", "part", *names, F.explode(tile).alias("t")).select("shard", "t.a", "t.b", "part", *names)


def robust_prune(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Mask of the candidates that stay: rows of ``cand`` are nearest first, ``sim`` is -2 where there is none."""
    keep = np.zeros(cand.shape, bool)
    for s in range(0, len(cand), 256):
        c, own = x[cand[s : s + 256]], sim[s : s + 256]
        between = c @ c.transpose(0, 2, 1)
        alive, many = own > -1.5, np.zeros(len(c), np.int64)
        for j in range(cand.shape[1]):
            pick = alive[:, j] & (many < degree)
            keep[s : s + 256, j] = pick
            many += pick
            alive &= ~(pick[:, None] & (alpha**2 * (1 - between[:, j]) <= 1 - own))  # squared distances are 2 - 2 cos
    return keep


def build_edges(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, target, cosine) of the pruned graph over unit rows, both directions."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    y, c = x.astype(np.float32), min(OFFERED, n - 1)
    near = np.empty((n, c), np.int64)
    for a in range(0, n, 512):
        s = y[a : a + 512] @ y.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near[a : a + 512] = np.argpartition(s, n - c, axis=1)[:, n - c :]
    cand = np.sort(np.concatenate([near, np.random.default_rng(seed).integers(0, n, (n, RANDOM))], 1), axis=1)
    sim = np.einsum("ijk,ik->ij", y[cand], y) if n * cand.shape[1] < 1 << 16 else np.concatenate([np.einsum("ijk,ik->ij", y[cand[a : a + 1024]], y[a : a + 1024]) for a in range(0, n, 1024)])
    sim[cand == np.arange(n)[:, None]] = -2
    sim[:, 1:][cand[:, 1:] == cand[:, :-1]] = -2
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    i, j = np.nonzero(robust_prune(y, cand, sim, DEGREE, ALPHA))
    to = cand[i, j]
    code = np.unique(np.concatenate([i * n + to, to * n + i]))
    u, v = code // n, code % n
    return u, v, np.einsum("ij,ij->i", y[u], y[v])


def build_graph(tiles: DataFrame, width: int) -> DataFrame:
    """(node, edges): the adjacency lists of all tiles united by class; an edge is (dst, home of dst, cosine)."""
    keys = ["shard", "a", "b"]
    edge = pa.struct([("dst", pa.int64()), ("home", pa.int32()), ("cosine", pa.float32())])

    def build(batches):
        for t in tables_by_key(batches, keys):
            node, home = t["node"].to_numpy(), t["home"].to_numpy()
            u, v, s = build_edges(unit_rows(t["vec"].combine_chunks(), width), t["shard"][0].as_py())
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(u, np.arange(len(node) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(node[v]), pa.array(home[v], pa.int32()), pa.array(s, pa.float32())], fields=list(edge)))
            yield pa.RecordBatch.from_arrays([pa.array(node), lists], names=["node", "edges"])

    # (the random classes depend on the order in a tile, so that is fixed too)
    dealt = tiles.select(*keys, "node", "home", "vec").repartition(_partitions(tiles.sparkSession), *keys).sortWithinPartitions(*keys, "node")
    built = dealt.mapInArrow(build, "node bigint, edges array<struct<dst:bigint,home:int,cosine:float>>")
    return materialise(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")), "graph")


# --------------------------------------------------------------------- search
def range_search(x: np.ndarray, adjacent: np.ndarray, queries: np.ndarray, medoid: int, beam: int, least: float) -> np.ndarray:
    """Cosines (queries x rows, -2: not looked at) that greedy search and range expansion have met.

    ``adjacent`` holds the neighbours of each row, padded with -1.
    """
    n, many, q = len(x), len(queries), x[queries]
    seen = np.full((many, n + 1), -2, np.float32)  # the last column takes the padding
    who = np.arange(many)

    def look(i: np.ndarray, v: np.ndarray) -> None:
        for s in range(0, len(i), 1 << 17):
            a, b = i[s : s + (1 << 17)], v[s : s + (1 << 17)]
            seen[a, b] = np.einsum("ij,ij->i", q[a], x[b])

    def fresh(i: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours of v not yet looked at for query i, each once."""
        to = adjacent[v]
        code = (i[:, None] * n + to)[(to >= 0) & (seen[i[:, None], to] < -1.5)]
        code = np.unique(code)
        return code // n, code % n

    seen[:, n] = 0
    look(who, np.full(many, medoid))
    look(who, queries)
    # greedy: always on from the best row of the beam that is not yet expanded
    pool = np.concatenate([np.full((many, 1), medoid), queries[:, None]], 1)
    done = np.zeros((many, n + 1), bool)
    done[:, n] = True
    active = who
    while len(active):
        score = np.where(done[active[:, None], pool[active]], -3, seen[active[:, None], pool[active]])
        at = score.argmax(1)
        go = score[np.arange(len(active)), at] > -1.5
        active, at = active[go], at[go]
        v = pool[active, at]
        done[active, v] = True
        i, w = fresh(active, v)
        look(i, w)
        if len(i):
            width = np.bincount(i, minlength=many)
            place = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)[: len(i)]
            new = np.full((many, width.max()), n)
            new[i, place] = w
            pool = np.concatenate([pool, new], 1)
            if pool.shape[1] > beam:
                rank = np.where(pool == n, np.float32(-9), seen[who[:, None], pool])
                pool = np.take_along_axis(pool, np.argpartition(-rank, beam - 1, axis=1)[:, :beam], 1)
    # range: on from everything in range until nothing is new
    hit = seen[:, :n] >= least
    i, v = np.nonzero(hit & ~done[:, :n])
    while len(i):
        done[i, v] = True
        met = []
        for s in range(0, len(i), 1 << 14):
            a, b = fresh(i[s : s + (1 << 14)], v[s : s + (1 << 14)])
            look(a, b)
            near = seen[a, b] >= least
            met.append((a[near], b[near]))
        i, v = (np.concatenate(c) for c in zip(*met))
        new = ~done[i, v]
        i, v = i[new], v[new]
    return seen[:, :n]


def spanning(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest row of the component of each row."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


FOUND = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("add_u", pa.int64()), ("add_v", pa.int64())])
#: Kinds of rows that a search gives: links counted, links of the forest, links between homes, pairs to be verified.
COUNTED, FOREST, BETWEEN, ASKED = range(4)


def search_graph(tiles: DataFrame, graph: DataFrame, width: int, theta: float, beam: int) -> DataFrame:
    """Rows of ``FOUND``: what range searches from every class of its home shard have met."""
    keys, least = ["shard", "a", "b"], math.cos(theta)

    def scan(batches):
        for t in tables_by_key(batches, keys):
            shard, first, second = (t[k][0].as_py() for k in keys)
            node, home, part, copies = (t[c].to_numpy() for c in ("node", "home", "part", "copies"))
            x = unit_rows(t["vec"].combine_chunks(), width)
            y, n = x.astype(np.float32), len(x)
            lists = t["edges"].combine_chunks()
            src = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            dst, far, cos = (lists.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("dst", "home", "cosine"))
            order = np.argsort(node)
            at = np.minimum(np.searchsorted(node[order], dst), n - 1)
            to = np.where(node[order[at]] == dst, order[at], -1)
            local, place = np.flatnonzero(to >= 0), None
            width_of = np.bincount(src[local], minlength=n)
            place = np.arange(len(local)) - np.repeat(np.cumsum(width_of) - width_of, width_of)
            adjacent = np.full((n, max(1, width_of.max())), -1)
            adjacent[src[local], place] = to[local]
            away = np.flatnonzero((to < 0) & (far != shard))
            away_cuts, away_angle = np.searchsorted(src[away], np.arange(n + 1)), _angle(cos[away].astype(np.float64))
            medoid = int((y @ y.mean(0)).argmax())
            mine = np.flatnonzero(home == shard)
            lo, hi = [], []
            for s in range(0, len(mine), TOGETHER):
                q = mine[s : s + TOGETHER]
                seen = range_search(y, adjacent, q, medoid, beam, least - 1e-5)
                i, v = np.nonzero(seen >= least - 1e-5)
                sure = np.concatenate([np.einsum("ij,ij->i", x[q[i[a : a + 65536]]], x[v[a : a + 65536]]) >= least for a in range(0, len(i), 65536)])
                out = sure & (home[v] != shard)
                if out.any():
                    yield _found(BETWEEN, node[q[i[out]]], node[v[out]], copies[q[i[out]]], copies[v[out]])
                inside = sure & (home[v] == shard) & (np.minimum(part[q[i]], part[v]) == first) & (np.maximum(part[q[i]], part[v]) == second) & (q[i] != v)
                lo.append(np.minimum(q[i[inside]], v[inside]))
                hi.append(np.maximum(q[i[inside]], v[inside]))
                # edges out of the shard from what is in range: a link must be possible by the angles
                many = away_cuts[v + 1] - away_cuts[v]
                e = np.repeat(away_cuts[v], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                can = away_angle[e] - np.repeat(_angle(seen[i, v].astype(np.float64)), many) <= theta + 1e-3
                if can.any():
                    ask = np.unique(np.stack([node[q[np.repeat(i, many)[can]]], dst[away[e[can]]]], 1), axis=0)
                    yield _found(ASKED, ask[:, 0], ask[:, 1])
            if lo and sum(map(len, lo)):
                code = np.unique(np.concatenate(lo) * n + np.concatenate(hi))
                u, v = code // n, code % n
                add = np.zeros(n, np.int64)
                np.add.at(add, u, copies[v])
                np.add.at(add, v, copies[u])
                got = np.flatnonzero(add)
                yield _found(COUNTED, node[got], node[got], add[got])
                top = spanning(n, u, v)
                got = np.flatnonzero(top != np.arange(n))
                yield _found(FOREST, node[got], node[top[got]])

    rows = tiles.join(graph, "node", "left").select(*keys, "part", "node", "copies", "home", "vec", "edges")
    dealt = rows.repartition(_partitions(tiles.sparkSession), *keys).sortWithinPartitions(*keys, "node")
    return materialise(dealt.mapInArrow(scan, "kind int, u bigint, v bigint, add_u bigint, add_v bigint"), "found")


def _found(kind: int, u: np.ndarray, v: np.ndarray, add_u: np.ndarray | None = None, add_v: np.ndarray | None = None) -> pa.RecordBatch:
    adds = [pa.nulls(len(u), pa.int64()) if a is None else pa.array(a, pa.int64()) for a in (add_u, add_v)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind), pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64()), *adds], schema=FOUND)


def verified(asked: DataFrame, plain: DataFrame, width: int, theta: float) -> DataFrame:
    """(u, v, add_u, add_v) of the pairs (u, v) that link by their vectors; add_u are the copies of u."""
    least = math.cos(theta)

    def check(batches):
        for b in batches:
            if b.num_rows:
                link = np.einsum("ij,ij->i", unit_rows(b["x"], width), unit_rows(b["y"], width)) >= least
                yield b.select(["u", "v", "add_u", "add_v"]).filter(pa.array(link))

    end = lambda n, c, a: plain.select(F.col("node").alias(n), F.col("vec").alias(c), F.col("copies").alias(a))
    both = asked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    both = both.join(end("u", "x", "add_u"), "u").join(end("v", "y", "add_v"), "v")
    return both.select("u", "v", "add_u", "add_v", "x", "y").mapInArrow(check, "u bigint, v bigint, add_u bigint, add_v bigint")


def graph_links(tiles: DataFrame, graph: DataFrame, plain: DataFrame, width: int, theta: float, beam: int) -> tuple[DataFrame, DataFrame]:
    """(node, add) and (u, v) of the links that the search has found."""
    found = search_graph(tiles, graph, width, theta, beam)
    of = lambda k: found.where(F.col("kind") == k)
    swap = F.col("u") > F.col("v")
    pick = lambda a, b, n: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(n)
    between = of(BETWEEN).select(pick("u", "v", "u"), pick("v", "u", "v"), pick("add_u", "add_v", "add_u"), pick("add_v", "add_u", "add_v"))
    between = materialise(between.unionByName(verified(of(ASKED), plain, width, theta)).distinct(), "between")
    adds = of(COUNTED).select(F.col("u").alias("node"), F.col("add_u").alias("add"))
    adds = adds.unionByName(between.select(F.col("u").alias("node"), F.col("add_v").alias("add"))).unionByName(between.select(F.col("v").alias("node"), F.col("add_u").alias("add")))
    return adds, of(FOREST).select("u", "v").unionByName(between.select("u", "v"))


# ---------------------------------------------------------------------- audit
def exact_links(classes: DataFrame, audited: list, width: int, theta: float) -> dict[int, int]:
    """Links of the audited classes, counted against all classes."""
    if not audited:
        return {}
    nodes, mine = [r["node"] for r in audited], [r["copies"] for r in audited]
    given = classes.sparkSession.sparkContext.broadcast(unit_rows(pa.array([bytes(r["vec"]) for r in audited]), width))

    def count(batches):
        total = np.zeros(len(given.value), np.int64)
        for b in batches:
            if b.num_rows:
                total += ((given.value @ unit_rows(b["vec"], width).T) >= math.cos(theta)) @ b["copies"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int64()), pa.array(total[total > 0])], names=["i", "n"])

    sums = classes.select("vec", "copies").mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()  # one row an audited class
    got = {r["i"]: r["n"] for r in sums}
    return {node: max(got.get(i, 0), mine[i]) - 1 for i, node in enumerate(nodes)}  # a class meets itself


# ------------------------------------------------------------------- operator
def _class_links(classes: DataFrame, width: int, theta: float, beam: int) -> DataFrame:
    """(h1, h2, copies, n_links, component_id, recall) of the classes of one dimension."""
    spark = classes.sparkSession
    n = classes.count()
    hashed = F.pmod(F.xxhash64(F.lit(9), "node"), F.lit(1 << 20))
    picked = classes.where(hashed < math.ceil(min(1.0, SAMPLE / n) * (1 << 20))).select("node", "vec").toArrow()
    x = unit_rows(picked["vec"].combine_chunks(), width)[np.argsort(picked["node"].to_numpy())]
    x = np.random.default_rng(0).permutation(x)
    balls = find_balls(x[:BALL_SAMPLE], (theta - SLACK) / 2, BALL_LEAST, MAX_BALLS)
    rest = x[(x @ balls.T).max(1) < math.cos((theta - SLACK) / 2)] if len(balls) else x
    shards = max(1, min(math.ceil(2 * n * len(rest) / len(x) / SHARD), len(rest) // 16))
    centres = cluster_centres(rest if len(rest) else x, shards)
    assigned = materialise(assign(classes, spark.sparkContext.broadcast((balls, centres)), width, theta), "assigned")

    facts = assigned.where("ball >= 0").groupBy("ball").agg(F.max("angle").alias("radius"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("members"), F.min("least").alias("least")).collect()  # at most MAX_BALLS
    adds, links = ball_links(assigned, facts, width, theta) if facts else (None, None)
    plain = assigned.where("ball < 0").select("node", "copies", "home", "second", "vec")
    tiles = shard_tiles(plain)
    graph = build_graph(tiles, width)

    audited = classes.where(hashed >= (1 << 20) - math.ceil(min(1.0, AUDIT / n) * (1 << 20))).select("node", "copies", "vec").collect()  # about AUDIT classes
    exact = exact_links(classes, audited, width, theta)
    in_ball = spark.createDataFrame([(r["ball"], r["copies"]) for r in facts], "ball int, in_ball bigint")
    for attempt in range(AUDITS):
        found, forest = graph_links(tiles, graph, plain, width, theta, beam << attempt)
        total = (found if adds is None else adds.unionByName(found)).groupBy("node").agg(F.sum("add").alias("add"))
        counted = assigned.drop("vec", "near", "home", "second").join(total, "node", "left").join(F.broadcast(in_ball), "ball", "left")
        counted = materialise(counted.withColumn("n_links", F.coalesce("in_ball", "copies") - 1 + F.coalesce("add", F.lit(0))), "counted")
        met = {r["node"]: r["n_links"] for r in counted.where(F.col("node").isin(list(exact))).select("node", "n_links").collect()} if exact else {}
        recall = sum(min(met[i], exact[i]) for i in exact) / max(1, sum(exact.values())) if any(exact.values()) else 1.0
        if recall >= TARGET:
            break

    # components over classes and balls; a ball is one vertex
    roots = components(forest if links is None else links.unionByName(forest))
    balls_ = spark.createDataFrame([(-1 - r["ball"], r["least"]) for r in facts], "g bigint, least bigint")
    vertex = counted.where("ball < 0").select(F.col("node").alias("g"), "least").unionByName(balls_)
    named = vertex.join(roots.select(F.col("node").alias("g"), "root"), "g", "left").withColumn("root", F.coalesce("root", "g"))
    named = materialise(named, "named")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    of = join_skewed(named.select("g", "root"), best, ["root"], "size", named.count())
    of = materialise(of.select("g", "component_id"), "of")
    lone = counted.where("ball < 0").join(of.withColumnRenamed("g", "node"), "node")
    balled = counted.where("ball >= 0").join(F.broadcast(of.where("g < 0").select((-1 - F.col("g")).cast("int").alias("ball"), "component_id")), "ball")  # at most MAX_BALLS
    out = ["h1", "h2", "copies", "n_links", "component_id"]
    return lone.select(*out).unionByName(balled.select(*out)).withColumn("recall", F.lit(float(recall)))


def embedding_groups(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """vec_id, n_links, component_id, kept and the audited recall of every vector."""
    theta = math.acos(threshold)
    width = 4 if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else 8
    rows = vector_rows(vectors, id_col, vec_col)
    good = rows.where("vec is not null")
    classes = good.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    dims = [r["d"] for r in classes.select(F.octet_length("vec").alias("d")).distinct().collect()]
    parts = [_class_links(classes.where(F.octet_length("vec") == d) if len(dims) > 1 else classes, width, theta, beam) for d in sorted(dims)]
    bad = rows.where("vec is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    out = bad
    if parts:
        facts = parts[0]
        for p in parts[1:]:
            facts = facts.unionByName(p)
        facts = materialise(facts, "links")
        total = facts.agg(F.sum("copies").alias("n")).first()["n"]
        out = bad.unionByName(join_skewed(good.select("vec_id", "h1", "h2"), facts, ["h1", "h2"], "copies", total).select("vec_id", "n_links", "component_id", "recall"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "recall")

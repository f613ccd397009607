"""Conversation prefix trie from sorted turn sequences, without a stack.

1. *Turns* become two 64-bit hashes and a byte count; texts are not shuffled.
   Positions come from range-partitioned sorted rows: a local number, plus the
   rows of the same conversation in earlier partitions, so a conversation of
   any length is never one group.
2. *Keys.*  Turn i of a rebuilt conversation is mixed with i; the key of a
   prefix is the XOR over its turns, so equal keys mean equal prefixes.  A
   conversation of over ``SEGMENT`` turns becomes several rows, each starting
   with the key of all turns before it; segments are worked off from the
   deepest up, and what lies below is handed on.
3. *Sorted LCPs.*  Rows are range-partitioned and sorted by key sequence and
   conv_id (copies spread over partitions) and read in chunks.  A chunk holds
   the longest common prefixes of neighbours and a sparse table of their range
   minima.  Every candidate prefix (row, depth) binary-searches its left and
   its right extent in that table, independently of all others; the extents
   are its member interval, and counts, children, leaves and bytes are
   differences of running sums over it.
4. *Borders.*  A prefix whose interval ends inside its chunk is complete.  Only
   prefixes of a chunk's first and last row can go on elsewhere: their partial
   rows are added up by key, less what two neighbouring chunks both counted.

Defined results: a null role or text is empty; turns that tie are ordered by
role, then by the MD5 of their text; repeated rows are turns of their own;
rows without a conv_id belong to no conversation and are left out; c - c % 5
truncates towards zero; an empty table gives no node.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialise

#: Turns of one row; longer conversations take several.
SEGMENT = 4096
#: Rows, and turns, after which a chunk ends.
CHUNK_ROWS = 1 << 16
CHUNK_TURNS = 1 << 18
#: Conversations that share a base, and the modulus of the number of borrowed turns.
SHARE, BORROW = 5, 9
#: Rows of a parent table that is broadcast; beyond it the join shuffles.
PARENTS_BROADCAST = 200_000

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------ positions
def positions(rows: DataFrame, key: str, order: list) -> DataFrame:
    """``rows`` with ``pos`` (from 1) inside each ``key`` by ``order``; the numbered rows are written once.

    A partition numbers its own sorted rows.  Only its first and last key can
    lie in other partitions too, so at most two counts a partition are joined.
    """
    names = rows.columns
    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn("_part", F.spark_partition_id())
    at = names.index(key)

    def number(batches):
        last, seen = None, 0
        for b in batches:
            k = b.column(at).to_numpy()
            if not len(k):
                continue
            index = np.arange(len(k))
            new = np.concatenate([[k[0] != last], k[1:] != k[:-1]])
            run = np.maximum.accumulate(np.where(new, index, -1))
            local = np.where(run >= 0, index - run, index + seen) + 1
            last, seen = k[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64())], names=[*b.schema.names, "_local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", _local bigint"
    numbered = materialise(dealt.mapInArrow(number, schema), "positions")
    ends = numbered.groupBy("_part").agg(F.min(key).alias("a"), F.max(key).alias("b")).select("_part", F.explode(F.array_distinct(F.array("a", "b"))).alias(key))
    counts = numbered.join(F.broadcast(ends), ["_part", key]).groupBy("_part", key).agg(F.max("_local").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a partition
    before = counts.select("_part", key, F.sum("_n").over(earlier).alias("_before"))
    out = numbered.join(F.broadcast(before), ["_part", key], "left")
    return out.select(*names, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("pos"))


# -------------------------------------------------------------------- rebuild
def base_of(conv: Column) -> Column:
    return conv - conv % SHARE


def borrowed(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % BORROW


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conv_ids, and (conv_id, depth, a, b, bytes) of the turns of rebuilt conversations."""
    c = conversations.where("conv_id is not null")
    role, text = (F.coalesce(c[x].cast("string"), F.lit("")) for x in ("role", "text"))
    turns = c.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("digest"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.octet_length(text).cast("bigint").alias("bytes"))
    own = positions(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]).select("conv_id", "pos", "a", "b", "bytes")
    convs = materialise(own.select("conv_id").distinct(), "convs")
    heads = own.where((base_of(F.col("conv_id")) == F.col("conv_id")) & (F.col("pos") < BORROW)).withColumnRenamed("conv_id", "base")
    lent = convs.withColumn("base", base_of(F.col("conv_id"))).join(heads, "base").where(F.col("pos") <= borrowed(F.col("conv_id")))  # at most 8 turns to 9 conversations
    tails = own.where(F.col("pos") > borrowed(F.col("conv_id")))
    parts = [d.select("conv_id", F.lit(i).alias("piece"), F.col("pos").alias("at"), "a", "b", "bytes") for i, d in enumerate((lent, tails))]
    rebuilt = positions(parts[0].unionByName(parts[1]), "conv_id", [F.col("piece"), F.col("at")])
    return convs, rebuilt.select("conv_id", F.col("pos").alias("depth"), "a", "b", "bytes")


def sequences(conversations: DataFrame, segment: int) -> DataFrame:
    """One row a conversation and segment: conv_id, seg, start key (sa, sb), end key (ea, eb), turns (ka, kb, bytes), more, rest.

    ``rest`` are the bytes of the conversation's later segments.
    """
    convs, turns = rebuilt_turns(conversations)
    at = F.col("depth")
    turns = turns.select("conv_id", ((at - 1) / segment).cast("int").alias("seg"), F.struct(at.alias("d"), F.xxhash64(at, F.col("a")).alias("ka"), F.xxhash64(at, F.col("b")).alias("kb"), "bytes").alias("t"))
    rows = turns.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list("t")).alias("t"), F.expr("bit_xor(t.ka)").alias("xa"), F.expr("bit_xor(t.kb)").alias("xb"), F.sum("t.bytes").alias("size"))  # at most `segment` turns
    rows = materialise(rows, "segments")
    none = convs.join(rows.where("seg = 0").select("conv_id"), "conv_id", "left_anti")
    empty = none.select("conv_id", F.lit(0).alias("seg"), F.expr("filter(array(named_struct('d', 0L, 'ka', 0L, 'kb', 0L, 'bytes', 0L)), x -> false)").alias("t"), *[F.lit(0).cast("bigint").alias(c) for c in ("xa", "xb", "size")])
    rows = rows.unionByName(empty)
    long = materialise(rows.where("seg > 0").select("conv_id").distinct(), "long")
    parts = rows.join(long, "conv_id", "left_semi").select("conv_id", "seg", "xa", "xb", "size")
    w = Window.partitionBy("conv_id").orderBy("seg")  # one row for every `segment` turns
    upto, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    links = parts.select("conv_id", "seg", F.expr("bit_xor(xa)").over(upto).alias("sa"), F.expr("bit_xor(xb)").over(upto).alias("sb"), F.sum("size").over(after).alias("rest"))
    rows = rows.join(links, ["conv_id", "seg"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return materialise(rows.select(
        "conv_id", "seg", zero("sa").alias("sa"), zero("sb").alias("sb"), zero("sa").bitwiseXOR(F.col("xa")).alias("ea"), zero("sb").bitwiseXOR(F.col("xb")).alias("eb"),
        F.transform("t", lambda x: F.struct(x["ka"], x["kb"])).alias("keys"), F.col("t.bytes").alias("bytes"), F.col("rest").isNotNull().alias("more"), zero("rest").alias("rest")), "sequences")


# --------------------------------------------------------------- sparse table
def minima(x: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minima of all runs of 2**k values."""
    table = [x]
    while 2 << (len(table) - 1) <= len(x):
        low, half = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(low[:-half], low[half:]))
    return table


def range_min(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum over left..right of each query."""
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    out = np.empty(len(left), table[0].dtype)
    for k in np.unique(level):
        q = level == k
        out[q] = np.minimum(table[k][left[q]], table[k][right[q] - (1 << k) + 1])
    return out


def extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share the first ``depth`` turns with each ``row``; table[0][i] is the LCP of rows i - 1 and i."""
    n = len(table[0])
    left, right = row.copy(), row.copy()
    for k in range(len(table) - 1, -1, -1):
        step = 1 << k
        to = np.clip(left - step + 1, 0, len(table[k]) - 1)
        left -= np.where((left >= step) & (table[k][to] >= depth), step, 0)
        to = np.clip(right + 1, 0, len(table[k]) - 1)
        right += np.where((right + step < n) & (table[k][to] >= depth), step, 0)
    return left, right


# --------------------------------------------------------------------- chunks
class Chunk:
    """Sorted rows: lists as flat values between ``cuts``."""

    def __init__(self, table: pa.Table):
        t = table.combine_chunks().to_batches()[0]
        col = lambda c: t[c].to_numpy(zero_copy_only=False)
        self.conv, self.sa, self.sb, self.rest, self.more = (col(c) for c in ("conv_id", "sa", "sb", "rest", "more"))
        self.below = {c: col(c) for c in ("below_children", "below_leaves", "below_held")}
        self.len = t["bytes"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(self.len)])
        keys = t["keys"].flatten()
        self.a, self.b = (keys.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        self.bytes = t["bytes"].flatten().to_numpy(zero_copy_only=False)

    def edge(self, i: int) -> dict:
        s = slice(self.cuts[i], self.cuts[i + 1])
        return {"sa": int(self.sa[i]), "sb": int(self.sb[i]), "xs": self.a[s].tolist(), "ys": self.b[s].tolist(), "zs": self.bytes[s].tolist(), "more": bool(self.more[i])}

    def lcps(self) -> np.ndarray:
        """Turns shared with the row before; -1 if not even the start."""
        out = np.full(len(self.len), -1, np.int64)
        alive = 1 + np.flatnonzero((self.sa[1:] == self.sa[:-1]) & (self.sb[1:] == self.sb[:-1]))
        while len(alive):
            out[alive] += 1
            d = out[alive]
            alive, d = (x[(d < self.len[alive]) & (d < self.len[alive - 1])] for x in (alive, d))
            p, q = self.cuts[alive] + d, self.cuts[alive - 1] + d
            alive = alive[(self.a[p] == self.a[q]) & (self.b[p] == self.b[q])]
        return out

    def keys_at(self, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the first ``depth`` turns of each row."""
        out = []
        for lane, start in ((self.a, self.sa), (self.b, self.sb)):
            run = np.concatenate([[0], np.bitwise_xor.accumulate(lane)]) if len(lane) else np.zeros(1, np.int64)
            out.append(run[self.cuts[row] + depth] ^ run[self.cuts[row]] ^ start[row])
        return out[0], out[1]

    def nodes(self, low: int) -> dict[str, np.ndarray | list]:
        """Every distinct prefix of ``low`` turns or more; ``whole`` if no other chunk can have members of it."""
        n, rows = len(self.conv), np.arange(len(self.conv))
        lcp = self.lcps()
        table, least = minima(lcp), minima(self.conv)
        # candidates: of each row the prefixes that the row before does not have
        first = np.maximum(lcp + 1, low)
        many = np.maximum(self.len - first + 1, 0)
        row = np.repeat(rows, many)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
        left, right = extents(table, row, depth)
        # running sums over rows
        total = np.concatenate([[0], np.cumsum(self.bytes)])
        own = total[self.cuts[1:]] - total[self.cuts[:-1]]
        carried = np.concatenate([[0], np.cumsum(own + self.rest)])
        fresh = total[self.cuts[1:]] - total[self.cuts[:-1] + np.minimum(np.maximum(lcp, 0), self.len)]
        held = np.concatenate([[0], np.cumsum(fresh + self.below["below_held"])])
        last = extents(table, rows, self.len)[1]
        leaf = (self.len > lcp) & (self.len >= low) & (self.len[last] == self.len) & ~self.more[last]
        leaves = np.concatenate([[0], np.cumsum(leaf + self.below["below_leaves"])])
        # children: rows after the first whose common prefix ends at this depth and that go on
        grown = np.flatnonzero((self.len > lcp) & (lcp >= 0))
        code = np.sort(lcp[grown] * n + grown)
        deep = np.concatenate([[0], np.cumsum(self.below["below_children"])])
        kids = np.searchsorted(code, depth * n + right, "right") - np.searchsorted(code, depth * n + left, "right") + (self.len[left] > depth)
        kids = kids + np.where(self.len[right] == depth, deep[right + 1] - deep[left], 0)  # all members are as long as the prefix
        upto = total[self.cuts[left] + np.maximum(depth - 1, 0)] - total[self.cuts[left]]
        # conversations that end here: the first rows of the interval, if they are as long as the prefix
        same = np.concatenate([[False], (lcp[1:] == self.len[1:]) & (self.len[1:] == self.len[:-1]) & (self.more[1:] == self.more[:-1])])
        stop = np.append(np.flatnonzero(~same)[1:], n)[np.cumsum(~same) - 1]
        ends = [",".join(map(str, self.conv[i : stop[i]].tolist())) if e else "" for i, e in zip(left.tolist(), ((self.len[left] == depth) & ~self.more[left]).tolist())]
        whole = (left > 0) & (right < n - 1)
        up = np.maximum(depth - 1, 0)
        above = extents(table, row, up)
        known = (depth > low) & (above[0] > 0) & (above[1] < n - 1)
        a, b = self.keys_at(left, depth)
        pa_, pb = self.keys_at(left, up)
        return {
            "whole": whole, "conv_id": range_min(least, left, right), "depth": depth, "a": a, "b": b, "pa": pa_, "pb": pb,
            "parent_conv_id": np.where(known, range_min(least, *above), 0), "known": known, "n_convs": right - left + 1, "n_children": kids, "n_leaves": leaves[right + 1] - leaves[left],
            "carried": carried[right + 1] - carried[left] - (right - left + 1) * upto,
            "held": held[right + 1] - held[left] - (fresh[left] - (own[left] - upto)), "ends": ends,
        }


def overlap(last: dict, first: dict, low: int) -> list[dict]:
    """Corrections for the prefixes that the last row of one chunk shares with the first row of the next: both counted them."""
    if (last["sa"], last["sb"]) != (first["sa"], first["sb"]):
        return []
    shared = 0
    for x, y in zip(zip(last["xs"], last["ys"]), zip(first["xs"], first["ys"])):
        if x != y:
            break
        shared += 1
    leaf = int(shared == len(last["xs"]) and not last["more"])
    out, a, b, held = [], last["sa"], last["sb"], sum(last["zs"][:shared])
    for d in range(shared + 1):
        if d:
            pa_, pb, a, b = a, b, a ^ last["xs"][d - 1], b ^ last["ys"][d - 1]
            held -= last["zs"][d - 2] if d > 1 else 0
        else:
            pa_, pb = a, b
        if d >= low:
            out.append({"depth": d, "a": a, "b": b, "pa": pa_, "pb": pb, "n_children": -int(d < shared), "n_leaves": -leaf, "held": -held})
    return out


NODE = [("whole", "boolean"), ("conv_id", "bigint"), ("depth", "bigint"), ("a", "bigint"), ("b", "bigint"), ("pa", "bigint"), ("pb", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"), ("n_children", "bigint"), ("n_leaves", "bigint"), ("carried", "bigint"), ("held", "bigint"), ("ends", "string")]
EDGE = [("part", "int"), ("chunk", "bigint"), ("edge", "int"), ("sa", "bigint"), ("sb", "bigint"), ("xs", "array<bigint>"), ("ys", "array<bigint>"), ("zs", "array<bigint>"), ("more", "boolean")]
_ARROW = {"boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in NODE + EDGE])
_DDL = ", ".join(f"{n} {t}" for n, t in NODE + EDGE)


def _rows(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"whole": False, "n_convs": 0, "n_children": 0, "n_leaves": 0, "carried": 0, "held": 0, "ends": ""} | x for x in found], schema=_SCHEMA)


def chunk_nodes(rows: DataFrame, low: int, chunk_rows: int, chunk_turns: int) -> DataFrame:
    """Nodes of all chunks, corrections at their borders, and the first and last row of every partition (``edge`` 0 and 1)."""

    def walk(batches):
        held, size, turns, number, last = [], 0, 0, 0, None

        def flush():
            nonlocal number, last
            table = pa.Table.from_batches(held)
            part, c = table["_part"][0].as_py(), Chunk(table)
            found = c.nodes(low)
            n = len(found["depth"])
            for at in range(0, n, 1 << 14):
                cut = {k: v[at : at + (1 << 14)] for k, v in found.items()}
                m, known = len(cut["depth"]), cut.pop("known")
                # texts of the ends leave the task only where another chunk may add to them
                cut["ends"] = [hashlib.sha256(e.encode()).hexdigest() if w else e for e, w in zip(cut["ends"], cut["whole"])]
                cols = [pa.array(cut[k], _ARROW[t], mask=~known if k == "parent_conv_id" else None) for k, t in NODE]
                more = {"part": pa.array([part] * m, pa.int32()), "chunk": pa.array([number] * m, pa.int64())}
                yield pa.RecordBatch.from_arrays([*cols, *[more.get(k, pa.nulls(m, _ARROW[t])) for k, t in EDGE]], schema=_SCHEMA)
            edges = [c.edge(0), c.edge(len(c.conv) - 1)]
            found = overlap(last, edges[0], low) if last else [{"part": part, "edge": 0} | edges[0]]
            if found:
                yield _rows(found)
            number, last = number + 1, {"part": part, "edge": 1} | edges[1]

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size, turns = size + b.num_rows, turns + len(b["bytes"].flatten())
            if size >= chunk_rows or turns >= chunk_turns:
                yield from flush()
                held, size, turns = [], 0, 0
        if held:
            yield from flush()
        if last:
            yield _rows([last])

    return rows.mapInArrow(walk, _DDL)


def border_corrections(out: DataFrame, low: int) -> DataFrame:
    """Corrections between the last row of each partition and the first row of the next one that has rows."""

    def fix(batches):
        for b in batches:
            found = [x for r in b.to_pylist() for x in overlap(r["last"], r["first"], low)]
            if found:
                yield _rows(found)

    edge = F.struct("sa", "sb", "xs", "ys", "zs", "more")
    parts = out.where("edge is not null").groupBy("part").agg(F.max(F.when(F.col("edge") == 0, edge)).alias("first"), F.max(F.when(F.col("edge") == 1, edge)).alias("end"))
    pairs = parts.select("first", F.lag("end").over(Window.orderBy("part")).alias("last")).where("last is not null")  # one row a partition
    return pairs.mapInArrow(fix, _DDL)


def hash_ends(partial: DataFrame) -> DataFrame:
    """(depth, a, b, ends): SHA-256 of the ends of each key, whose pieces are streamed in order and never held together."""
    key = ["depth", "a", "b"]
    schema = pa.schema([*[(k, pa.int64()) for k in key], ("ends", pa.string())])

    def digest(batches):
        now, state = None, None
        for b in batches:
            done = []
            for d, x, y, ends in zip(*(b[c].to_pylist() for c in (*key, "ends"))):
                if (d, x, y) != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (d, x, y), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), schema)], schema=schema)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*now, state.hexdigest()), schema)], schema=schema)

    pieces = partial.where("ends <> ''").select(*key, "part", "chunk", "ends")
    return pieces.repartition(*key).sortWithinPartitions(*key, "part", "chunk").select(*key, "ends").mapInArrow(digest, "depth bigint, a bigint, b bigint, ends string")


def segment_nodes(rows: DataFrame, low: int, chunk_rows: int, chunk_turns: int) -> tuple[DataFrame, DataFrame]:
    """(nodes that lie in one chunk, nodes added up over chunks) of the rows of one segment; depths are local."""
    order = ["sa", "sb", "keys", "more", "conv_id"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    out = materialise(chunk_nodes(dealt, low, chunk_rows, chunk_turns), "nodes")
    names = [n for n, _ in NODE]
    partial = out.where("not whole and edge is null").select(*names, "part", "chunk").unionByName(border_corrections(out, low).select(*names, "part", "chunk"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "carried", "held")]
    merged = partial.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), *sums)
    merged = merged.join(hash_ends(partial), ["depth", "a", "b"], "left").withColumn("ends", F.coalesce("ends", F.lit(_EMPTY_SHA))).withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return out.where("whole").select(*names[1:]), materialise(merged.select(*names[1:]), "merged")


# ------------------------------------------------------------------- operator
def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, chunk_rows: int = CHUNK_ROWS, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = sequences(conversations, segment)
    deepest = rows.agg(F.max("seg").alias("s")).first()["s"] or 0
    below, nodes, parents = None, None, None
    for seg in range(deepest, -1, -1):
        here = rows.where(F.col("seg") == seg)
        extras = ["below_children", "below_leaves", "below_held"]
        if below is not None:  # each end key's totals go to one of its rows
            one = here.where("more").groupBy("ea", "eb").agg(F.min("conv_id").alias("conv_id")).join(below, ["ea", "eb"]).drop("ea", "eb")
            here = here.join(one, "conv_id", "left")
        else:
            here = here.withColumns({c: F.lit(None).cast("bigint") for c in extras})
        here = here.select("conv_id", "sa", "sb", "keys", "bytes", "more", "rest", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in extras])
        whole, merged = segment_nodes(here, 0 if seg == 0 else 1, chunk_rows, chunk_turns)
        if seg:
            top = whole.unionByName(merged).where("depth = 1").groupBy(F.col("pa").alias("ea"), F.col("pb").alias("eb"))
            below = materialise(top.agg(F.count(F.lit(1)).alias("below_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("held").alias("below_held")), "below")
        deep = lambda d: d.withColumn("depth", F.col("depth") + seg * segment)  # noqa: E731, B023
        both = deep(whole).unionByName(deep(merged))
        nodes = both if nodes is None else nodes.unionByName(both)
        named = deep(merged)
        if seg < deepest:  # parents of the next segment's first turns
            named = named.unionByName(deep(whole.where(F.col("depth") == segment)))
        parents = named if parents is None else parents.unionByName(named)
    parents = materialise(parents.select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_parent")).distinct(), "parents")
    parents = F.broadcast(parents) if parents.count() <= PARENTS_BROADCAST else parents
    out = nodes.join(parents, ["pa", "pb", "depth"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "_parent")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("carried") - F.col("held")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"))

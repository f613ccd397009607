"""SimHash near-duplicate groups through pivot distance tables.

1. *Fingerprints.*  One 64-bit fingerprint a document, inside Arrow batches.
2. *Distinct fingerprints.*  Copies collapse to one fingerprint with its
   smallest doc_id (partial aggregation), so a group of copies of any size
   costs one row afterwards.
3. *Cells.*  Fingerprints at ``radius`` or fewer differing bits agree on at
   least k of radius + k bit blocks, so each fingerprint joins one cell for
   each choice of k blocks.  k follows from the number of fingerprints; every
   k finds every pair.  (Distances to whole-fingerprint pivots concentrate
   around 32 and cannot deal fingerprints out to tasks by themselves.)
   A cell of over ``TILE`` fingerprints is dealt out to tiles of two parts
   each, so no task holds an unbounded cell.
4. *Pivot tables.*  Inside a tile the Hamming distances of all members to
   many reference fingerprints are precomputed.  A pair whose distances to any
   pivot differ by more than ``radius`` cannot be a link (triangle inequality)
   and is discarded by its maximum coordinate difference; the survivors are
   verified by their differing bits.  Members are sorted by the first
   coordinate, so only a window of them is looked at for each.
5. *Links* leave a tile as a spanning forest (member, smaller member), never
   as all pairs, and are joined to components by hooking and pointer jumping.

Defined results: null and blank texts have fingerprint zero and link like any
other; texts of fewer words than a shingle are one shingle; rows that share a
doc_id keep their own fingerprints and may differ in component; a component
without any doc_id has component_id null; an empty table gives no rows.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import LOWER, UPPER, free_name, join_skewed, materialise

SEED = 42
#: Fingerprints of one side of a tile.
TILE = 2048
#: Expected fingerprints in a cell, from which the number k of agreeing blocks follows.
CELL = 1024
#: Reference fingerprints of a pivot table.
PIVOTS = 12

_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


# --------------------------------------------------------------- fingerprints
def fingerprint(text: str, shingle: int) -> int:
    """SimHash over word shingles, repeats included; bit set if set in over half the hashes."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int) -> Column:
    """bigint holding the 64 bits."""
    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py() or "", shingle) for t in texts], np.uint64).view(np.int64))
    return simhash(text)


# ---------------------------------------------------------------------- cells
def blocks_to_agree(n: int, radius: int, cell: int = CELL) -> int:
    """Smallest k for which n fingerprints spread over k of radius + k blocks leave about ``cell`` to a cell."""
    k = 1
    while k < 8 and n >> (64 * k // (radius + k)) > cell:
        k += 1
    return k


def cell_masks(radius: int, k: int) -> list[int]:
    """For each choice of k of radius + k blocks, the bits of those blocks."""
    m = radius + k
    cuts = [64 * i // m for i in range(m + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(block[i] for i in pick) for pick in combinations(range(m), k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tiles(prints: DataFrame, radius: int, k: int, tile: int = TILE) -> DataFrame:
    """(cell, a, b, side, fp): rows of cells with two members at least, dealt to tiles of parts a <= b."""
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).cast("bigint").alias("m")) for i, m in enumerate(cell_masks(radius, k))])
    members = prints.select("fp", F.explode(masks).alias("c")).select("fp", F.xxhash64("c.i", F.col("fp").bitwiseAND(F.col("c.m"))).alias("cell"))
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = members.join(sizes, "cell").withColumn("parts", F.ceil(F.col("n") / tile).cast("int"))
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("parts")).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, "p").alias("a"), F.greatest(q, "p").alias("b")))
    return dealt.select("cell", "fp", "p", F.explode(each).alias("t")).select("cell", "t.a", "t.b", "p", "fp")


# --------------------------------------------------------------- pivot tables
def pivot_links(fp: np.ndarray, radius: int, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """(member, smaller member): a spanning forest of the links among distinct fingerprints ``fp`` (int64)."""
    x = np.sort(fp)
    n = len(x)
    bits = x.view(np.uint64)
    root = np.arange(n)
    if n > 4:
        # spread-out references: each next one is the member farthest from those chosen
        table, gap, at = [], np.full(n, 65), 0
        for _ in range(min(pivots, n)):
            d = np.bitwise_count(bits ^ bits[at]).astype(np.int16)
            table.append(d)
            gap = np.minimum(gap, d)
            at = int(gap.argmax())
        table = np.stack(table, 1)
        order = np.argsort(table[:, 0], kind="stable")
        table = np.ascontiguousarray(table[order])
    else:
        table, order = np.zeros((n, 1), np.int16), np.arange(n)
    bits = bits[order]
    first = table[:, 0]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    until = np.searchsorted(first, first + radius, side="right")
    for i in range(n - 1):
        j = np.arange(i + 1, until[i])
        for c in range(1, table.shape[1]):
            if len(j) < 8:
                break
            j = j[np.abs(table[j, c] - table[i, c]) <= radius]
        j = j[np.bitwise_count(bits[j] ^ bits[i]) <= radius]
        for o in order[j]:
            a, b = find(order[i]), find(o)
            if a != b:
                root[max(a, b)] = min(a, b)
    top = np.array([find(i) for i in range(n)], np.int64)
    own = top != np.arange(n)
    return x[own], x[top[own]]


def link_tiles(dealt: DataFrame, radius: int) -> DataFrame:
    """(u, v): spanning links of every tile, u > v."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("cell", "a", "b")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            fp, us, vs = table["fp"].to_numpy(), [], []
            for s, e in zip(cuts, cuts[1:]):
                if e - s == 2:  # most cells: two fingerprints, verified at once
                    p, q = sorted((int(fp[s]), int(fp[s + 1])))
                    if ((p ^ q) & (1 << 64) - 1).bit_count() <= radius:
                        us.append(np.array([q])), vs.append(np.array([p]))
                elif e - s > 2:
                    u, v = pivot_links(fp[s:e], radius)
                    us.append(u), vs.append(v)
            if us:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], schema=schema)

        for b in batches:  # sorted by tile: all but the last tile of what is held are whole
            if not b.num_rows:
                continue
            held.append(b)
            table = pa.Table.from_batches(held)
            key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("cell", "a", "b")], 1)
            whole = int(np.flatnonzero((key != key[-1]).any(1))[-1]) + 1 if (key[0] != key[-1]).any() else 0
            if whole:
                out = flush(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                if out is not None:
                    yield out
        if held and (out := flush(pa.Table.from_batches(held))) is not None:
            yield out

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "cell", "a", "b").sortWithinPartitions("cell", "a", "b").mapInArrow(links, "u bigint, v bigint").distinct()


# ----------------------------------------------------------------- components
def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is one node of the component.

    Each round hooks every node to its smallest smaller neighbour, jumps
    pointers to the roots, and contracts the links to roots, until no link is
    left.  Every table between is written to the shared folder.
    """
    links = materialise(links, "links")
    found: DataFrame | None = None
    while not links.isEmpty():
        up = links.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
        hook = materialise(up.groupBy("node").agg(F.min("root").alias("root")), "hook")
        while True:
            above = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = materialise(hook.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "jump")
            hook = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = hook
        else:  # nodes found before whose root has now been hooked, and the newly hooked roots
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = found.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(hook)
            found = materialise(found, "found")
        to = lambda c: hook.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        links = links.join(to("u"), "u", "left").join(to("v"), "v", "left")
        links = links.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")).where("u <> v")
        links = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if found is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found


# ------------------------------------------------------------------- operator
def group_fingerprints(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) for distinct fingerprints with their smallest doc_id (fp, least_id); root is one fingerprint of the group."""
    k = blocks_to_agree(prints.count(), radius)
    roots = components(link_tiles(tiles(prints, radius, k), radius))
    named = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialise(named, "named")
    linked = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    return join_skewed(named, linked, ["root"], "size", named.count()).select("fp", "root", "component_id")  # one component may hold a third of all


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp (bigint) and component_id of every document (doc_id, text)."""
    marked = materialise(docs.select("doc_id", fingerprint_column(docs["text"], shingle).alias("fp")), "prints")
    prints = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "distinct")
    groups = group_fingerprints(prints.select("fp", "least_id"), radius).join(prints.select("fp", "copies"), "fp")
    return join_skewed(marked, materialise(groups, "groups"), ["fp"], "copies", marked.count()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` (all columns) with the document of smallest doc_id of each group.

    Rows without a doc_id stay only where a whole group has none, one row a
    fingerprint; of rows of a group that share the smallest doc_id one stays,
    but rows of different groups are kept apart whatever their doc_id.
    """
    prints = docs.select("doc_id", fingerprint_column(docs["text"], shingle).alias("fp"))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    groups = materialise(group_fingerprints(distinct, radius), "groups")
    fp, key = free_name(docs, "_fp"), free_name(docs, "_key")
    marked = docs.where("doc_id is not null").withColumn(fp, fingerprint_column(docs["text"], shingle))
    # of each group the first document, by the smallest fingerprint where rows of the group share its doc_id
    first = distinct.join(groups, "fp").where("least_id = component_id").groupBy("root").agg(F.min("fp").alias(fp), F.min("component_id").alias(key))
    kept = marked.join(first, (marked["doc_id"] == first[key]) & (marked[fp] == first[fp]), "left_semi").dropDuplicates(["doc_id", fp])
    lone = groups.where("component_id is null").select(F.col("fp").alias(fp))
    unnamed = docs.where("doc_id is null").withColumn(fp, fingerprint_column(docs["text"], shingle))
    unnamed = unnamed.join(lone, fp, "left_semi").dropDuplicates([fp]).drop(fp)
    return kept.select(*docs.columns).unionByName(unnamed.select(*docs.columns))

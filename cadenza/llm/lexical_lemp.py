"""Ranked lexical search over norm buckets of impact vectors (LEMP).

1. *Impact vectors.*  Every document becomes a sparse vector: one coordinate
   for each query term in it, worth the integer that the term adds to a score.
   Document counts, term counts and document frequencies cover all documents.
2. *Norm buckets.*  The vectors are range-partitioned by falling Euclidean
   length (ties by doc_id, so copies spread out) and read in buckets of
   ``BUCKET``.  A query of q terms cannot score more than sqrt(q) times the
   longest vector of a bucket (Cauchy-Schwarz), so a bucket, and with it
   everything shorter, is passed over once that falls below the query's
   threshold, its k-th best score so far.  The thresholds start from the
   ``HEAD`` longest vectors and rise inside every task.
3. *Coordinate bounds.*  In a bucket the largest value of each coordinate
   bounds what the query's terms can add.  The terms are cut into a focus,
   without which no document can reach the threshold, and a rest.  A document
   stays only if its focus sum, plus the smaller of the rest's coordinate
   bounds and the Cauchy-Schwarz bound on the rest, reaches the threshold.
4. *Survivors* are scored exactly in 64-bit integers.

Queries are dealt to blocks by their number of terms; each block is one pass
over all documents, and only its terms are broadcast.

Defined results: null and wordless texts match nothing, but only documents
with a term count; rows that share a doc_id are documents of their own, and
rows that share an item_id are items of their own; a null doc_id comes last
among equal scores; empty tables give no rows.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialise, text_of

#: Documents in a bucket.
BUCKET = 4096
#: Coordinates after which a bucket of long vectors ends early.
BUCKET_COORDINATES = 2_000_000
#: So many longest vectors (and those of equal length) give the first thresholds.
HEAD = 4096
#: (query, term) pairs of one block of queries: what a pass broadcasts.
BLOCK_TERMS = 1 << 18

#: Bytes of a term stay (A-Z lower-cased), all others become blanks.
_TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Slack of floating-point bounds.
_UP = 1 + 1e-9
_NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """All terms of a text in order: runs of ASCII letters and digits and of everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


# -------------------------------------------------------------------- queries
def query_terms(items: DataFrame) -> DataFrame:
    """(qid, item_id, terms): one row an item that has a term, its distinct terms."""
    schema = pa.schema([("qid", pa.int64()), ("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))])

    def split(batches):
        for b in batches:
            found = [sorted(set(terms(t))) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["qid"], b["item_id"], pa.array(found, pa.list_(pa.binary()))], schema=schema)

    rows = items.select(F.monotonically_increasing_id().alias("qid"), F.col("item_id").cast("bigint"), text_of(items).alias("text"))
    return materialise(rows.mapInArrow(split, "qid bigint, item_id bigint, terms array<binary>").where(F.size("terms") > 0), "queries")


# -------------------------------------------------------------------- vectors
def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs): number of all terms, and the ids and counts of those in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def count(batches):
        number = known.value
        for b in batches:
            n, ids, tfs, cuts = [], [], [], [0]
            for t in b["text"]:
                words = terms(t.as_py())
                n.append(len(words))
                for w, c in Counter(words).items():
                    if (i := number.get(w)) is not None:
                        ids.append(i), tfs.append(c)
                cuts.append(len(ids))
            cuts = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), *lists], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint"), text_of(docs).alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n bigint, ids array<int>, tfs array<int>").where("n > 0")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(cuts: np.ndarray, ids: np.ndarray, tfs: np.ndarray, n: list[int], weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each (document, term) adds to a score, in the order of ``ids``."""
    m = np.array([10 + 90 * x * n_docs // n_terms for x in n], np.int64)
    tf = tfs.astype(np.int64)
    return weight[ids] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(cuts))))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from zero, and the values of the lists."""
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def impact_vectors(counts: DataFrame, facts) -> DataFrame:
    """(doc_id, length, ids, imps) of documents with a coordinate above 0; ``facts`` broadcasts (weights, documents, terms)."""
    schema = pa.schema([("doc_id", pa.int64()), ("length", pa.float64()), ("ids", pa.list_(pa.int32())), ("imps", pa.list_(pa.int64()))])

    def weigh(batches):
        weight, n_docs, n_terms = facts.value
        for b in batches:
            cuts, ids = _flat(b["ids"])
            imp = impacts(cuts, ids, _flat(b["tfs"])[1], b["n"].to_pylist(), weight, n_docs, n_terms)
            row, some = np.repeat(np.arange(b.num_rows), np.diff(cuts)), imp > 0
            length = np.sqrt(np.bincount(row, weights=imp.astype(np.float64) ** 2, minlength=b.num_rows))
            left = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[some], minlength=b.num_rows))]), pa.int32())
            lists = [pa.ListArray.from_arrays(left, pa.array(ids[some], pa.int32())), pa.ListArray.from_arrays(left, pa.array(imp[some], pa.int64()))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(length), *lists], schema=schema)

    return counts.where(F.size("ids") > 0).mapInArrow(weigh, "doc_id bigint, length double, ids array<int>, imps array<bigint>").where("length > 0")


# --------------------------------------------------------------------- search
class Best:
    """The k best documents of one query, and its threshold."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.scores, self.docs = k, floor, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def threshold(self) -> int:
        """Least score that can still enter (1: any score above 0)."""
        return max(1, self.floor, int(self.scores[-1]) if len(self.scores) == self.k else 1)

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        s, d = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        order = np.lexsort((d, -s))[: self.k]
        self.scores, self.docs = s[order], d[order]


def search_bucket(doc: np.ndarray, length: np.ndarray, cuts: np.ndarray, ids: np.ndarray, imp: np.ndarray, queries: list[np.ndarray], best: list[Best], alive: np.ndarray) -> None:
    """Offer the documents of one bucket, longest first, to every query that is still alive."""
    order = np.argsort(ids, kind="stable")
    row, value = np.repeat(np.arange(len(doc)), np.diff(cuts))[order], imp[order]
    here, start = np.unique(ids[order], return_index=True)
    stop = np.append(start[1:], len(order))
    top = np.maximum.reduceat(value, start) if len(start) else np.zeros(0, np.int64)

    def postings(at: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(start[i], stop[i]) for i in at]) if len(at) else np.zeros(0, np.int64)

    for q in np.flatnonzero(alive):
        need = best[q].threshold()
        if math.sqrt(len(queries[q])) * length[0] * _UP < need:
            alive[q] = False  # and all shorter vectors
            continue
        at = np.intersect1d(here, queries[q], assume_unique=True, return_indices=True)[1]
        at = at[np.argsort(-top[at], kind="stable")]
        beyond = np.append(np.cumsum(top[at][::-1])[::-1], 0)  # most that the terms from each on can add
        if beyond[0] < need:
            continue
        focus = int(np.searchsorted(-beyond, -need, side="right"))  # first place from which the rest alone falls short
        p = postings(at[:focus])
        part = np.bincount(row[p], weights=value[p], minlength=len(doc))
        square = np.bincount(row[p], weights=value[p].astype(np.float64) ** 2, minlength=len(doc))
        rest = np.minimum(beyond[focus], np.sqrt((len(at) - focus) * np.maximum(length**2 * _UP - square, 0)))
        survives = (part > 0) & ((part + rest) * _UP >= need)
        if not survives.any():
            continue
        score = np.zeros(len(doc), np.int64)
        for p in (p, postings(at[focus:])):
            p = p[survives[row[p]]]
            np.add.at(score, row[p], value[p])
        found = np.flatnonzero(survives & (score >= need))
        best[q].offer(score[found], doc[found])


def search(vectors: DataFrame, given, k: int) -> DataFrame:
    """(qid, doc_id, score): the k best of every partition; ``given`` broadcasts (qids, term ids of each, thresholds)."""
    schema = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def scan(batches):
        qids, queries, floors = given.value
        best, alive = [Best(k, f) for f in floors], np.ones(len(qids), bool)
        held, rows = [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cuts, ids = _flat(t["ids"])
            search_bucket(t["doc_id"].fill_null(_NO_ID).to_numpy(), t["length"].to_numpy(), cuts, ids, _flat(t["imps"])[1], queries, best, alive)

        for b in batches:
            if not alive.any():
                break
            held.append(b)
            rows += b.num_rows
            if rows >= BUCKET or sum(len(x["ids"].values) for x in held) >= BUCKET_COORDINATES:
                flush()
                held, rows = [], 0
        if rows and alive.any():
            flush()
        doc = pa.array([int(d) if d != _NO_ID else None for x in best for d in x.docs], pa.int64())
        qid = pa.array([i for i, x in zip(qids, best) for _ in x.docs], pa.int64())
        yield pa.RecordBatch.from_arrays([qid, doc, pa.array([int(s) for x in best for s in x.scores], pa.int64())], schema=schema)

    return vectors.mapInArrow(scan, "qid bigint, doc_id bigint, score bigint")


# ------------------------------------------------------------------- operator
def search_block(docs: DataFrame, queries: list, k: int) -> DataFrame:
    """(qid, doc_id, score, rank) of one block of queries (qid, terms) against all documents."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for q in queries for t in q["terms"]}))}
    counts = materialise(term_counts(docs, vocabulary), "counts")
    all_docs = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = all_docs["n"], all_docs["l"] or 1
    weight = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # one row a query term at most
        weight[r["t"]] = term_weight(n_docs, r["count"])
    qids = [q["qid"] for q in queries]
    ids = [np.array(sorted(vocabulary[bytes(t)] for t in q["terms"]), np.int64) for q in queries]
    vectors = impact_vectors(counts, sc.broadcast((weight, n_docs, n_terms)))
    vectors = materialise(vectors, "vectors")
    longest = [F.col("length").desc(), F.col("doc_id")]

    cut = vectors.select("length").orderBy(F.col("length").desc()).limit(HEAD).agg(F.min("length").alias("least")).first()["least"] or 0.0
    head = vectors.where(F.col("length") >= cut).sortWithinPartitions(*longest)
    first = _first(search(head, sc.broadcast((qids, ids, [0] * len(qids))), k), k)
    floor = {r["qid"]: r["score"] for r in first.where(F.col("rank") == k).collect()}  # one row a query of the block
    given = sc.broadcast((qids, ids, [floor.get(i, 0) for i in qids]))
    return _first(search(vectors.repartitionByRange(*longest).sortWithinPartitions(*longest), given, k), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents (doc_id, text) of each item (item_id, text)."""
    queries = query_terms(items)
    total = queries.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_terms))
    out = None
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).orderBy("qid").collect()  # about block_terms terms
        if mine:
            found = search_block(docs, mine, k)
            found = found if blocks == 1 else materialise(found, "ranked")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "qid bigint, doc_id bigint, score bigint, rank int")
    return out.join(queries.select("qid", "item_id"), "qid").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

"""Benchmark decontamination with a generalised suffix automaton.

Test items are normalised to words and joined in one generalised suffix
automaton over word ids.  Training words stream through it, and the automaton
state gives the length of the longest item passage that ends at each word.
Passages of ``window`` words or more (or whole shorter items) are hits; hit
spans are removed, and documents whose share of hit words exceeds a coverage
limit are dropped.

Between item passages nothing can match, so only runs of words are streamed in
which each neighbouring pair may occur in an item (a bit table over hashed
pairs tells; its false positives are harmless).

Items are cut into overlapping pieces and dealt to shards of bounded size, so
each broadcast automaton holds at most ``SHARD_WORDS`` words, however large
the benchmark is; with several shards the documents pass once for each, the
marks so far being written in between.

Defined results: null and wordless texts and items have no words and no hits;
items without an item_id mark words and are not listed; rows that share an
item_id count as one item; repeated documents give repeated results; an empty
benchmark marks nothing.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import free_name, materialise

WINDOW = 10
#: Words of one automaton: about 2 states and 3 transitions a word, under 100 MB in a worker.
SHARD_WORDS = 200_000
#: Words of a piece of a long item.
PIECE_WORDS = 20_000
PAIR_BITS = 22

_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def _pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (key >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


@dataclass
class Automaton:
    """Generalised suffix automaton over word ids, with what its states tell of items."""

    window: int
    ids: dict[bytes, int] = field(default_factory=dict)
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    step: dict[int, int] = field(default_factory=dict)  # state << 32 | word -> state
    out: list[list[int]] = field(default_factory=lambda: [[]])  # words leaving a state, while building
    items: dict[int, list] = field(default_factory=dict)  # state -> items of its window
    short: dict[int, tuple] = field(default_factory=dict)  # state -> ((words, items), ...) of short items that end there
    least: int = 0  # words of the shortest item, ``window`` at most
    pairs: np.ndarray | None = None

    @classmethod
    def build(cls, pieces: list[tuple[object, list[bytes], bool]], window: int) -> Automaton:
        """pieces: (item id, words, whole): whole pieces of fewer than ``window`` words are short items."""
        self = cls(window)
        texts = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words, _ in pieces if words]
        for _, ids in texts:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.least = min([window, *(len(ids) for _, ids in texts)])
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        ends: dict[int, dict[int, set]] = {}
        for item, ids in texts:
            if len(ids) > 1:
                a = np.array(ids)
                self.pairs[_pair_slots(a[:-1], a[1:])] = True
            state = 0
            for i, w in enumerate(ids):
                state = self.step[state << 32 | w]
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                if i + 1 >= window:
                    found = self.items.setdefault(state, [])
                    if item is not None and item not in found:
                        found.append(item)
            if len(ids) < window:
                ends.setdefault(state, {}).setdefault(len(ids), set()).add(item)
        if ends:
            for state in sorted(range(len(self.link)), key=self.length.__getitem__):
                above = self.short.get(self.link[state], ()) if state else ()
                own = tuple((n, tuple(x for x in found if x is not None)) for n, found in ends.get(state, {}).items())
                if above or own:
                    self.short[state] = above + own
        self.out = []
        return self

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append([])
        return len(self.length) - 1

    def _go(self, state: int, word: int, to: int) -> None:
        if (state << 32 | word) not in self.step:
            self.out[state].append(word)
        self.step[state << 32 | word] = to

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q])
        for w in self.out[q]:
            self._go(copy, w, self.step[q << 32 | w])
        self.link[q] = copy
        while p != -1 and self.step.get(p << 32 | word) == q:
            self.step[p << 32 | word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        """Append ``word`` to the text that ends in state ``last`` (0 for a new text)."""
        q = self.step.get(last << 32 | word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        state, p = self._new(self.length[last] + 1, 0), last
        while p != -1 and (p << 32 | word) not in self.step:
            self._go(p, word, state)
            p = self.link[p]
        if p != -1:
            q = self.step[p << 32 | word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return state

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words that may hold an item passage of ``least`` words."""
        if not self.least or len(ids) < self.least:
            return []
        known = ids >= 0
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        joined[at] = self.pairs[_pair_slots(ids[at], ids[at + 1])]
        cuts = np.flatnonzero(~joined) + 1  # a run ends before each of these
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ids)]])
        keep = (stops - starts >= self.least) & known[starts]
        return list(zip(starts[keep].tolist(), stops[keep].tolist()))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (first word, word after), in order and apart, and the items that occur."""
        get = self.ids.get
        ids = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        step, link, length, window, short = self.step, self.link, self.length, self.window, self.short
        spans: list[tuple[int, int]] = []
        seen: set = set()
        for a, b in self.runs(ids):
            state = matched = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while state and (state << 32 | w) not in step:
                    state = link[state]
                    matched = length[state]
                to = step.get(state << 32 | w)
                if to is None:
                    continue
                state, matched = to, matched + 1
                reach = 0
                if matched >= window:
                    reach, top = window, state
                    while length[link[top]] >= window:
                        top = link[top]
                    seen.update(self.items[top])
                for n, items in short.get(state, ()):
                    if n <= matched:
                        reach = max(reach, n)
                        seen.update(items)
                if reach:
                    start = i + 1 - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, seen


# ------------------------------------------------------------------- on Spark
def automata(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> list:
    """Broadcast automata over all items (item_id, text), one for each shard of bounded size."""
    spark = benchmark.sparkSession
    schema = "item_id string, words array<binary>, n long"

    def pieces(batches):
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    if words:
                        part = words[at : at + PIECE_WORDS + window - 1]
                        rows.append((item, part, len(part)))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.binary())), pa.array(cols[2], pa.int64())], ["item_id", "words", "n"])

    cut = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, schema)
    cut = materialise(cut.withColumn("slot", F.pmod(F.xxhash64("item_id", "words"), F.lit(1 << 20))), "items")
    total = cut.agg(F.sum("n")).first()[0] or 0
    shards = -(-2 * total // shard_words) if total > shard_words else 1
    built = []
    for k in range(shards):
        # a shard is half full on average; one that is not is split again by its slots
        stack = [(k * (1 << 20) // shards, (k + 1) * (1 << 20) // shards)]
        while stack:
            a, b = stack.pop()
            part = cut.where(F.col("slot").between(a, b - 1))
            if b - a > 1 and (part.agg(F.sum("n")).first()[0] or 0) > shard_words:
                stack += [(a, (a + b) // 2), ((a + b) // 2, b)]
                continue
            rows = [(r.item_id, [bytes(w) for w in r.words], True) for r in part.select("item_id", "words").toLocalIterator()]
            built.append(spark.sparkContext.broadcast(Automaton.build(sorted(rows, key=lambda r: (r[0] or "", r[1])), window)))
    return built


MARK = "struct<n_words:bigint, spans:array<struct<start:int, stop:int>>, items:array<string>>"
_MARK = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def mark_column(text: Column, automaton, before: Column | None = None) -> Column:
    """Words, hit word spans and occurring items of each text, added to an earlier shard's mark."""
    def one(t, old):
        words = words_of(t)
        spans, items = automaton.value.scan(words)
        if old:
            spans = _merge(spans + [(s["start"], s["stop"]) for s in old["spans"]])
            items |= set(old["items"])
        return {"n_words": len(words), "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(items)}

    if before is None:
        @F.arrow_udf(MARK)
        def mark(texts: pa.Array) -> pa.Array:
            return pa.array([one(t.as_py(), None) for t in texts], _MARK)
        return mark(text)

    @F.arrow_udf(MARK)
    def add(texts: pa.Array, olds: pa.Array) -> pa.Array:
        return pa.array([one(t.as_py(), o.as_py()) for t, o in zip(texts, olds)], _MARK)
    return add(text, before)


def mark_all(docs: DataFrame, shards: list, mark: str) -> DataFrame:
    """``docs`` with the marks of all shards in one column."""
    out = docs.withColumn(mark, mark_column(docs["text"], shards[0]))
    for shard in shards[1:]:
        out = materialise(out, "marks")
        out = out.withColumn(mark, mark_column(out["text"], shard, out[mark]))
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, mark: str = "mark") -> DataFrame:
    """``docs`` with a column of marks: n_words, hit spans in words, item_ids that occur."""
    return mark_all(docs, automata(benchmark, window), mark)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    at, out, words = 0, [], [m.span() for m in _WORD.finditer(text)]
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join(out) + text[at:]


def clean_column(text: Column, shard, max_coverage: float) -> Column:
    """struct<keep, text>: the text without hit spans; keep is false beyond the coverage limit."""
    @F.arrow_udf("struct<keep:boolean, text:string>")
    def clean(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            cleaned, keep = t.as_py(), True
            words = words_of(cleaned)
            spans = shard.value.scan(words)[0]
            if spans and sum(b - a for a, b in spans) > max_coverage * len(words):
                keep = False
            while keep and spans:
                cleaned = cut_words(cleaned, spans)
                spans = shard.value.scan(words_of(cleaned))[0]
            rows.append({"keep": keep, "text": cleaned if keep else None})
        return pa.array(rows, pa.struct([("keep", pa.bool_()), ("text", pa.string())]))
    # else the optimiser would evaluate it once for the filter and once for the text
    return clean.asNondeterministic()(text)


def cut_column(text: Column, mark: Column) -> Column:
    """The text without the spans of a mark."""
    @F.arrow_udf("string")
    def cut(texts: pa.Array, marks: pa.Array) -> pa.Array:
        rows = []
        for t, m in zip(texts, marks):
            spans = [(s["start"], s["stop"]) for s in m.as_py()["spans"]]
            rows.append(cut_words(t.as_py(), spans) if spans else t.as_py())
        return pa.array(rows, pa.string())
    return cut(text, mark)


def _by_shards(docs: DataFrame, shards: list, max_coverage: float) -> DataFrame:
    """As ``clean_column`` does, with the marks of all shards put together before coverage is judged and spans are cut."""
    mark = free_name(docs, "_mark")
    out, first = docs, True
    while True:
        marked = materialise(mark_all(out, shards, mark), "marked")
        if first:
            n_hit = F.aggregate(f"{mark}.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
            marked, first = marked.where(n_hit <= max_coverage * F.col(f"{mark}.n_words")), False
        if marked.where(F.size(f"{mark}.spans") > 0).isEmpty():
            return marked.drop(mark)
        cut = cut_column(F.col("text"), F.col(mark)).alias("text")
        out = marked.select(*[cut if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` (all columns) without hit spans; documents with a larger share of hit words are dropped.

    Words that come together where a span is cut are scanned again, until no
    window is left.  With one shard that happens inside each task; with
    several, the documents pass once for each shard, the marks are put
    together, and the passes are repeated until nothing is marked.
    """
    shards = automata(benchmark, window, shard_words)
    if len(shards) > 1:
        return _by_shards(docs, shards, max_coverage)
    clean = free_name(docs, "_clean")
    cleaned = docs.withColumn(clean, clean_column(docs["text"], shards[0], max_coverage)).where(f"{clean}.keep")
    return cleaned.select(*[F.col(f"{clean}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])

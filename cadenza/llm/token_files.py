"""Token-id files: concatenated ids with Elias-Fano document boundaries.

A data set is a folder of shards, one for each range partition of ``doc_id``;
shard order is document order.  A shard is two files:

``NNNNN-<attempt>.ids``   token ids, little-endian, 2 bytes each if the
                          vocabulary has at most 65,536 ids, else 4
``NNNNN-<attempt>.ef``    header (8 little-endian 64-bit integers: id bytes,
                          documents, documents without doc_id, lowest doc_id,
                          and the byte lengths of the four parts that follow:
                          boundaries' low and high bits, doc_ids' low and high
                          bits) and the two Elias-Fano sequences

A sequence of n non-decreasing integers below u takes n * floor(log2(u / n))
low bits and at most 2n + 1 high bits.  ``select(i)`` finds the i-th one bit
from a 32-bit sample for each 512 of them; no 64-bit offset table exists.

Files are named by task attempt and listed in a manifest that Spark commits,
so a rerun task leaves at most an unlisted file.  Documents arrive sorted and
ids are written as they come: a task holds one Arrow batch and its lengths.

Defined results: a null text is read as empty and has the end id alone;
documents without a doc_id come first; rows that share a doc_id stay separate
and are ordered by text; an empty table gives no shards and no rows.
"""
from __future__ import annotations

import uuid
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialise, text_of
from cadenza.session import shared_path

#: Entries of a worker's memos of words and of their pre-tokens (about 200 bytes each); a full one is emptied.
MEMO_WORDS = 300_000
MEMO_PIECES = 800_000
#: Longest key of a memo, in characters: text without blanks comes in long words that hardly repeat.
MEMO_CHARS = 64
#: Values whose low bits are spread out at a time (a multiple of 8, so that blocks end on whole bytes).
LOW_BLOCK = 1 << 16
#: Ids read and digested at a time.
READ_IDS = 1 << 22
SAMPLE = 512


# ---------------------------------------------------------------- Elias-Fano
class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._samples: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low_bits = max(0, int((int(v[-1]) + 1) // n).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if low_bits:
            place = np.arange(low_bits, dtype=np.uint64)
            blocks = ((v[i : i + LOW_BLOCK, None] >> place) & np.uint64(1) for i in range(0, n, LOW_BLOCK))
            low = np.concatenate([np.packbits(b.astype(np.uint8).ravel(), bitorder="little") for b in blocks])
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) // 8 + 1, np.uint8)
        np.bitwise_or.at(high, ones >> 3, np.left_shift(1, ones & 7).astype(np.uint8))
        return cls(n, low_bits, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        for b in range(self.low_bits):
            p = at + b
            out |= ((self.low[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def samples(self) -> np.ndarray:
        """Byte that holds each 512th one bit and the ones before that byte, 32 bits each."""
        if self._samples is None:
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])
            at = np.searchsorted(before, np.arange(0, self.n, SAMPLE), side="right") - 1
            self._samples = np.stack([at, before[at]], 1).astype(np.uint32)
        return self._samples

    def select(self, i: int) -> int:
        """The i-th value (from 0), from the sampled directory."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, before = map(int, self.samples()[i // SAMPLE])
        while before + (c := int(self.high[byte]).bit_count()) <= i:
            before, byte = before + c, byte + 1
        bits = int(self.high[byte])
        for _ in range(i - before):
            bits &= bits - 1
        one = byte * 8 + (bits & -bits).bit_length() - 1
        return ((one - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Values start .. stop-1 as one array."""
        stop = min(stop, self.n)
        if stop <= start:
            return np.zeros(0, np.int64)
        byte, before = map(int, self.samples()[start // SAMPLE])
        last = self.samples()
        end = int(last[(stop - 1) // SAMPLE + 1][0]) + 1 if (stop - 1) // SAMPLE + 1 < len(last) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little")) + byte * 8
        i = np.arange(start, stop)
        ones = ones[start - before : stop - before]
        return (((ones - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)).astype(np.int64)

    def parts(self) -> tuple[bytes, bytes]:
        return bytes([self.low_bits]) + self.low.tobytes(), self.high.tobytes()

    @classmethod
    def of(cls, n: int, low: bytes, high: bytes) -> EliasFano:
        return cls(n, low[0], np.frombuffer(low, np.uint8, offset=1), np.frombuffer(high, np.uint8))


# ------------------------------------------------------------------ encoding
class _Memo(dict):
    """Values made on first use; those of long keys are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            self[key] = value
        return value


class WordEncoder:
    """Encodes by the tokenizers library, with memos of blank-separated words and their pre-tokens.

    Right for vocabularies whose pre-tokenizer drops blanks and never spans
    them: a text's ids are then those of its words in turn.  Where the
    vocabulary lower-cases and cuts words by a pattern, the model itself is
    asked once for each pre-token; words beyond Latin-1 (which normalisation
    may change further) and words that may hold a special token go through the
    whole library.  The first text of each batch is encoded by the library as
    a whole, and a difference raises.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        probe = [x.ids for x in self.lib.encode_batch(["ab cd", "ab", "cd"], add_special_tokens=False)]
        self.by_word = probe[0] == probe[1] + probe[2]
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        steps = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        cut = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in parts["added_tokens"]) or "(?!)").search
        self.cut = None
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["behavior"] == "Removed" and cut[0]["invert"]:
            self.cut = regex.compile(cut[0]["pattern"]["Regex"]).findall
            shown = self.lib.pre_tokenizer.pre_tokenize_str
            self.bytes = {i: "".join(p for p, _ in shown(chr(i))) or chr(i) for i in range(256)}
        self.pieces, self.words, self.others = _Memo(self._piece), _Memo(self._word), _Memo(self._other)

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        plain = piece if piece.isascii() and piece.isprintable() else piece.translate(self.bytes)
        return self._pack([t.id for t in self.lib.model.tokenize(plain)])

    def _word(self, word: str) -> bytes:
        low = word.lower()
        return self.pieces[low] if low.isalpha() else b"".join(map(self.pieces.__getitem__, self.cut(low)))

    def _other(self, word: str) -> bytes:
        return self._pack(self.lib.encode(word, add_special_tokens=False).ids)

    def _text(self, text: str) -> bytes:
        words = self.words
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            words = self.others
        if words is self.others or not self.cut or self.special(text):
            words = self.others
        return b"".join(map(words.__getitem__, text.replace("\n", " ").split(" ")))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self._pack(e.ids) for e in self.lib.encode_batch(texts, add_special_tokens=False)]
        for memo, most in ((self.words, MEMO_WORDS), (self.others, MEMO_WORDS // 4), (self.pieces, MEMO_PIECES)):
            if len(memo) > most:
                memo.clear()
        out = [self._text(t) for t in texts]
        if texts and out[0] != self._other(texts[0]):
            raise ValueError(f"ids by words differ from those of the whole text {texts[0][:80]!r}")
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _store(uri: str):
    """File system and path of a folder that the driver and all executors share."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


# ------------------------------------------------------------- write and read
def write_shards(docs: DataFrame, vocabulary: str, end_id: int, folder: str) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards in ``folder``; returns the committed manifest.

    Manifest: shard, name, n_docs, n_tokens.  Documents are range-partitioned
    by doc_id, so the number of shards follows spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        store, base = _store(folder)
        shard = TaskContext.get().partitionId()
        name, sink, lengths, ids, nulls = f"{shard:05d}-{uuid.uuid4().hex[:12]}", None, [], [], 0
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.kind).tobytes()
        for b in batches:
            if not b.num_rows:
                continue
            if sink is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{name}.ids")
            got = enc.encode_batch(b.column("text").to_pylist())
            sink.write(b"".join(chain.from_iterable((g, end) for g in got)))
            lengths.append(np.array([len(g) // enc.kind.itemsize + 1 for g in got], np.int64))
            keys = b.column("doc_id")
            nulls += keys.null_count
            ids.append(keys.drop_null().to_numpy(zero_copy_only=False))
        if sink is None:
            return
        sink.close()
        ends = np.cumsum(np.concatenate(lengths))
        keys = np.concatenate(ids)
        least = int(keys[0]) if len(keys) else 0
        parts = [*EliasFano.encode(np.concatenate([[0], ends])).parts(), *EliasFano.encode(keys - least).parts()]
        head = np.array([enc.kind.itemsize, len(ends), nulls, least, *map(len, parts)], "<i8").tobytes()
        with store.open_output_stream(f"{base}/{name}.ef") as out:
            out.write(head + b"".join(parts))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_docs": [len(ends)], "n_tokens": [int(ends[-1])]}, pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return materialise(rows.mapInArrow(write, "shard int, name string, n_docs bigint, n_tokens bigint"), "manifest")


class Shard:
    """One shard, opened for reading."""

    def __init__(self, folder: str, name: str):
        self.store, base = _store(folder)
        self.path = f"{base}/{name}"
        with self.store.open_input_stream(f"{self.path}.ef") as f:
            raw = f.read()
        head = np.frombuffer(raw, "<i8", 8)
        self.kind = np.dtype(f"<u{int(head[0])}")
        self.n_docs, self.n_null, self.least = map(int, head[1:4])
        cuts = 64 + np.concatenate([[0], np.cumsum(head[4:])])
        parts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        self.bounds = EliasFano.of(self.n_docs + 1, *parts[:2])
        self.keys = EliasFano.of(self.n_docs - self.n_null, *parts[2:])

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by select."""
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        with self.store.open_input_file(f"{self.path}.ids") as f:
            f.seek(a * self.kind.itemsize)
            return np.frombuffer(f.read((b - a) * self.kind.itemsize), self.kind)

    def documents(self, most: int = READ_IDS):
        """(first document, doc_ids with None, boundaries, ids) for runs of documents of about ``most`` ids."""
        with self.store.open_input_file(f"{self.path}.ids") as f:
            at = 0
            while at < self.n_docs:
                bounds = self.bounds.slice(at, min(at + 8192, self.n_docs) + 1)
                take = max(1, int(np.searchsorted(bounds, bounds[0] + most, side="right")) - 1)
                bounds = bounds[: take + 1]
                f.seek(int(bounds[0]) * self.kind.itemsize)
                ids = np.frombuffer(f.read(int(bounds[-1] - bounds[0]) * self.kind.itemsize), self.kind)
                nulls = max(0, min(take, self.n_null - at))
                keys = self.keys.slice(at + nulls - self.n_null, at + take - self.n_null) + self.least
                yield at, [None] * nulls + keys.tolist(), bounds, ids
                at += take


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document of the shards.

    One task a shard; the ids before a shard are a running sum over the
    manifest, which has one short row a shard.
    """
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def each(batches):
        for b in batches:
            for row in b.to_pylist():
                for _, keys, bounds, ids in Shard(folder, row["name"]).documents():
                    wide, cuts = ids.astype("<u4"), bounds - bounds[0]
                    crc = [zlib.crc32(wide[x:y]) for x, y in zip(cuts, cuts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], schema=schema)

    return shards.repartition(n, "shard").mapInArrow(each, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write all documents as shards, then read the files back."""
    folder = folder or shared_path(docs.sparkSession, "llm-token-files")
    return read_shards(write_shards(docs, vocabulary, end_id, folder), folder)

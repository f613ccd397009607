"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding uses a score-ordered agenda of adjacent symbol pairs: every pair of
neighbours whose concatenation is a piece is an agenda entry, the entry with
the highest score (leftmost on ties) is merged, and the two new neighbour
pairs join the agenda.  Characters that are no piece fall back to bytes.

A text is first cut where no merge can ever cross: before a blank run that
follows another character, at line feeds, and inside a segment where a run of
letters meets other characters that no piece joins to it.  The cuts are
derived from the vocabulary when it is loaded.  Segments and their parts
repeat, so each worker keeps bounded memos of them.  In every Arrow batch all
parts that are not in the memo, and the first text as a whole, are also
encoded by the sentencepiece library; any difference raises.

Defined results: a null text is read as empty; an empty text has the end id
alone; repeated rows give repeated results; an empty table gives no rows.
"""
from __future__ import annotations

import heapq
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\u2581"
#: Entries of a worker's memos of segments and of their parts (about 250 bytes each); a full one is emptied.
MEMO_SEGMENTS = 200_000
MEMO_PARTS = 400_000
#: Longest key of a memo, in characters: text without blanks comes in long parts that hardly repeat.
MEMO_CHARS = 64
#: Characters up to which the agenda is a plain list: its minimum is found sooner than a heap is kept up.
LIST_AGENDA = 24


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


class PieceEncoder:
    """A merge-type vocabulary read from a sentencepiece model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.lib.get_piece_size()
        self.bytes = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = self.lib.eos_id()
        special = lambda i: self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i)
        if any(self.lib.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.piece_id = {self.lib.id_to_piece(i): i for i in range(n) if not special(i)}
        self.cost = {p: -self.lib.get_score(i) for p, i in self.piece_id.items()}
        longer = [p for p in self.piece_id if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("a piece holds an inner blank: texts cannot be cut at blanks")
        if any("\n" in p for p in longer):
            raise ValueError("a piece joins the line feed: texts cannot be cut at lines")
        self.joined = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        self.text_of = [*map(str, range(n))]
        self.known = _Memo(self._segment)  # ids of segments
        self.parts = _Memo(self._part)
        self.unchecked: list[tuple[str, tuple[int, ...]]] = []
        self.cut = re.compile("\n|" + SPACE + "*[^" + SPACE + "\n]+|" + SPACE + "+").findall
        self.runs = re.compile(SPACE + r"*[^\W\d_]+|(?:(?!" + SPACE + r"*[^\W\d_])[\s\S])+").findall

    def segments(self, text: str) -> list[str]:
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def parts_of(self, segment: str) -> list[str]:
        """Runs of letters and of other characters, where no piece joins them."""
        if segment.lstrip(SPACE).isalpha():
            return [segment]
        runs = self.runs(segment)
        out = [runs[0]]
        for run in runs[1:]:
            if out[-1][-1] + run[0] in self.joined:
                out[-1] += run
            else:
                out.append(run)
        return out

    def _segment(self, segment: str) -> tuple[int, ...]:
        parts = self.parts_of(segment)
        return tuple(chain.from_iterable(map(self.parts.__getitem__, parts))) if len(parts) > 1 else self.parts[segment]

    def _part(self, part: str) -> tuple[int, ...]:
        ids = tuple(self.merge(part))
        self.unchecked.append((part, ids))
        return ids

    def merge(self, segment: str) -> list[int]:
        """Ids of one part by the agenda of adjacent pairs."""
        sym = self._merge_short(segment) if len(segment) <= LIST_AGENDA else self._merge_long(segment)
        out: list[int] = []
        for s in sym:
            i = self.piece_id.get(s)
            if i is None:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                out.append(i)
        return out

    def _merge_short(self, segment: str) -> list[str]:
        get, sym, none = self.cost.get, list(segment), float("inf")
        agenda = [get(a + b, none) for a, b in zip(sym, sym[1:])]
        while agenda and (least := min(agenda)) != none:
            i = agenda.index(least)  # the leftmost of them
            sym[i] += sym.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = get(sym[i - 1] + sym[i], none)
            if i < len(agenda):
                agenda[i] = get(sym[i] + sym[i + 1], none)
        return sym

    def _merge_long(self, segment: str) -> list[str]:
        cost, sym, n = self.cost, list(segment), len(segment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = sym[i] + sym[i + 1]
            if pair in cost:
                agenda.append((cost[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            left = sym[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(sym[j]) != len(piece) or left + sym[j] != piece:
                continue  # one side has been merged since
            sym[i], sym[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair = piece + sym[k]
                if pair in cost:
                    heapq.heappush(agenda, (cost[pair], i, pair))
            h = before[i]
            if h >= 0:
                pair = sym[h] + piece
                if pair in cost:
                    heapq.heappush(agenda, (cost[pair], h, pair))
        return [s for s in sym if s is not None]

    def _check(self, text: str, ids: list[int]) -> None:
        """Hold the parts that are new since the last check, and one whole text, against the library."""
        # behind a line feed a part stands alone: the first ids are the dummy blank and the feed
        skip = len(self.lib.encode("\n"))
        library = self.lib.encode(["\n" + p.replace(SPACE, " ") for p, _ in self.unchecked], num_threads=1) if self.unchecked else ()
        for (p, got), want in zip(self.unchecked, library):
            if got != tuple(want[skip:]):
                raise ValueError(f"part {p[:80]!r}: agenda {got[:20]}, library {want[skip:][:20]}")
        self.unchecked.clear()
        if ids[:-1] != (want := self.lib.encode(text)):
            raise ValueError(f"ids of {text[:80]!r} differ from the library's {want[:20]}")

    def ids_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, with the end id."""
        for memo, most in ((self.known, MEMO_SEGMENTS), (self.parts, MEMO_PARTS)):
            if len(memo) > most:
                memo.clear()
        get = self.known.__getitem__
        out = [[*chain.from_iterable(map(get, self.segments(t))), self.end] for t in texts]
        if texts:
            self._check(texts[0], out[0])
        return out

    def ids_text(self, ids: list[int]) -> str:
        """Ids as decimal numbers joined by one blank."""
        return " ".join(map(self.text_of.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return self.ids_batch([text])[0]

    def decode(self, batch: list[list[int]]) -> list[str]:
        return self.lib.decode(batch, num_threads=1)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(model_path: str) -> PieceEncoder:
    """One encoder a worker and vocabulary."""
    if model_path not in _ENCODERS:
        _ENCODERS[model_path] = PieceEncoder(model_path)
    return _ENCODERS[model_path]


def _slices(texts, most: int = 1 << 21):
    """Rows of a batch in runs of about ``most`` characters, so that id lists stay small."""
    run, size = [], 0
    for t in texts:
        run.append(t.as_py() or "")
        size += len(run[-1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_column(text: Column, model_path: str) -> Column:
    """array<int>: ids of each text with the end id."""
    @F.arrow_udf("array<int>")
    def pieces(texts: pa.Array) -> pa.Array:
        enc, out = encoder(model_path), []
        for run in _slices(texts):
            out += enc.ids_batch(run)
        return pa.array(out, pa.list_(pa.int32()))
    return pieces(text)


def decode_column(ids: Column, model_path: str) -> Column:
    """string: the texts of id lists (null: empty)."""
    @F.arrow_udf("string")
    def texts(batch: pa.Array) -> pa.Array:
        enc = encoder(model_path)
        return pa.array([enc.decode([x.as_py() or []])[0] for x in batch], pa.string())
    return texts(ids)


def round_trip_column(text: Column, model_path: str) -> Column:
    """struct<ids, text>: ids of each text with the end id, and the text decoded from them."""
    @F.arrow_udf("struct<ids:array<int>, text:string>")
    def both(texts: pa.Array) -> pa.Array:
        enc, ids, decoded = encoder(model_path), [], []
        for run in _slices(texts):
            lists = enc.ids_batch(run)
            ids += lists
            decoded += enc.decode(lists)
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["ids", "text"])
    return both(text)


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    The digests are taken inside the batch: only three short columns come back from Python.
    """
    import hashlib

    @F.arrow_udf("struct<n_tokens:bigint, ids_sha256:string, decoded_sha256:string>")
    def digest(texts: pa.Array) -> pa.Array:
        enc, n, ids, decoded = encoder(model_path), [], [], []
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for run in _slices(texts):
            lists = enc.ids_batch(run)
            n += map(len, lists)
            ids += [sha(enc.ids_text(x)) for x in lists]
            decoded += map(sha, enc.decode(lists))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")

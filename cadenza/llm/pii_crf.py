"""Personal data: named patterns and a skip-chain conditional random field.

Nodes of the field are the entity candidates of a whole document: every match
of the base patterns, and every other number or address that looks like one;
a run of numbers between them gives its parts and their joins too, and of
those found that overlap the one closest to a base match stays, else the surest.
Neighbouring candidates are joined by chain edges; candidates that repeat or
resemble each other (same digits, same last eight digits, same mailbox) are
joined by skip edges, however far apart, through one hub variable for each
key, so the number of edges stays linear and any two mentions are two steps
apart.  The hub of a key that base matches have is observed with their kind,
so a label does not depend on the number of repeats.  Loopy sum-product message
passing then runs until the messages settle and gives each candidate its label.  Base matches are observed and keep their label; a
candidate that no pattern took is added where its belief in a kind exceeds
``BELIEF``.

Training is piecewise: Spark counts, over all documents, how often each
feature pattern and each pair of labels across chain and skip edges occurs.
Labels are distant ones: a base match has its kind, another candidate that of
a base match with the same or similar digits or address in its document.  Node weights
are a regularised softmax regression on the pattern counts, edge potentials
are smoothed pointwise mutual information.  The counts have as many rows as
there are patterns (at most a few thousand), whatever the input.

Defined results: null and empty texts have no spans; repeated rows give
repeated results; a corpus without candidates needs no model.
"""
from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
HUB = "hub"  # pattern of hub variables
BELIEF = 0.6
SETTLED = 1e-4  # largest move of a message
PATIENCE = 32  # rounds, besides those to cross the field, in which the largest change must halve, else the step does
FAR = 1 << 30
NEAR = 40  # characters between neighbours of the chain
L2 = 1e-3

#: The base patterns.  An e-mail match has one "@", so it is found from there, and
#: its mailbox in the reversed text; an IP match starts where its digits do.  So a long run is read once.
_AT = re.compile(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
_MAILBOX = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9][\x20()./0-9-]*[0-9]")
_PART = re.compile(r"[+(]?[0-9](?:[().0-9-]*[0-9])?")
_SEPARATOR = re.compile(r"@|\x20?[\[(]at[\])]\x20?")
_SIDE = re.compile(r"[^\s@<>,;:]+")
_HOST = re.compile(r"[^\s@<>,;:]+(?:\x20?[\[(]dot[\])]\x20?[^\s@<>,;:\[(]+)*")
_CUE = re.compile(r"([^\W\d_]+)[\W_]*\Z")
#: Words that announce an entity.
CUES = {
    "mail": "mail", "email": "mail", "contact": "mail", "write": "mail", "phone": "phone", "tel": "phone", "telephone": "phone", "call": "phone",
    "fax": "phone", "mobile": "phone", "telefon": "phone", "card": "card", "visa": "card", "credit": "card", "ip": "ip", "host": "ip", "server": "ip",
    "address": "ip", "order": "number", "id": "number", "no": "number", "invoice": "number", "isbn": "number", "version": "number",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out, last, n = [], 0, len(text)
    back = text[::-1] if "@" in text else ""
    for m in _AT.finditer(text):
        # the mailbox is the whole run before "@", after the match before
        box = _MAILBOX.match(back, n - m.start(), n - last)
        if box:
            out.append((0, n - box.end(), m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


@dataclass
class Node:
    start: int
    stop: int
    kind: int  # of the base match, or -1
    pattern: str
    exact: str
    similar: str


def _node(text: str, start: int, stop: int, kind: int) -> Node:
    s = text[start:stop]
    cue = _CUE.search(text[max(0, start - 24) : start])
    cue = CUES.get(cue.group(1).lower(), "-") if cue else "-"
    if kind == 0 or "@" in s or "at]" in s or "at)" in s:
        exact = re.sub(r"\x20?[\[(]dot[\])]\x20?", ".", re.sub(r"\x20?[\[(]at[\])]\x20?", "@", s.lower()))
        box, _, host = exact.partition("@")
        return Node(start, stop, kind, f"at|{cue}|{'dot' if '.' in host else 'bare'}", exact, "@" + box)
    d = _digits(s)
    size = "7" if len(d) < 8 else "8-11" if len(d) < 12 else "12-15" if len(d) < 16 else "16-19" if len(d) < 20 else "20"
    parts = s.split(".")
    form = "quad" if len(parts) == 4 and all(p.isdigit() for p in parts) else "plus" if s[0] == "+" else "paren" if "(" in s else "split" if re.search(r"[\x20.-]", s) else "run"
    # the same number may stand with or without its country code
    return Node(start, stop, kind, f"num|{cue}|{size}|{form}|{'luhn' if luhn(d) else '-'}", "#" + d, "#" + d[-8:])


def _free(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the sorted base matches leave of a run."""
    out = []
    for x, y in taken:
        if a < x:
            out.append((a, x))
        a = max(a, y)
    return [*out, (a, b)] if a < b else out


def _keys(digits: str) -> tuple[str, str]:
    return digits, digits[-8:]


def _numbers(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Number runs between base matches, their parts of 7 to 19 digits, and joins of parts that stand elsewhere on their own.

    A join of neighbouring parts is a candidate only if its digits, or the last
    eight, are those of a base match or of a whole run or part.  So a table of
    short numbers gives no more candidates than it has runs and parts, and the
    joins are only looked up.
    """
    out, known, split, at = set(), set(), [], 0
    for a, b in taken:
        known.update(_keys(_digits(text[a:b])))
    for m in _NUMBER.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        stop = at
        while stop < len(taken) and taken[stop][0] < m.end():
            stop += 1
        for x, y in _free(*m.span(), taken[at:stop]):
            for run in _NUMBER.finditer(text, x, y):
                digits = _digits(run.group())
                if len(digits) >= 7:
                    out.add(run.span())
                if len(digits) <= 19:
                    known.update(_keys(digits))
                if len(digits) > 7:
                    split.append((*run.span(), digits))
    pieces = []
    for x, y, digits in split:
        parts, n = [], 0
        for p in _PART.finditer(text, x, y):
            d = len(_digits(p.group()))
            parts.append((p.start(), p.end(), n, n + d))
            if 7 <= d <= 19:
                out.add(p.span())
                known.update(_keys(digits[n : n + d]))
            n += d
        if len(parts) > 1:
            pieces.append((digits, parts))
    for digits, parts in pieces:
        for i, (start, _, first, _) in enumerate(parts):
            for _, end, _, last in parts[i + 1 : i + 19]:
                n = last - first
                if n > 19:
                    break
                if n >= 7 and (digits[last - 8 : last] if n >= 8 else digits[first:last]) in known:
                    out.add((start, end))
    return sorted(out)


def _addresses(text: str) -> list[tuple[int, int]]:
    """Runs on both sides of "@" or a spelt-out "at"."""
    if "@" not in text and "at]" not in text and "at)" not in text:
        return []
    out, last, n, back = [], 0, len(text), text[::-1]
    for m in _SEPARATOR.finditer(text):
        left = _SIDE.match(back, n - m.start(), n - last) if m.start() >= last else None
        right = _HOST.match(text, m.end()) if left else None
        if right:
            last = right.end()
            out.append((n - left.end(), last))
    return out


def nodes_of(text: str) -> list[Node]:
    """All candidates of a text, by start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    found = [_node(text, a, b, k) for k, a, b in base]
    merged: list[tuple[int, int]] = []  # base matches may overlap
    for a, b in taken:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    found += [_node(text, a, b, -1) for a, b in _numbers(text, merged)]
    at = 0
    for a, b in _addresses(text):
        while at < len(merged) and merged[at][1] <= a:
            at += 1
        if at == len(merged) or merged[at][0] >= b:  # no base match has it
            found.append(_node(text, a, b, -1))
    return sorted(found, key=lambda n: (n.start, n.stop, n.kind))


def _mentions(nodes: list[Node]) -> list[list[int]]:
    """Candidates of each key that two or more have, each set of candidates once: the hubs."""
    of: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        for key in {n.exact, n.similar}:
            of.setdefault(key, []).append(i)
    return [list(m) for m in dict.fromkeys(tuple(m) for m in of.values() if len(m) > 1)]


def hubs_of(nodes: list[Node]) -> list[int]:
    """Kind of each hub, or -1: the commonest of base matches with its key, else with the similar key."""
    known: dict[str, list[int]] = {}
    for n in nodes:
        if n.kind >= 0:
            known.setdefault(n.similar, []).append(n.kind)
    out = []
    for m in _mentions(nodes):
        kinds = [nodes[i].kind for i in m if nodes[i].kind >= 0] or known.get(nodes[m[0]].similar, [])
        out.append(max(sorted(set(kinds)), key=kinds.count, default=-1))
    return out


def edges_of(nodes: list[Node]) -> list[tuple[int, int, int]]:
    """(a, b, type): 0 for neighbours, 1 from a hub (numbered after the candidates) to a candidate with its key."""
    # candidates may overlap: the neighbour of one is the last that ends before it
    out, ended, at = [], sorted(range(len(nodes)), key=lambda i: (nodes[i].stop, nodes[i].start)), 0
    for i, n in enumerate(nodes):
        while at < len(ended) and nodes[ended[at]].stop <= n.start:
            at += 1
        if at and n.start - nodes[ended[at - 1]].stop <= NEAR:
            out.append((ended[at - 1], i, 0))
    return out + [(len(nodes) + h, i, 1) for h, m in enumerate(_mentions(nodes)) for i in m]


def distant_labels(nodes: list[Node]) -> list[int]:
    """Label of each candidate: its base kind, else that of a base match with the same or a similar key."""
    known = {key: n.kind for n in nodes if n.kind >= 0 for key in (n.similar, n.exact)}
    return [1 + (n.kind if n.kind >= 0 else known.get(n.exact, known.get(n.similar, -1))) for n in nodes]


def nearness(nodes: list[Node]) -> list[int]:
    """Difference in length between each candidate's key and that of the closest base match with a similar key; FAR without one."""
    known: dict[str, set[int]] = {}
    for n in nodes:
        if n.kind >= 0:
            known.setdefault(n.similar, set()).add(len(n.exact))
    return [min((abs(len(n.exact) - k) for k in known.get(n.similar, ())), default=FAR) for n in nodes]


# ---------------------------------------------------------------------- model
@dataclass
class Field:
    """Log potentials: of patterns for labels, and of label pairs for both edge types."""

    unary: dict[str, np.ndarray]
    pairwise: np.ndarray
    prior: np.ndarray

    def beliefs(self, nodes: list[tuple[int, str]], edges: list[tuple[int, int, int]]) -> np.ndarray:
        """Loopy sum-product: rows of label probabilities for (base kind or -1, pattern) nodes."""
        logs = np.stack([np.zeros(len(LABELS)) if p == HUB else self.unary.get(p, self.prior) for _, p in nodes])
        for i, (kind, _) in enumerate(nodes):
            if kind >= 0:  # observed
                logs[i] = -1e9  # beyond any sum of messages
                logs[i, 1 + kind] = 0.0
        if edges:
            e = np.array(edges)
            src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
            # potentials [x, y], label x at the source and y at the destination, by edge type and direction
            kernel = np.exp(self.pairwise)
            kind = np.concatenate([e[:, 2], e[:, 2] + 2])
            groups = [(np.flatnonzero(kind == t), k) for t, k in enumerate([*kernel, *kernel.transpose(0, 2, 1)])]
            back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
            message = np.zeros((len(src), len(LABELS)))
            step, best, since = 0.5, np.inf, 0
            while True:
                total = logs.copy()
                np.add.at(total, dst, message)
                out = total[src] - message[back]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.empty_like(out)
                for rows, k in groups:
                    new[rows] = np.log(out[rows] @ k + 1e-30)
                new -= new.max(1, keepdims=True)
                moved = np.abs(new - message).max()
                message = (1 - step) * message + step * new
                if moved * min(1.0, 2 * step) < SETTLED:
                    break
                # messages are bounded, so either the change or the step halves until they rest
                since += 1
                if moved < 0.5 * best:
                    best, since = moved, 0
                elif since == PATIENCE + 2 * len(nodes):
                    step, best, since = step / 2, moved, 0
            np.add.at(logs, dst, message)
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(patterns: list[tuple[str, int, int]], pairs: np.ndarray) -> Field:
    """patterns: (pattern, label, count); pairs: counts [type, label, label]."""
    names = sorted({p for p, *_ in patterns})
    parts = [[f"{i}{x}" for i, x in enumerate(p.split("|"))] + [p] for p in names]
    columns = {x: i for i, x in enumerate(sorted({x for ps in parts for x in ps}))}
    x = np.zeros((len(names), len(columns) + 1))
    x[:, -1] = 1
    for i, ps in enumerate(parts):
        x[i, [columns[c] for c in ps]] = 1
    counts, row = np.zeros((len(names), len(LABELS))), {p: i for i, p in enumerate(names)}
    for p, label, n in patterns:
        counts[row[p], label] += n
    total, w = counts.sum(), np.zeros((x.shape[1], len(LABELS)))
    velocity, rate = np.zeros_like(w), 1.0
    for _ in range(400):  # softmax regression on the counts, by momentum
        z = x @ (w + 0.9 * velocity)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = x.T @ (p * counts.sum(1, keepdims=True) - counts) / total + L2 * w
        velocity = 0.9 * velocity - rate * grad / x.shape[1] ** 0.5
        w += velocity
    z = x @ w
    z -= np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) + z.max(1, keepdims=True)
    joint = pairs + pairs.transpose(0, 2, 1) + 0.5  # smoothed
    joint /= joint.sum((1, 2), keepdims=True)
    side = joint.sum(2)
    pairwise = np.log(joint) - np.log(side[:, :, None] * side[:, None, :])
    prior = np.log((counts.sum(0) + 1) / (total + len(LABELS)))
    return Field(dict(zip(names, z)), pairwise, prior)


# ------------------------------------------------------------------- on Spark
_NODE = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()), ("label", pa.int32()), ("near", pa.int32()), ("pattern", pa.string())])
_EDGE = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("type", pa.int32())])
CANDIDATES = "struct<nodes:array<struct<start:int, stop:int, kind:int, label:int, near:int, pattern:string>>, edges:array<struct<a:int, b:int, type:int>>>"


def candidates_column(text: Column) -> Column:
    @F.arrow_udf(CANDIDATES)
    def candidates(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            nodes = nodes_of(t.as_py() or "")
            labels = distant_labels(nodes)
            # hubs follow the candidates, without a place in the text
            hubs = [{"start": -1, "stop": -1, "kind": k, "label": 1 + k, "near": FAR, "pattern": HUB} for k in hubs_of(nodes)]
            rows.append({
                "nodes": [{"start": n.start, "stop": n.stop, "kind": n.kind, "label": y, "near": d, "pattern": n.pattern} for n, y, d in zip(nodes, labels, nearness(nodes))] + hubs,
                "edges": [{"a": a, "b": b, "type": t} for a, b, t in edges_of(nodes)],
            })
        return pa.array(rows, pa.struct([("nodes", pa.list_(_NODE)), ("edges", pa.list_(_EDGE))]))
    return candidates(text)


def fit(candidates: DataFrame) -> Field:
    """Train on the candidates (nodes, edges) of all documents."""
    nodes = candidates.select(F.explode("nodes").alias("n")).where(F.col("n.pattern") != HUB).groupBy("n.pattern", "n.label").count()
    ends = candidates.select(F.explode("edges").alias("e"), "nodes")
    ends = ends.select("e.type", F.get("nodes", F.col("e.a"))["label"].alias("x"), F.get("nodes", F.col("e.b"))["label"].alias("y"))
    pairs = np.zeros((2, len(LABELS), len(LABELS)))
    for r in ends.groupBy("type", "x", "y").count().collect():  # 2 * 25 rows at most
        pairs[r["type"], r["x"], r["y"]] = r["count"]
    patterns = [(r["pattern"], r["label"], r["count"]) for r in nodes.collect()]  # as many as there are feature patterns
    if not patterns:
        return Field({}, pairs, np.zeros(len(LABELS)))
    return train(sorted(patterns), pairs)


SPANS = "array<struct<kind:int, start:int, stop:int>>"


def apart(found: list[tuple[int, float, dict]]) -> list[dict]:
    """Of (nearness, minus belief, span) that overlap, the one closest to a base match stays, then the surer, then the longer."""
    starts, kept = [], []
    for _, _, s in sorted(found, key=lambda x: (x[0], round(x[1], 3), x[2]["start"] - x[2]["stop"], x[2]["start"])):
        i = bisect.bisect(starts, s["start"])
        if (i == 0 or kept[i - 1]["stop"] <= s["start"]) and (i == len(kept) or kept[i]["start"] >= s["stop"]):
            starts.insert(i, s["start"])
            kept.insert(i, s)
    return kept


def added_column(nodes: Column, edges: Column, field: Field) -> Column:
    """Spans of candidates that no base pattern took and the field gives a kind."""
    @F.arrow_udf(SPANS)
    def added(nodes: pa.Array, edges: pa.Array) -> pa.Array:
        rows = []
        for ns, es in zip(nodes.to_pylist(), edges.to_pylist()):
            out = []
            if any(n["kind"] < 0 and n["pattern"] != HUB for n in ns):
                p = field.beliefs([(n["kind"], n["pattern"]) for n in ns], [(e["a"], e["b"], e["type"]) for e in es])
                for n, q in zip(ns, p):
                    best = int(q.argmax())
                    if n["kind"] < 0 and n["pattern"] != HUB and best and q[best] > BELIEF:
                        out.append((n["near"], -float(q[best]), {"kind": best - 1, "start": n["start"], "stop": n["stop"]}))
            rows.append(apart(out))
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])))
    return added(nodes, edges)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: array<struct<kind, start, stop>> by kind (place in ``KINDS``) and start."""
    found = materialise(docs.select("doc_id", candidates_column(docs["text"]).alias("c")).select("doc_id", "c.nodes", "c.edges"), "candidates")
    field = fit(found)
    base = F.transform(F.filter("nodes", lambda n: (n["kind"] >= 0) & (n["pattern"] != HUB)), lambda n: F.struct(n["kind"].alias("kind"), n["start"].alias("start"), n["stop"].alias("stop")))
    out = found.select("doc_id", F.array_sort(base).alias("base"), added_column(F.col("nodes"), F.col("edges"), field).alias("more"))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")

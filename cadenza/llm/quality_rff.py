"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of each text (lengths, character classes, repetition, lines) are
standardised and mapped to random Fourier features, whose inner products
approximate a Gaussian kernel.  Ridge scores come from normal equations that
every partition sums over its own labelled rows; the partial sums meet row by
row of the matrix, so neither the driver nor a task sees more than one matrix.
Isotonic regression on rows kept out of the ridge fit turns scores into
probabilities; it is fitted on a histogram of at most ``BINS`` rows.

All labelled rows are used; nothing is sampled.  The random features and bins
are fixed by ``SEED``, so a retried task computes the same.

Defined results: null and empty texts have statistics like any other (all
zero) and a score; null labels and labels of unknown documents are ignored; a
repeated label counts again; without any label every score is 0.5.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import materialise

SEED = 7
FEATURES = 256
RIDGE = 1e-3
BINS = 2000
FOLDS = 5
THRESHOLD = 0.3

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".!?",
    "pause": b",;:",
    "symbol": b"#*$%&|<>@^~_=+\\{}[]",
    "blank": b" \t\n\x0b\x0c\r",
    "quote": b"\"'()-/",
}
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(_KINDS.values(), 1):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _i
_CLASS[0xC0:] = len(_KINDS) + 1  # first byte of a character beyond ASCII
_CLASS[0x80:0xC0] = len(_KINDS) + 2  # its other bytes
N_STATS = 24


def text_stats(text: str | None) -> list[float]:
    """``N_STATS`` statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * N_STATS
    by_class = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(_KINDS) + 3)
    other, upper, lower, digit, stop, pause, symbol, blank, quote, wide = by_class[: len(_KINDS) + 2].tolist()
    chars = max(1, len(raw) - int(by_class[-1]))
    words = raw.split()
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_sizes = [len(x) for x in lines] or [0]
    return [
        np.log1p(chars), np.log1p(n), float(sizes.mean()), float(sizes.std()), np.log1p(float(sizes.max())),
        len(counts) / max(1, n), max(counts.values(), default=0) / max(1, n), 1 - pairs / max(1, n - 1),
        (upper + lower + wide) / chars, upper / chars, digit / chars, stop / chars, pause / chars, symbol / chars,
        blank / chars, quote / chars, wide / chars, other / chars, stop / max(1, n), symbol / max(1, n),
        np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(float(np.mean(line_sizes))),
        sum(x < 30 for x in line_sizes) / max(1, len(lines)),
    ]


def stats_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array([text_stats(t.as_py()) for t in texts], pa.list_(pa.float64()))
    return stats(text)


def fold_column(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo ``FOLDS`` (null: -1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(-1)).cast("int")


# ---------------------------------------------------------------------- model
@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None  # ridge weights of the features and an intercept
    knots: np.ndarray | None = None  # isotonic calibration: scores ...
    values: np.ndarray | None = None  # ... and their probabilities

    def features(self, stats: np.ndarray) -> np.ndarray:
        """cos(Wx + b) features and a constant, for rows of statistics."""
        rng = np.random.default_rng(SEED)
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        w = rng.normal(size=(x.shape[1], FEATURES)) / np.sqrt(x.shape[1])
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Probabilities; a thousandth is left to the ridge score, so that steps keep its order."""
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        steps = raw if self.knots is None else np.interp(raw, self.knots, self.values)
        return np.clip(0.999 * np.clip(steps, 0, 1) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def pool_adjacent(x: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours that decrease: (x, fitted mean) at each input x."""
    blocks: list[list[float]] = []
    for w, t in zip(weight, total):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return x, np.repeat([t / w for w, t, _ in blocks], [n for *_, n in blocks])


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, N_STATS)


def normal_equations(train: DataFrame, model: QualityModel) -> np.ndarray:
    """[Z'Z | Z'y] over all rows (stats, y): partition sums, then one sum for each row of the matrix."""
    size = FEATURES + 1

    def partial(batches):
        total = np.zeros((size, size + 1))
        for b in batches:
            z, y = model.features(_matrix(b.column("stats"))), b.column("y").to_numpy(zero_copy_only=False)
            total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total))], ["i", "sums"])

    parts = train.select("stats", "y").mapInArrow(partial, "i int, sums array<double>")
    # a running vector sum for each row of the matrix, however many partitions there are
    sums = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("sums")).alias("s"))
    rows = sums.select("i", vector_to_array("s").alias("sums")).collect()  # FEATURES + 1 rows
    return np.array([r.sums for r in sorted(rows, key=lambda r: r.i)])


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on rows of ``stats`` (doc_id, stats) that have a label (doc_id, quality) and a fold other than 0.

    The last fold calibrates and the others fit the ridge scores; where one of
    them is empty (tiny inputs) all rows do both.
    """
    labelled = labels.where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    train = stats.join(labelled, "doc_id").withColumn("fold", fold_column(F.col("doc_id"))).where("fold > 0").select("stats", "y", "fold")
    train = materialise(train, "labelled")
    count = {r.fold: r["count"] for r in train.groupBy("fold").count().collect()}
    if not count:
        return QualityModel(np.zeros(N_STATS), np.ones(N_STATS))
    last = F.col("fold") == FOLDS - 1
    both = 0 < count.get(FOLDS - 1, 0) < sum(count.values())
    ridge, calibrate = (train.where(~last), train.where(last)) if both else (train, train)
    moments = ridge.agg(*[f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(N_STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scale = np.array([moments[f"s{i}"] for i in range(N_STATS)])
    model = QualityModel(np.array([moments[f"m{i}"] for i in range(N_STATS)]), np.where(scale > 1e-9, scale, 1))
    sums = normal_equations(ridge, model)
    a, c = sums[:, :-1], sums[:, -1]
    penalty = np.full(len(c), RIDGE * max(a[-1, -1], 1000))
    penalty[-1] = 0
    model.weights = np.linalg.solve(a + np.diag(penalty + 1e-9), c)

    @F.arrow_udf("int")
    def bin_of(x: pa.Array) -> pa.Array:
        return pa.array(np.clip(np.rint(model.raw(_matrix(x)) * BINS / 2 + BINS / 4), 0, BINS).astype(np.int32))

    bins = calibrate.select(bin_of("stats").alias("bin"), "y").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).collect()  # BINS + 1 rows at most
    bins = np.array(sorted((r.bin, r.n, r.ones) for r in bins), np.float64)
    model.knots, model.values = pool_adjacent((bins[:, 0] - BINS / 4) / (BINS / 2), bins[:, 1], bins[:, 2])
    return model


# ------------------------------------------------------------------- operator
def score_stats_column(stats: Column, model: QualityModel) -> Column:
    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(x)))
    return score(stats)


def score_text_column(text: Column, model: QualityModel) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([text_stats(t.as_py()) for t in texts]).reshape(-1, N_STATS)))
    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; texts are read once."""
    stats = materialise(docs.select("doc_id", stats_column(docs["text"]).alias("stats")), "stats")
    model = fit(stats, labels)
    out = stats.select("doc_id", (fold_column(F.col("doc_id")) == 0).alias("held_out"), score_stats_column(F.col("stats"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (all columns) that are not rejected."""
    model = fit(docs.select("doc_id", stats_column(docs["text"]).alias("stats")), labels)
    return docs.where(score_text_column(docs["text"], model) >= threshold)

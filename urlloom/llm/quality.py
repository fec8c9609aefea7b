"""Quality scores from random Fourier features of document statistics.

Statistics of a whole text are standardised and mapped to random Fourier features, which
approximate a Gaussian kernel. Ridge regression is fitted from normal equations that each
task sums over its rows; isotonic regression on scores from the other folds turns its output
into a probability. Scoring is one scan of the texts, without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlloom.llm.common import column_bytes, discard, materialize, slices

STATISTICS = (
    "log_words log_chars log_lines word_length word_length_sd longest_word upper_share digit_share "
    "symbol_share bar_share exclaim_share comma_stop_share high_byte_share upper_word_share symbol_word_share "
    "distinct_words top_word repeated_next repeated_within_4 distinct_3_grams line_words distinct_lines "
    "stop_ended_lines short_words word_entropy byte_entropy packed_ratio"
).split()
#: Labelled ids that a fit uses at most, about.
SAMPLE = 200_000
PARTS = 16
FOLDS = 5
_UPPER, _DIGIT = np.zeros(256), np.zeros(256)
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL = np.zeros(256)
for _c in b"#$%&*+/<=>@[]\\^_`{}~":
    _SYMBOL[_c] = 1


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole UTF-8 text, in the order of STATISTICS; all finite."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, size, n_lines = len(words), len(text), len(lines)
    if not n:
        return [0.0] * len(STATISTICS)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    lengths = np.fromiter(map(len, words), np.int64, n)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    counts = np.bincount(ids)
    shares = counts / n
    grams = ids if n < 3 else np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1] * len(number) + ids[2:]  # below 2 ** 63 for any text
    near = np.zeros(n, bool)
    for k in range(1, 5):
        near[k:] |= ids[k:] == ids[:-k]
    upper_words = sum(int(c) for w, c in zip(number, counts, strict=True) if w.isupper() and len(w) > 1)
    symbol_words = sum(int(c) for w, c in zip(number, counts, strict=True) if w[-1] in b"#$%&*|!")
    p = seen[seen > 0] / size
    return [
        math.log1p(n),
        math.log1p(size),
        math.log1p(n_lines),
        float(lengths.mean()),
        float(lengths.std()),
        math.log1p(int(lengths.max())),
        float(seen @ _UPPER / size),
        float(seen @ _DIGIT / size),
        float(seen @ _SYMBOL / size),
        float(seen[124] / n),
        float(seen[33] / n),
        float((seen[44] + seen[46]) / n),
        float(seen[128:].sum() / size),
        upper_words / n,
        symbol_words / n,
        len(number) / n,
        float(shares.max()),
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        float(near.mean()),
        len(np.unique(grams)) / len(grams),
        math.log1p(n / n_lines),
        len(Counter(lines)) / n_lines,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / n_lines,
        float((lengths <= 3).mean()),
        float(-(shares @ np.log(shares)) / math.log(n + 1)),
        float(-(p @ np.log2(p))),
        len(zlib.compress(text, 1)) / size,
    ]


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))


def statistics_table(docs: DataFrame, *, text: str = "text", extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(x, extra columns): statistics of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = _matrix(column_bytes(batch, "_text"))
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1))), *[batch.column(c) for c in extra]], ["x", *extra])

    rows = docs.select(F.col(text).alias("_text"), *extra)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(["x array<double>", *[f"`{c}` {types[c]}" for c in extra]]))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of standardised statistics, with a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.cos(z @ self.weights + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([f, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values."""
    blocks: list[list[float]] = []  # weight, weighted mean, first x, last x
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        blocks.append([c, b, a, a])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, _, last = blocks.pop()
            w1, m1, first, _ = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), first, last])
    knots = np.array([k for b in blocks for k in ((b[2], b[3]) if b[2] < b[3] else (b[2],))])
    values = np.array([b[1] for b in blocks for _ in range(2 if b[2] < b[3] else 1)])
    return knots, values


def _summed(rows: DataFrame, run, schema: str) -> list:
    """The few rows that ``run`` makes of each partition."""
    return rows.mapInArrow(run, schema).collect()


def _training(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()


def fit(
    training: DataFrame,
    *,
    features: int = 256,
    ridge: float = 1e-3,
    width: float = 1.0,
    bins: int = 512,
    seed: int = 7,
) -> QualityModel:
    """Fit on a written table (x, y in 0/1, fold from 0 to FOLDS - 1).

    Normal equations are summed fold by fold. The isotonic curve is fitted to scores that each row gets from
    the ridge weights of the other folds; the model's own weights come from all folds. The
    table is read in PARTS even partitions, each of which sends a matrix of (features + 1)
    squared numbers for each fold, so what reaches the driver doesn't grow with the input.
    Calibration sums labels in ``bins`` equal steps of the score.
    A fit without rows, or with one class only, scores that class's share (0.5 without rows).
    """
    rows = training.repartition(PARTS)
    d, size = len(STATISTICS), features + 1

    def moments(batches):
        n, total, s, q = 0.0, 0.0, np.zeros(d), np.zeros(d)
        for batch in batches:
            v, y, _ = _training(batch)
            n, total, s, q = n + len(v), total + float(y.sum()), s + v.sum(0), q + (v * v).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([s.tolist()]), pa.array([q.tolist()])], ["n", "y", "s", "q"])

    found = _summed(rows, moments, "n double, y double, s array<double>, q array<double>")
    n = sum(r.n for r in found)
    rng = np.random.default_rng(seed)
    weights, phases = rng.normal(size=(d, features)) * width / math.sqrt(d), rng.uniform(0, 2 * math.pi, features)
    share = sum(r.y for r in found) / n if n else 0.5
    if share in (0.0, 1.0) or not n:
        return QualityModel(np.zeros(d), np.ones(d), weights, phases, np.zeros(size), np.array([0.0]), np.array([share]))
    mean = sum(np.array(r.s) for r in found) / n
    scale = np.sqrt(np.maximum(sum(np.array(r.q) for r in found) / n - mean**2, 1e-12))
    model = QualityModel(mean, scale, weights, phases, np.zeros(size), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def normal(batches):
        a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            v, y, fold = _training(batch)
            f = model.features(v)
            for k in np.unique(fold):
                g = f[fold == k]
                a[k] += g.T @ g
                b[k] += g.T @ y[fold == k]
        for k in range(FOLDS):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a[k].tobytes()]), pa.array([b[k].tobytes()])], ["fold", "a", "b"])

    a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
    for r in _summed(rows, normal, "fold int, a binary, b binary"):
        a[r.fold] += np.frombuffer(r.a).reshape(size, size)
        b[r.fold] += np.frombuffer(r.b)
    penalty = np.full(size, ridge * n / features)
    penalty[-1] = 1e-9 * n
    solve = lambda x, y: np.linalg.solve(x + np.diag(penalty), y)
    others = np.array([solve(a.sum(0) - a[k], b.sum(0) - b[k]) for k in range(FOLDS)])
    model.beta = solve(a.sum(0), b.sum(0))

    def binned(batches):
        w, s = np.zeros(bins), np.zeros(bins)
        for batch in batches:
            v, y, fold = _training(batch)
            raw = (model.features(v) * others[fold]).sum(1)
            at = np.clip(((raw + 0.5) / 2 * bins).astype(int), 0, bins - 1)
            w += np.bincount(at, minlength=bins)
            s += np.bincount(at, y, bins)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([s.tobytes()])], ["w", "s"])

    sums = _summed(rows, binned, "w binary, s binary")
    w, s = (sum(np.frombuffer(r[k]) for r in sums) for k in ("w", "s"))
    used = w > 0
    centre = (np.arange(bins) + 0.5) / bins * 2 - 0.5
    model.knots, model.values = isotonic(centre[used], (s[used] / w[used]), w[used])
    return model


def score_column(text: Column, model: QualityModel) -> Column:
    """Score in 0 to 1 (higher: label 1 likelier) of a text column; a null text counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [np.empty(0)]
        for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])]):
            out.append(np.clip(model.score(_matrix(column_bytes(part, "text"))), 0, 1))
        return pa.array(np.concatenate(out))

    return score(text)


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, **options) -> QualityModel:
    """Learn from ``labels`` (doc_id, label) and the texts of those ids.

    At most about ``sample`` labelled ids are used, chosen by a hash of the id, which bounds the fit and
    what is broadcast to find their texts; scoring knows no bound. An id with two labels
    counts with both, and repeated rows count each. Rows without a label or without an id teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("y")).filter("y is not null and _id is not null")
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < int(1_000_003 * sample / total))
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_t")).join(F.broadcast(known), "_id")
    folded = texts.withColumn("fold", F.pmod(F.xxhash64("_t", F.lit(1)), F.lit(FOLDS)).cast("int"))
    table = materialize(statistics_table(folded, text="_t", extra=("y", "fold")), "statistics")
    model = fit(table, **options)
    discard(table)
    return model


def train_and_score(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, score) for every row of ``docs``, learning from ``labels`` (doc_id, label).

    Repeated rows score alike. Empty and null texts get the score of all-zero statistics. A null id
    is scored like any other. Other columns are ignored. Learns from all given labels: leave
    out held-out rows beforehand.
    """
    model = train(docs, labels, doc_id=doc_id, text=text, **options)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), score_column(F.col(text), model).alias("score"))


def drop_low(docs: DataFrame, labels: DataFrame, *, least: float, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all columns as they are.

    Every row is judged by its own text, so rows that share an id don't go together. Nothing is shuffled.
    """
    model = train(docs, labels, text=text, **options)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), score_column(F.col(f"`{text}`"), model).alias("_score"))
    return row.filter(F.col("_score") >= least).select(*[F.col(f"_row.`{c}`").alias(c) for c in names])

"""Text quality by a factorisation machine.

Inputs are one-hot or real features of a text: its hashed words (weighted by
frequency, unit length), the bins of structure statistics, and bins of the
metadata column ``n_chars``. A factorisation machine scores them with a bias,
linear weights and low-rank pairwise interactions, in linear time by the
identity sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum v_if x_i)^2 -
sum (v_if x_i)^2). It is trained by AdaGrad on a bounded sample of labelled
documents and calibrated (Platt) on the part of that sample it was not fitted
on. Labels, language, source and id are never inputs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import written

LEARN_DOCS = 6_000  # labelled documents learned from, at most
WORD_BUCKETS = 1 << 14
RANK = 8
BINS = 12
EPOCHS = 8
RATE = 0.1
WORD_SCALE = 0.5
SEED = 5

# statistics and the range their bins cover
STATISTICS = (
    ("log_chars", 0, 18), ("log_words", 0, 16), ("word_length", 0, 16), ("upper", 0, 1), ("letters", 0, 1),
    ("digits", 0, 0.3), ("spaces", 0, 0.4), ("symbols", 0, 0.4), ("exclaims", 0, 0.2), ("distinct", 0, 1),
    ("top_word", 0, 0.5), ("repeats", 0, 0.5), ("no_letter_words", 0, 0.5), ("short_words", 0, 1), ("line_words", 0, 14),
    ("repeated_lines", 0, 1), ("pipes", 0, 0.1), ("n_chars", 0, 18), ("n_chars_off", 0, 2),
)
WIDTH = WORD_BUCKETS + len(STATISTICS) * BINS

# classes of code points below 0x250: 1 upper, 2 lower, 3 digit, 4 space, 5 other
_CLASS = np.array([1 if chr(c).isupper() else 2 if chr(c).isalpha() else 3 if chr(c).isdigit() else 4 if chr(c).isspace() else 5
                   for c in range(0x250)], np.uint8)


def statistics(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float]:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_CLASS[np.minimum(codes, 0x24F)] if len(codes) else np.zeros(0, np.uint8), minlength=6)
    n, w = max(len(codes), 1), max(len(words), 1)
    letters = kinds[1] + kinds[2]
    lines = text.split("\n")
    filled = [x for x in lines if x]
    marks = text.count("!")
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log2(len(codes) + 1), np.log2(len(words) + 1), (n - kinds[4]) / w, kinds[1] / max(letters, 1), letters / n,
        kinds[3] / n, kinds[4] / n, kinds[5] / n, marks / n, len(counts) / w,
        max(counts.values(), default=0) / w, repeats / w, sum(c for x, c in counts.items() if not any(map(str.isalpha, x))) / w,
        sum(c for x, c in counts.items() if len(x) <= 3) / w, np.log2(len(words) / max(len(filled), 1) + 1),
        1 - len(set(filled)) / max(len(filled), 1), text.count("|") / n,
        np.log2((n_chars or 0) + 1) if n_chars is None or n_chars >= 0 else 0.0,
        0.0 if n_chars is None else min(abs(np.log2((max(n_chars, 0) + 1) / (len(codes) + 1))), 2.0),
    ]


def features(text: str | None, n_chars: int | None, buckets: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one text; ``buckets`` remembers words."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    if len(buckets) > 500_000:
        buckets.clear()
    at = []
    for x in counts:
        b = buckets.get(x)
        if b is None:
            b = buckets[x] = zlib.crc32(x.lower().encode("utf-8", "replace")) % WORD_BUCKETS
        at.append(b)
    value = np.fromiter(counts.values(), np.float64, len(counts))
    if len(value):
        value *= WORD_SCALE / np.sqrt((value * value).sum())
    stats = statistics(text, words, counts, n_chars)
    bins = [WORD_BUCKETS + k * BINS + min(BINS - 1, max(0, int((s - lo) / (hi - lo) * BINS)))
            for k, (s, (_, lo, hi)) in enumerate(zip(stats, STATISTICS, strict=True))]
    return (np.concatenate([np.array(at, np.int64), np.array(bins, np.int64)]),
            np.concatenate([value, np.ones(len(bins))]))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float = 1.0  # of the calibration
    shift: float = 0.0

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        s = v.sum(axis=0)
        return float(self.bias + self.linear[at] @ x + 0.5 * ((s * s).sum() - (v * v).sum()))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        z = min(max(self.slope * self.raw(at, x) + self.shift, -35.0), 35.0)
        return float(1.0 / (1.0 + np.exp(-z)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32) -> Machine:
    """AdaGrad on the logistic loss, four fifths of the rows; Platt on the rest."""
    rng = np.random.default_rng(SEED)
    m = Machine(0.0, np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, RANK)))
    if len(set(labels.tolist())) < 2:  # nothing to tell apart
        m.bias = 6.0 if len(labels) and labels[0] == 1 else -6.0 if len(labels) else 0.0
        return m
    order = rng.permutation(len(rows))
    held = order[:max(1, len(rows) // 5)]
    learn = order[len(held):]
    g_bias, g_linear, g_factors = 1e-3, np.full(WIDTH, 1e-3), np.full((WIDTH, RANK), 1e-3)
    for _ in range(epochs):
        rng.shuffle(learn)
        for lo in range(0, len(learn), batch):
            part = learn[lo:lo + batch]
            at = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            size = np.array([len(rows[i][0]) for i in part])
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            v = m.factors[at] * x[:, None]
            s = np.add.reduceat(v, begin, axis=0)
            z = m.bias + np.add.reduceat(m.linear[at] * x, begin) + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), begin))
            d = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[part]) / len(part)
            each = np.repeat(d, size)
            u, inv = np.unique(at, return_inverse=True)
            gl = np.bincount(inv, each * x, len(u)) + 1e-5 * m.linear[u]
            grad = each[:, None] * x[:, None] * (np.repeat(s, size, axis=0) - v)
            gv = np.stack([np.bincount(inv, grad[:, f], len(u)) for f in range(RANK)], axis=1) + 1e-5 * m.factors[u]
            g_bias += d.sum() ** 2
            g_linear[u] += gl ** 2
            g_factors[u] += gv ** 2
            m.bias -= RATE * d.sum() / np.sqrt(g_bias)
            m.linear[u] -= RATE * gl / np.sqrt(g_linear[u])
            m.factors[u] -= RATE * gv / np.sqrt(g_factors[u])
    raw, y = np.array([m.raw(*rows[i]) for i in held]), labels[held]
    # Platt's targets keep the calibration finite on separable rows
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-6)
        ga, gb = ((p - target) * raw).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b
        haa, hab, hbb = (w * raw * raw).sum() + 1e-3, (w * raw).sum(), w.sum() + 1e-3
        det = haa * hbb - hab * hab
        step_a, step_b = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(step_a), abs(step_b))
        a, b = a - step_a / size, b - step_b / size
    m.slope, m.shift = float(max(a, 1e-3)), float(b)
    return m


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets: dict[str, int] = {}
    for batch in batches:
        found = [features(t, c, buckets) for t, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int64())),
             pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["id", "label", "at", "x"])


def _inputs(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), chars.alias("n_chars"))


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARN_DOCS) -> Machine:
    """A machine from ``labels (doc_id, quality)`` of ``docs``; at most the first
    ``most`` labelled documents by a hash of their id. Null labels teach nothing;
    an id with several labels counts with its largest; without labels, or with
    one class only, scores are constant."""
    chosen = (labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
              .agg(F.max("quality").cast("int").alias("label")).orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(most))
    rows = (_inputs(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # at most ``most`` rows
            .select("id", "label", "text", "n_chars").mapInArrow(_feature_rows, "id bigint, label int, at array<bigint>, x array<double>"))
    found = written(rows, "quality-features").orderBy("id").toArrow()
    at, x = found.column("at").to_pylist(), found.column("x").to_pylist()
    y = found.column("label").to_numpy().astype(float)
    return fit([(np.array(a), np.array(b)) for a, b in zip(at, x, strict=True)], y)


def _score(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    buckets: dict[str, int] = {}
    for batch in batches:
        found = [machine.score(*features(t, c, buckets))
                 for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """``(doc_id, score)`` of every row of ``docs (doc_id, text[, n_chars], ..)``:
    the calibrated probability of quality 1. Null texts score as empty ones;
    repeated rows and null ids give rows of their own; other columns are
    ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    return _inputs(docs).mapInArrow(lambda it: _score(it, sent.value), "doc_id bigint, score double")

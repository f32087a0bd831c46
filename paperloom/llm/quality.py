"""A document quality score learnt from preference pairs (Bradley-Terry).

Each document has a score s(x) = w . f(x), linear in features of its whole
text. A document of label 1 is preferred to one of label 0 with probability
sigmoid(s1 - s0); w minimises the logistic loss on the feature differences of
sampled pairs, with a ridge, by Newton steps. The cut is a quantile of the
training documents' scores: the lowest of those that separate the labels within
SLACK of the best balanced accuracy, so that doubtful documents stay.
The reported score is sigmoid(s - cut + logit(CUT)): it rises with s and passes
CUT exactly at the quantile.

The classifier is fitted on at most SAMPLE labelled documents (the bound; those
with the smallest hash), everything else covers all rows. Labels, language,
source and id are no features.

Results in special cases: null texts count as empty; empty texts get the score
that their features give; documents that are labelled several times count with
their mean label, over 0.5 being 1; null labels are skipped; without both labels
in the sample every score is 0.5; null ids are not held out and not learnt from;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, PAIRS, FOLDS, CUT, RIDGE, SLACK, SEED = 20_000, 200_000, 5, 0.3, 1e-3, 0.003, 7

_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_OTHER = np.array([b for b in range(33, 127) if not (65 <= b <= 90 or 97 <= b <= 122 or 48 <= b <= 57)])
FEATURES = ["log_words", "word_bytes", "upper", "digit", "symbol", "exclaim", "bar", "stop", "comma", "other", "same_next", "top_word", "distinct", "distinct_2", "line_copies", "line_words", "wide", "control", "capital_words"]


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = count[_UPPER].sum() + count[_LOWER].sum() + count[128:].sum()
    ink = max(1, len(raw) - count[_SPACE].sum())
    tally = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    twos = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stop, exclaim, bar, comma = count[46], count[33], count[124], count[44]
    symbol = count[_OTHER].sum() - stop - exclaim - bar - comma
    capitals = sum(map(bytes.istitle, words)) / n
    root = np.sqrt
    return [
        np.log1p(n), np.log(ink / n), root(count[_UPPER].sum() / max(1, letters)), root(count[_DIGIT].sum() / ink), root(symbol / n), root(exclaim / n), root(bar / n), root(stop / n), root(comma / n), root(1 - letters / ink) if letters < ink else 0.0,
        root(same / n), root(max(tally.values()) / n), len(tally) / n, twos / n, root(1 - len(set(lines)) / max(1, len(lines))), np.log1p(n / max(1, len(lines))), root(count[128:].sum() / ink), root(count[:9].sum() / ink), capitals,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -6, 6) @ self.w - self.cut + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """From features and labels 0/1."""
    k = len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(CUT / (1 - CUT))))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(k)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -50, 50)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(k)
        w = w - np.linalg.solve(hessian, gradient)
    s = z @ w
    at = np.linspace(0, 1, 401)[1:-1]
    cuts = np.quantile(s, at)
    balanced = np.array([(s[good] >= c).mean() + (s[bad] < c).mean() for c in cuts])
    best = np.flatnonzero(balanced >= balanced.max() - SLACK)
    return Model(mean, scale, w, float(cuts[best[0]]))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, folds: int = FOLDS) -> tuple[np.ndarray, np.ndarray]:
    key = F.col(f"`{id_col}`")
    y = labels.filter(key.isNotNull() & F.col(f"`{label_col}`").isNotNull() & (F.crc32(key.cast("string").cast("binary")) % folds != 0))
    y = y.groupBy(key.alias("id")).agg((F.avg(F.col(f"`{label_col}`").cast("double")) > 0.5).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(key.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(y), "id")  # at most `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    got = rows.select("text", "id", "y").mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, y int, x array<double>").toPandas().sort_values("id")
    return np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES)), got["y"].to_numpy()


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = fit(*training_rows(docs, labels, id_col, text_col, label_col, sample))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)], float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"id {id_type}, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return rows.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows whose score reaches the cut, all columns as they were."""
    model = fit(*training_rows(docs, labels, id_col, text_col, label_col, sample))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(at)], float).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)

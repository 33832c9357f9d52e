"""Quality classifier: Bradley-Terry scores learned from preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.labelled import fold_of, training_rows
from tidemark.llm.words import NOT_SPACE, STEP_BYTES, Words, steps


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789")
#: Groups of marks whose shares are features.
MARKS = [b"!", b"|", b"#$%&*@^~", b"<>{}[]\\=_+", b".,;:?", b"\n", b"'\"()-/"]


def features(words: Words) -> np.ndarray:
    """One row of features for each text; an empty text has zeros but for the last column, 1."""
    n = len(words)
    size = np.maximum(1, np.diff(words.offsets))
    count = np.diff(words.first)
    some = np.maximum(1, count)

    def per_byte(table: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for lo in range(0, len(words.raw), STEP_BYTES):
            sums = np.concatenate([[0], np.cumsum(table[words.raw[lo : lo + STEP_BYTES]])])
            at = np.clip(words.offsets - lo, 0, len(sums) - 1)
            out += sums[at[1:]] - sums[at[:-1]]
        return out

    upper, lower = per_byte(_UPPER), per_byte(_LOWER)
    shares = [upper / np.maximum(1, upper + lower), per_byte(_DIGIT) / size]
    shares += [per_byte(_mask(m)) / size for m in MARKS]
    same = np.zeros(len(words.key), bool)
    same[1:] = (words.key[1:] == words.key[:-1]) & (words.doc[1:] == words.doc[:-1])
    if n == 1:
        key, doc = np.sort(words.key), words.doc
    else:
        order = np.lexsort((words.key, words.doc))
        key, doc = words.key[order], words.doc[order]
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    shares += [np.bincount(words.doc[same], minlength=n) / some, np.bincount(doc[again], minlength=n) / some]
    length = words.end - words.start
    marked = ~(_LOWER | _mask(bytes(range(128, 256))))[words.buf[np.maximum(words.end - 1, 0)]] if len(length) else np.zeros(0, bool)
    shares += [np.bincount(words.doc[marked], minlength=n) / some, np.bincount(words.doc[length == 1], minlength=n) / some]
    mean = np.bincount(words.doc, weights=length, minlength=n) / some / 10
    out = np.column_stack([*shares, *(np.sqrt(s) for s in shares), mean, np.log1p(count) / 10, count == 0])
    return out.astype(np.float64)


@dataclass
class BradleyTerry:
    """mean, scale: of the features; weights: of the standardised features; cut: the utility at which the score is 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.utility(x) - self.cut, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int = 100_000, l2: float = 1e-3, seed: int = 7) -> BradleyTerry:
    """Learn utilities from (better, worse) pairs by logistic loss on feature differences.

    Every document of the smaller class meets as many of the other as
    max_pairs allows, at least one. The cut is the quantile of the training
    utilities that parts the labels with fewest errors (the middle of the
    gap there). With one class only, every score is on that class's side.
    """
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return BradleyTerry(mean, scale, np.zeros(x.shape[1]), -1.0 if len(good) or not len(bad) else 1.0)
    rng = np.random.default_rng(seed)
    few, many = sorted((good, bad), key=len)
    each = max(1, min(len(many), max_pairs // len(few)))
    a, b = np.repeat(few, each), np.concatenate([rng.choice(many, each, replace=False) for _ in few])
    if few is bad:
        a, b = b, a
    z = (x - mean) / scale
    diff = z[a] - z[b]
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method; the loss is convex
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        gradient = diff.T @ (p - 1) / len(diff) + l2 * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    u = z @ w
    order = np.argsort(u, kind="stable")
    ones = np.concatenate([[0], np.cumsum(y[order])])  # labels 1 below each quantile
    zeros = np.arange(len(y) + 1) - ones
    wrong = ones + (zeros[-1] - zeros)
    q = int(np.argmin(wrong))
    s = u[order]
    cut = s[0] - 1 if q == 0 else s[-1] + 1 if q == len(s) else (s[q - 1] + s[q]) / 2
    return BradleyTerry(mean, scale, w, float(cut))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", max_rows: int = 20_000) -> BradleyTerry:
    """Fit on at most max_rows labelled rows outside the held-out fold, and five pairs for each; only their few features come to the driver."""
    rows = training_rows(docs, labels, "quality", 3, 1, text, id, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in steps(batch.column(0), NOT_SPACE):
                yield pa.RecordBatch.from_arrays([pa.array(list(features(words))), batch.column(1).slice(row, len(words))], ["x", "label"])

    got = rows.mapInArrow(run, "x array<double>, label int").toPandas()
    x = np.array(got.x.tolist(), dtype=np.float64)
    if not len(got):
        x = np.zeros((0, features(next(steps(pa.array([""]), NOT_SPACE))[1]).shape[1]))
    order = np.lexsort((*x.T, got.label.to_numpy())) if len(got) else slice(None)  # as arrival varies
    return fit(x[order], got.label.to_numpy()[order], 5 * max_rows)


def score_quality(docs: DataFrame, model: BradleyTerry, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 from 0.5 on).

    Every row is scored from its whole text alone; a null text is empty, and
    an empty text gets the score of its features. Columns of those two names
    are replaced, others pass through.
    """
    kept = docs.drop("score", "predicted")
    schema = T.StructType([*kept.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(features(words)) for _, words in steps(batch.column(at), NOT_SPACE)]
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")

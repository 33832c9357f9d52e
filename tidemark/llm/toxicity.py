"""Toxicity classifier with a counterfactual penalty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.labelled import fold_of, training_rows
from tidemark.llm.words import ALNUM, Words, signed, steps, words_of

#: Identity terms; a term is swapped with the next of its row.
IDENTITY_TERMS = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "refugees", "citizens", "foreigners"],
    ["mexican", "chinese", "indian", "american", "german", "french"],
    ["old", "young"],
    ["disabled", "deaf", "blind"],
    ["frauen", "männer"],
    ["muslime", "christen", "juden"],
    ["femmes", "hommes"],
    ["musulmans", "chrétiens", "juifs"],
    ["mujeres", "hombres"],
    ["musulmanes", "cristianos", "judíos"],
]

#: Leading bytes of a word that are features besides the whole word.
PREFIXES = (4, 6)


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of every feature: words and their beginnings (with repetitions)."""
    docs, keys = [words.doc], [words.key]
    for n in PREFIXES:
        i, key = words.prefixes(n)
        docs.append(words.doc[i])
        keys.append(key)
    return np.concatenate(docs), np.concatenate(keys)


def _swaps() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sorted word keys of the identity terms; for each the features it has and those of the term it is swapped with."""
    table = []
    for terms in IDENTITY_TERMS:
        own = [words_of(t, ALNUM) for t in terms]
        for a, b in zip(own, own[1:] + own[:1]):
            table.append((a.key[0], _features(a)[1], _features(b)[1]))
    table.sort(key=lambda x: x[0])
    return np.array([x[0] for x in table], np.uint64), [(a, b) for _, a, b in table]


@dataclass
class ToxicModel:
    """keys: sorted feature keys; weights: theirs; bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    mask: np.ndarray | None = None

    def find(self, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's distinct known features: text and index."""
        if self.mask is None:
            self.mask = np.zeros(1 << 20, bool)
            self.mask[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
        hit = np.flatnonzero(self.mask[(key & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(hit) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
        ok = self.keys[at] == key[hit]
        pairs = np.unique(doc[hit][ok].astype(np.int64) * len(self.keys) + at[ok])
        return pairs // len(self.keys), pairs % len(self.keys)

    def score(self, words: Words) -> np.ndarray:
        doc, at = self.find(*_features(words))
        z = self.bias + np.bincount(doc, weights=self.weights[at], minlength=len(words))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_cols: int, pair_rows: np.ndarray, pair_cols: np.ndarray, pair_sign: np.ndarray, n_pairs: int, l2: float, fairness: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent, with the counterfactual penalty.

    Row i of the data has the features cols[rows == i]. Pair p is the
    difference between a text and its swapped form; the mean square of the
    score's change over the pairs, times `fairness`, is added to the loss.
    """
    n = max(1, len(y))
    # rare features are scaled up, as few texts move them
    size = np.append(np.minimum(10, 1 / np.sqrt((np.bincount(cols, minlength=n_cols) + 1) / (n + 1))), 1.0)
    size[pair_cols] = 1.0  # but for those that the penalty holds down

    def scores(u: np.ndarray) -> np.ndarray:
        u = size * u
        return np.bincount(rows, u[cols], n)[: len(y)] + u[-1]

    def back(e: np.ndarray) -> np.ndarray:
        return size * np.append(np.bincount(cols, e[rows], n_cols), e.sum())

    positive = y.mean() if len(y) else 0.5
    w = np.zeros(n_cols + 1)
    w[-1] = np.log((positive + 1e-3) / (1 - positive + 1e-3))
    v = w
    # a quarter of the largest curvature of the squares, by power iteration, bounds that of the loss
    probe, top = np.ones(n_cols + 1), 1.0
    for _ in range(20):
        probe = back(scores(probe)) / n
        top = np.linalg.norm(probe)
        probe /= top + 1e-12
    pair_size = np.bincount(pair_rows, size[pair_cols] ** 2).max() if len(pair_rows) else 0
    rate = 1 / (top / 4 + l2 + 2 * fairness * pair_size)
    for t in range(rounds):
        e = (1 / (1 + np.exp(-np.clip(scores(v), -30, 30))) - y) / n
        g = back(e)
        g[:-1] += l2 * v[:-1]
        if len(pair_rows):
            change = np.bincount(pair_rows, pair_sign * (size * v)[pair_cols], n_pairs)
            g[:-1] += size[:-1] * 2 * fairness / n_pairs * np.bincount(pair_cols, pair_sign * change[pair_rows], n_cols)
        w, old = v - rate * g, w
        v = w + t / (t + 3) * (w - old)
    w = size * w
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", max_rows: int = 20_000, min_z: float = 3.0, l2: float = 1e-4, fairness: float = 1.0) -> ToxicModel:
    """Fit on at most max_rows labelled rows outside the held-out fold.

    First Spark counts, for each feature, the texts of either label that have
    it; those whose shares differ most (by at least min_z standard errors) are
    kept, one for about five rows of max_rows, and identity terms too. Then only each text's kept features
    come to the driver, with those that swaps of its identity terms add or
    take away, and the weights are fitted there. Each labelled text that
    names a group is swapped twice: its terms for the next of their rows, so
    that no group counts for more than another, and for a word without
    features of its own, so that naming a group at all doesn't. Both sizes
    are bounded by max_rows.
    """
    max_features = 4096 * max_rows // 20_000
    rows = training_rows(docs, labels, "toxic", 5, 0, text, id, max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            for row, words in steps(batch.column(0), ALNUM):
                doc, key = _features(words)
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                doc, key = doc[new], key[new]
                keys, at = np.unique(key, return_inverse=True)
                label = y[row + doc]
                ones = np.bincount(at, label, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(ones), pa.array(np.bincount(at, minlength=len(keys)) - ones)], ["key", "ones", "zeros"])

    totals = rows.agg(F.sum("label").alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n0 = totals.n1 or 0, totals.n - (totals.n1 or 0)
    if not n1 or not n0:
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(0), 3.0 if n1 else -3.0)
    counts = rows.mapInArrow(count, "key long, ones long, zeros long").groupBy("key").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    p = (F.col("ones") + F.col("zeros") + 1) / (n1 + n0 + 2)
    z = (F.col("ones") / n1 - F.col("zeros") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    best = counts.withColumn("z", F.abs(z)).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "key").limit(max_features).select("key").collect()
    terms, swapped = _swaps()
    own = np.concatenate([np.array([r.key for r in best], np.int64).view(np.uint64), *(a for a, _ in swapped)])
    model = ToxicModel(np.unique(own), np.zeros(0), 0.0)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in steps(batch.column(0), ALNUM):
                known: list[list[int]] = [[] for _ in range(len(words))]
                doc, at = model.find(*_features(words))
                for d, a in zip(doc.tolist(), at.tolist()):
                    known[d].append(a)
                other: list[list[list[int]]] = [[] for _ in range(len(words))]
                i = np.minimum(np.searchsorted(terms, words.key), len(terms) - 1)
                hit = np.flatnonzero(terms[i] == words.key)
                for d in np.unique(words.doc[hit]).tolist():
                    mine = slice(words.first[d], words.first[d + 1])
                    isin = terms[i[mine]] == words.key[mine]
                    lost = [swapped[k] for k in np.unique(i[mine][isin])]
                    # features of the swapped text: those of all its other words, and of the terms put in
                    rest = Words.__new__(Words)
                    rest.__dict__ |= words.__dict__ | {n: getattr(words, n)[mine][~isin] for n in ("doc", "start", "end", "key")}
                    left = _features(rest)[1]
                    for keys in (np.concatenate([left, *(b for _, b in lost)]), left):
                        other[d].append(model.find(np.zeros(len(keys), np.int64), keys)[1].tolist())
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(known, ints), pa.array(other, pa.list_(ints)), batch.column(1).slice(row, len(words))], ["known", "other", "label"])

    got = rows.mapInArrow(collect, "known array<int>, other array<array<int>>, label int").toPandas()
    known = sorted(zip(got.known.map(tuple), got.other.map(lambda x: tuple(map(tuple, x))), got.label))  # as arrival varies
    y = np.array([k[2] for k in known], np.float64)
    at = np.repeat(np.arange(len(known)), [len(k[0]) for k in known])
    cols = np.array([c for k in known for c in k[0]], np.int64)
    swaps = [(set(k[0]), set(o)) for k in known for o in k[1]]
    pairs = [(i, c, s) for i, (a, b) in enumerate(swaps) for cs, s in ((a - b, 1.0), (b - a, -1.0)) for c in cs]
    pr, pc, ps = (np.array([x[j] for x in pairs], t) for j, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
    w, bias = fit(at, cols, y, len(model.keys), pr, pc, ps, len(swaps), l2, fairness)
    return ToxicModel(model.keys, w, bias)


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: more likely toxic) and predicted (1 from 0.5 on).

    Every row is scored from its whole text alone; a null text is empty, and
    an empty text gets the score of the bias. Columns of those two names are
    replaced, others pass through.
    """
    kept = docs.drop("score", "predicted")
    schema = T.StructType([*kept.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(words) for _, words in steps(batch.column(at), ALNUM)]
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")

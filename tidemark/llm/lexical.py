"""Ranked lexical search by dense blocked multiplication of item weights with document impacts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.words import ALNUM, Words, steps

#: Bytes of item texts that are taken at a time; more of them are searched in further passes over the documents.
TILE_BYTES = 1 << 23
#: Items of a weight tile, numbers of a dense document tile (32 MiB), and candidates that a task holds before it cuts them to the best.
ITEMS, CELLS, HELD = 64, 1 << 22, 1 << 17
#: What an impact stays below: (1000000000 * tf) div (1000 * tf + 8 * m) with m of 25 and more.
IMPACT = 1_000_000
#: Whole numbers below it are exact in float64, and so are their sums as long as these stay below it.
EXACT = 1 << 53


class Tile:
    """Weights of a few items over just the terms that these hold, in parts whose sums are exact.

    Each part is (terms, weights): the terms' places in the vocabulary and a
    matrix of terms by items. No sum of a part's products with impacts can
    reach 2^53; a term with too many repeats is in several parts.
    """

    def __init__(self, first: int, bags: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> None:
        self.first, self.n = first, len(bags)
        own = np.unique(np.concatenate([terms for terms, _ in bags]))
        left = np.zeros((len(own), len(bags)), np.int64)
        for i, (terms, repeats) in enumerate(bags):
            left[np.searchsorted(own, terms), i] = repeats
        most = (EXACT - 1) // IMPACT
        fits = np.maximum(1, most // np.maximum(1, weight[own]))  # repeats of a term that one part can take
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        while left.any():
            now = np.minimum(left, fits[:, None])
            rows = np.flatnonzero(now.any(1))
            self._add(own[rows], (now * weight[own][:, None])[rows], most)
            left -= now

    def _add(self, terms: np.ndarray, weights: np.ndarray, most: int) -> None:
        """A part, halved until the bound holds."""
        if len(terms) > 1 and int(weights.sum(0).max()) > most:
            half = len(terms) // 2
            self._add(terms[:half], weights[:half], most)
            self._add(terms[half:], weights[half:], most)
        else:
            self.parts.append((terms, weights.astype(np.float64)))


def _best(found: pa.Table, k: int) -> pa.Table:
    """The k best of each item: highest score first, then the smallest id."""
    found = found.take(pc.sort_indices(found, [("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"))
    item = found.column("item").to_numpy()
    first = np.searchsorted(item, item)
    return found.filter(pa.array(np.arange(len(item)) - first < k))


def _counts(words: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and number of occurrences, for the terms of the vocabulary that documents hold."""
    at = np.minimum(np.searchsorted(vocabulary, words.key), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == words.key)
    pair, tf = np.unique(words.doc[hit].astype(np.int64) * len(vocabulary) + at[hit], return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), tf


def _search(docs: DataFrame, texts: pa.Array, k: int) -> DataFrame | None:
    """item (its place in texts), id and score of each item's k best documents in every task; None where nothing has terms."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for _, words in steps(texts, ALNUM):
        bags += [np.unique(words.key[a:b], return_counts=True) for a, b in zip(words.first[:-1], words.first[1:])]
    vocabulary = np.unique(np.concatenate([b[0] for b in bags])) if bags else np.zeros(0, np.uint64)
    if not len(vocabulary):
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, terms, df = 0, 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, words in steps(batch.column(1), ALNUM):
                size = np.diff(words.first)
                n, terms = n + int((size > 0).sum()), terms + int(size.sum())
                df += np.bincount(_counts(words, vocabulary)[1], minlength=len(df))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], term])), pa.array(np.concatenate([[n, terms], df[term]]))], ["term", "n"])

    total = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the items
    df = np.zeros(len(vocabulary) + 2, np.int64)
    df[total.column("term").to_numpy() + 2] = total.column("n").to_numpy()
    n_docs, n_terms = int(df[0]), int(df[1])
    if not n_docs:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df[2:]], np.int64)
    full = [i for i, bag in enumerate(bags) if len(bag[0])]
    own = [(np.searchsorted(vocabulary, bags[i][0]), bags[i][1]) for i in full]
    tiles = [Tile(i, own[i : i + ITEMS], weight) for i in range(0, len(own), ITEMS)]
    number = np.array(full, np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Table] = []
        held, least = 0, np.ones(len(number), np.int64)  # an item's k-th best score so far, ties with which still count
        column = np.empty(len(vocabulary), np.int64)
        for batch in batches:
            for row, words in steps(batch.column(1), ALNUM):
                size = np.diff(words.first)
                longest = int(size.max(initial=0))
                if 75 * longest * n_docs < 2**63:
                    m = 25 + 75 * size.astype(np.int64) * n_docs // n_terms
                else:
                    m = np.array([25 + 75 * n * n_docs // n_terms for n in size.tolist()], np.int64)
                doc, term, tf = _counts(words, vocabulary)
                impact = (1_000_000_000 * tf // (1000 * tf + 8 * m[doc])).astype(np.float64)
                for tile in tiles:
                    width = max(len(terms) for terms, _ in tile.parts)
                    step = max(k, CELLS // max(width, tile.n))
                    for lo in range(0, len(size), step):
                        hi = min(len(size), lo + step)
                        part = slice(*np.searchsorted(doc, [lo, hi]))
                        scores = np.zeros((hi - lo, tile.n), np.int64)
                        for terms, weights in tile.parts:
                            column.fill(-1)
                            column[terms] = np.arange(len(terms))
                            at = column[term[part]]
                            hit = np.flatnonzero(at >= 0)
                            dense = np.zeros((hi - lo, len(terms)))
                            dense[doc[part][hit] - lo, at[hit]] = impact[part][hit]
                            scores += (dense @ weights).astype(np.int64)
                        own = slice(tile.first, tile.first + tile.n)
                        if hi - lo >= k:
                            least[own] = np.maximum(least[own], np.partition(scores, hi - lo - k, axis=0)[hi - lo - k])
                        d, i = np.nonzero(scores >= least[own])
                        if len(d):
                            found.append(pa.table({"item": number[tile.first + i], "id": batch.column(0).take(pa.array(row + lo + d)), "score": scores[d, i]}))
                            held += len(d)
                        if held > HELD:
                            best = _best(pa.concat_tables(found), k)
                            found, held = [best], 0
                            item, value = best.column("item").to_numpy(), best.column("score").to_numpy()
                            last = np.flatnonzero(np.bincount(item, minlength=number[-1] + 1)[number] >= k)
                            ends = np.searchsorted(item, number[last], "right") - 1
                            least[last] = np.maximum(least[last], value[ends])
        if found:
            yield from _best(pa.concat_tables(found), k).combine_chunks().to_batches()

    return docs.mapInArrow(score, f"item long, id {kind}, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Each item's k highest-scoring documents: item id, rank (from 1), document id and score; equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of non-ASCII characters of
    the whole text, A-Z lower-cased; they are told apart by 64-bit hashes. A
    term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's
    impact for it (10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L,
    where N documents with terms have L terms, n are this one's. The score is
    the sum over the item's terms, repeats included, of weight times impact,
    exact in whole numbers: dense tiles of documents by terms are multiplied
    by tiles of terms by items in float64, in parts whose sums stay below
    2^53, and parts are added as 64-bit integers.

    Null and empty texts have no terms, count nowhere and are never found; an
    item without terms, or none of whose terms is anywhere, has no rows. Rows
    that share an item id are items of their own; rows that share a document
    id are documents of their own. A null document id comes after all others
    of its score. Extra columns are ignored; with an empty table on either
    side the result is empty.

    The items are the query set: TILE_BYTES of their texts are searched at a
    time, in two passes over the documents (counts, then scores), so what is
    sent to tasks is bounded however many items there are. A task keeps k
    documents for each item, with all ties until the cut; only these are
    shuffled. The last ranking goes in two steps, so no window holds more
    than a share of the tasks' rows.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tiles = -(-size // TILE_BYTES)
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], f"tile int, item long, item_id {items.schema[item_id].dataType.simpleString()}, id {docs.schema[id].dataType.simpleString()}, score long")
    for t in range(tiles):
        tile = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(tiles)) == t).toArrow() if tiles > 1 else wanted.toArrow()
        found = _search(texts, tile.column("text"), k)
        if found is not None:
            names = spark.createDataFrame(pa.table({"item": pa.array(range(len(tile)), pa.int64()), "item_id": tile.column("item_id")}))
            out = out.union(found.join(F.broadcast(names), "item").select(F.lit(t), "item", "item_id", "id", "score"))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    some = Window.partitionBy("tile", "item", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(*order)
    every = Window.partitionBy("tile", "item").orderBy(*order)
    best = out.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= k).withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= k)
    return best.select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(id), "score")


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lexical_search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
     n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
     total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
     tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
     df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
     q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
     s AS (SELECT q.item_id, tf.doc_id, CAST(sum(q.repeats * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
                  * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM q JOIN df USING (term) JOIN tf USING (term) JOIN n USING (doc_id), total GROUP BY q.item_id, tf.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""

"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.packing import ragged
from tidemark.llm.words import ALNUM, Words, mix, steps

#: Bits of the mask of seed hashes that texts are held against first, and bytes of item texts that are sent to tasks at a time.
MASK_BITS, TILE_BYTES = 1 << 20, 1 << 21

#: What equal and unequal words and gaps add to an alignment's score.
MATCH, MISMATCH, GAP = 2, -1, -1

#: An alignment's share of the item's own score from which it is a leak.
LEAST_SCORE = 0.45


def align(items: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of each item against its window, and where the best alignment ends.

    items (C x L) and windows (C x W) hold word hashes; sizes are the items'
    lengths, beyond which nothing matches. One row of the items is aligned at
    a time for all pairs, gaps along the window by a running maximum.
    """
    n, width = windows.shape
    before = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    ramp = (np.arange(width + 1) * -GAP).astype(np.int32)
    for i in range(items.shape[1]):
        live = (i < sizes)[:, None]
        now = np.zeros_like(before)
        now[:, 1:] = before[:, :-1] + np.where((windows == items[:, i : i + 1]) & live, MATCH, MISMATCH)
        np.maximum(now, before + GAP, out=now)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        at = now.argmax(1)
        top = now[np.arange(n), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
        before = now
    return best, end


class Items:
    """Benchmark items and their seeds, in arrays that tasks can hold: n-grams in order of their hashes, for each the items and places that have it."""

    def __init__(self, texts: pa.Array, n: int) -> None:
        self.n = n
        words, seeds, docs, places = [], [], [], []
        for row, w in steps(texts, ALNUM):
            words += [w.key[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
            doc, pos, key = w.grams(n, short=True)
            docs.append(doc + row), places.append(pos), seeds.append(key)
        none = np.zeros(0, np.int64)
        key = np.concatenate([none.astype(np.uint64), *seeds])
        order = np.argsort(key, kind="stable")
        self.item, self.place = np.concatenate([none, *docs])[order], np.concatenate([none, *places])[order]
        self.seed, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.word = np.concatenate([none.astype(np.uint64), *words])
        #: Lengths of seeds: n, and those of shorter items.
        self.lengths = [n, *np.unique(self.size[(self.size > 0) & (self.size < n)]).tolist()]
        self.mask = np.zeros(MASK_BITS, bool)
        self.mask[(self.seed & np.uint64(MASK_BITS - 1)).astype(np.int64)] = True
        self.rare = np.ones(len(self.item), bool)

    def rank(self, df: np.ndarray) -> None:
        """Which seeds of an item are rare: of those that occur at all, the half that is in the fewest documents, if others are in more."""
        each = np.repeat(df, self.count)
        order = np.lexsort((each, self.item))
        order = order[each[order] > 0]
        own = self.item[order]
        first, last = np.searchsorted(own, own), np.searchsorted(own, own, "right")
        half = first + (last - first - 1) // 2
        self.rare = np.zeros(len(self.item), bool)
        self.rare[order] = (each[order] <= each[order][half]) & (each[order] < each[order][last - 1])

    def hits(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """doc, place and number of each seed that the texts hold."""
        for k in self.lengths:
            for doc, pos, key in words.gram_runs(k):
                own = np.flatnonzero(self.mask[(key & np.uint64(MASK_BITS - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.seed, key[own]), len(self.seed) - 1)
                own, at = own[self.seed[at] == key[own]], at[self.seed[at] == key[own]]
                yield doc[own], pos[own], at


def _windows(items: Items, words: Words, least_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, item, first and last word of the passages around seeds that may be leaks.

    Seeds near one diagonal open a window around the passage (short items:
    around the first match). One that a rare seed opens is aligned as it is.
    One with common seeds only must first hold so many of the item's words
    that the alignment can reach least_score (it gets no more than MATCH for
    each), which no leak fails.
    """
    doc, pos, at = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *items.hits(words)))
    size = items.count[at]
    entry = ragged(items.first[at], size)
    doc, pos, item = np.repeat(doc, size), np.repeat(pos, size), items.item[entry]
    diagonal, length = pos - items.place[entry], items.size[item]
    short = length < items.n  # each match is the whole item, so the first is as good as any
    part = np.where(short, 0, diagonal // np.maximum(length, 1))
    order = np.lexsort((diagonal, part, item, doc))
    doc, item, part, diagonal, rare, short = (x[order] for x in (doc, item, part, diagonal, items.rare[entry], short))
    if not len(doc):
        return doc, item, part, diagonal
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (part[1:] != part[:-1])])
    last = np.r_[first[1:], len(doc)] - 1
    opened = np.logical_or.reduceat(rare, first)
    doc, item = doc[first], item[first]
    length = items.size[item]
    slack = length // 4 + 2
    lo = np.maximum(diagonal[first] - slack, 0)
    hi = np.minimum(np.where(short[first], diagonal[first], diagonal[last]) + length + slack, np.diff(words.first)[doc])
    doubt = np.flatnonzero(~opened)
    for i in range(0, len(doubt), 4096):  # a bounded number of windows at a time
        own = doubt[i : i + 4096]
        number = np.arange(len(own), dtype=np.uint64) << np.uint64(40)
        seen = mix(words.key[ragged(words.first[doc[own]] + lo[own], hi[own] - lo[own])]) ^ np.repeat(number, hi[own] - lo[own])
        asked = mix(items.word[ragged(items.start[item[own]], length[own])]) ^ np.repeat(number, length[own])
        held = np.add.reduceat(np.isin(asked, seen), np.cumsum(length[own]) - length[own])
        opened[own] = held >= least_score * length[own]
    return doc[opened], item[opened], lo[opened], hi[opened]


def _score(items: Items, words: Words, least_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, item, score, first word of the window and last word of the alignment, for every window."""
    doc, item, lo, hi = _windows(items, words, least_score)
    wide, long = hi - lo, items.size[item]
    score, end = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
    order = np.lexsort((long, wide))
    at = 0
    while at < len(order):  # pairs of about one size, as many as fit in a bounded table
        to = at + 1
        while to < len(order) and (to - at + 1) * wide[order[to]] <= 200_000:
            to += 1
        part = order[at:to]
        at = to
        a, b = np.zeros((len(part), long[part].max()), np.uint64), np.ones((len(part), wide[part].max()), np.uint64)
        for k, p in enumerate(part.tolist()):
            a[k, : long[p]] = items.word[items.start[item[p]] : items.start[item[p]] + long[p]]
            b[k, : wide[p]] = words.key[words.first[doc[p]] + lo[p] : words.first[doc[p]] + hi[p]]
        best, end[part] = align(a, long[part], b)
        score[part] = best / (MATCH * long[part])
    return doc, item, score, lo, lo + end


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    n: int = 3,
    least_score: float = LEAST_SCORE,
) -> DataFrame:
    """Passages of docs that are test items, copied, edited or paraphrased: id, item id, score, start_word (of the window) and end_word.

    Seeds are the word n-grams of the items (words as in license scans; an
    item of fewer words is one seed, found wherever a text has just these
    words in a row). Documents are counted for each; of an item's seeds that
    occur, the rarer half open windows, and the others open one where enough
    of the item's words stand around them: which seeds an edited copy still
    has can't be known beforehand, so none is left out. A passage without n
    unchanged words in a row has no seed and isn't found. Seeds near one
    diagonal make a window around the passage (short items: around the
    first), which Smith-Waterman aligns with the whole item by words. The
    score is the alignment's over that of the item with itself; least_score
    and more is a leak, and of a document's windows on an item the best counts.

    Null and empty texts and items have no words and leak nothing. Rows that
    share an id are one document; with a null id, rows are documents of their
    own, equal texts one. Repeated items have results of their own ids. Extra
    columns are ignored; with an empty table on either side the result is empty.

    The items are the query set: TILE_BYTES of their texts are sent to all
    tasks at a time, so seeds meet texts where these lie. A phrase that most
    documents and items share therefore moves no rows, and costs a task its
    own documents' windows only. Documents are read twice for each tile, and
    what is shuffled are counts of seeds and leaks.
    """
    found = leaks_by_row(docs, benchmark, text, id, item_text, item_id, n, least_score)
    return found.select(F.col("id").alias(id), F.col("item").alias(item_id), "score", "start_word", "end_word")


def row_key(id: Column, text: Column) -> Column:
    """What tells rows with a null id apart: their text's hash. Null where there is an id."""
    return F.when(id.isNull(), F.md5(text))


def leaks_by_row(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", n: int = 3, least_score: float = LEAST_SCORE) -> DataFrame:
    """The leaks with row_key: id, key, item, score, start_word and end_word."""
    spark, kind, item_kind = docs.sparkSession, docs.schema[id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    texts = docs.select(F.col(id).alias("id"), row_key(F.col(id), F.col(text)).alias("key"), F.col(text).alias("text"))
    wanted = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tiles = -(-size // TILE_BYTES)
    found = spark.createDataFrame([], f"id {kind}, key string, item {item_kind}, score double, start_word long, end_word long")
    for t in range(tiles):
        tile = (wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(tiles)) == t) if tiles > 1 else wanted).toArrow().combine_chunks()
        found = found.union(_leaks(texts, Items(tile.column("text"), n), tile.column("item"), kind, item_kind, least_score))
    best = found.groupBy("id", "key", "item").agg(F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", F.negative("start_word"))).alias("b"))
    return best.select("id", "key", "item", "b.score", "b.start_word", "b.end_word")


def _leaks(texts: DataFrame, items: Items, ids: pa.ChunkedArray, kind: str, item_kind: str, least_score: float) -> DataFrame:
    """Leaks of the items of a tile, one row for each window that is one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(items.seed), np.int64)
        for batch in batches:
            for _, words in steps(batch.column(0), ALNUM):
                held = [np.unique(doc.astype(np.int64) * len(df) + at) for doc, _, at in items.hits(words)]
                df += np.bincount(np.unique(np.concatenate([np.zeros(0, np.int64), *held])) % max(1, len(df)), minlength=len(df))
        seed = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(df[seed])], ["seed", "n"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in steps(batch.column(2), ALNUM):
                doc, item, score, lo, end = _score(items, words, least_score)
                yes = np.flatnonzero(score >= least_score)
                if len(yes):
                    own = (batch.column(c).take(pa.array(row + doc[yes])) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([*own, names.take(pa.array(item[yes])), pa.array(score[yes]), pa.array(lo[yes]), pa.array(end[yes])], ["id", "key", "item", "score", "start_word", "end_word"])

    if len(items.seed):
        got = texts.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()  # a row for each seed
        df = np.zeros(len(items.seed), np.int64)
        df[got.column("seed").to_numpy()] = got.column("n").to_numpy()
        items.rank(df)
    names = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
    return texts.mapInArrow(match, f"id {kind}, key string, item {item_kind}, score double, start_word long, end_word long")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))

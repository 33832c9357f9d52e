"""Packing documents into token sequences along a Hilbert curve."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import ALNUM, NOT_SPACE, Words, kept, mix, steps

#: Dimensions of the projection and bits of each on the curve.
DIMENSIONS, BITS = 4, 12


def project(words: Words) -> np.ndarray:
    """Each text's bag of hashed words, projected to a few dimensions by the signs of hash bits, in [0, 1)."""
    n = np.maximum(1, np.diff(words.first))
    out = np.empty((len(words), DIMENSIONS))
    for d in range(DIMENSIONS):
        bit = ((words.key >> np.uint64(13 * d + 7)) & np.uint64(1)).astype(np.float64)
        out[:, d] = np.bincount(words.doc, 2 * bit - 1, len(words)) / n
    return np.clip(0.5 + np.arctan(6 * out) / np.pi, 0, 1 - 1e-9)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of points of the unit cube on the Hilbert curve of that many bits a dimension."""
    x = [(points[:, d] * (1 << bits)).astype(np.int64) for d in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the coarsest
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code over the dimensions
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ flip) >> b) & 1)
    return key


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then those from start[1], and so on."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class Encoder:
    """Token ids by tokenizers, with a bounded cache of words.

    In a text whose words are parted by single spaces and line ends, the
    byte-level vocabulary's splits never cross a word with what parts it from
    the word before, so each such unit is encoded once and looked up by its
    64-bit hash; any other text, and one that holds an added token, goes
    whole through the tokenizer.
    """

    OTHER_SPACE = re.compile(r"[^\S \n]|[ \n][ \n]|\A[ \n]|[ \n]\Z")
    #: Bytes that white space other than a blank or a line end has in UTF-8.
    SUSPECT = np.isin(np.arange(256), [0x09, *range(0x0B, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3])
    #: Words kept, words of a text that are looked up at a time, and texts that the tokenizer takes at a time.
    MOST, BLOCK, BATCH = 400_000, 400_000, 10_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.units: dict[int, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, texts: list[str]) -> list[bytes]:
        parts = (texts[i : i + self.BATCH] for i in range(0, len(texts), self.BATCH))
        return [array("I", e.ids).tobytes() for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _lookup(self, words: Words, own: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The ids of distinct units among the words `own`, and for each word which of them it is."""
        at = words.start[own]
        before = np.where(own == words.first[words.doc[own]], np.uint8(0), words.raw[at - 1])
        keys, first, which = np.unique(mix(words.key[own] ^ before.astype(np.uint64)), return_index=True, return_inverse=True)
        keys = keys.tolist()
        found = list(map(self.units.get, keys))
        new = [i for i, ids in enumerate(found) if ids is None]
        if len(self.units) + len(new) > self.MOST:
            self.units.clear()
        start, end = (at - (before != 0))[first[new]].tolist(), words.end[own[first[new]]].tolist()
        for i, ids in zip(new, self._ids([words.raw[a:b].tobytes().decode() for a, b in zip(start, end)])):
            found[i] = self.units[keys[i]] = ids
        return found, which

    def _odd(self, texts: list[str], words: Words) -> np.ndarray:
        """Which texts can't be taken word by word; only those with a suspicious byte are looked at as text."""
        part = (words.raw == 0x20) | (words.raw == 0x0A)
        suspect = self.SUSPECT[words.raw]
        suspect[1:] |= part[1:] & part[:-1]
        full = words.offsets[:-1] < words.offsets[1:]
        for end in (words.offsets[:-1][full], words.offsets[1:][full] - 1):
            suspect[end] |= part[end]
        odd = np.diff(np.searchsorted(np.flatnonzero(suspect), words.offsets)) > 0
        for i in np.flatnonzero(odd).tolist():
            odd[i] = self.OTHER_SPACE.search(texts[i]) is not None
        return odd | np.array([any(a in t for a in self.added) for t in texts], bool)

    def encode(self, texts: list[str], words: Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end_id after each text, and how many are each text's; words are those of the texts, case kept."""
        odd = self._odd(texts, words)
        # segments of a pool of ids: the words of a text, block by block, or the whole text, then the end
        pools, docs, sizes = [], [], []
        for lo in range(0, len(words.key), self.BLOCK):
            own = lo + np.flatnonzero(~odd[words.doc[lo : lo + self.BLOCK]])
            if not len(own):
                continue
            found, which = self._lookup(words, own)
            pool = np.frombuffer(b"".join(found), "<u4")
            size = np.array(list(map(len, found))) // 4
            pools.append(pool[ragged((np.cumsum(size) - size)[which], size[which])])
            doc = words.doc[own]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            docs.append(doc[first])
            sizes.append(np.add.reduceat(size[which], first))
        whole = self._ids([texts[i] for i in np.flatnonzero(odd)])
        pools += [np.frombuffer(b"".join(whole), "<u4"), np.array([end_id], "<u4")]
        docs += [np.flatnonzero(odd), np.arange(len(texts))]
        sizes += [np.array([len(w) // 4 for w in whole], np.int64), np.ones(len(texts), np.int64)]
        pool, doc, size = (np.concatenate(x) for x in (pools, docs, sizes))
        start = np.cumsum(size) - size
        start[len(start) - len(texts) :] = len(pool) - 1
        order = np.argsort(doc, kind="stable")
        ids = np.concatenate([pool[a:b] for a, b in zip(start[order].tolist(), (start + size)[order].tolist())])
        return ids, np.bincount(doc, size, len(texts)).astype(np.int64)


def _encoder(path: str) -> Encoder:
    """One encoder for each worker process and path."""
    if ("encoder", path) not in kept():
        kept()["encoder", path] = Encoder(path)
    return kept()["encoder", path]


def pack_documents(df: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pack documents into sequences of at most `length` tokens; neighbours in content share sequences.

    Returns one row for each piece: the id, start (the document's ids before
    it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id
    and offset in the sequence. A document is its tokens and end_id.

    Documents are range-sorted by the Hilbert key of their projected word
    vectors (then id and text); each range is filled along the curve, cutting
    documents at full sequences. What remains at the end of a range is laid
    into sequences of powers of two, so no sequence needs padding when those
    stay as they are. A sequence lies in one range.

    A null or empty text is end_id alone; repeated rows are packed each for
    itself; a null id is kept. Extra columns are ignored; an empty table gives
    no rows. Ties on the key are split by id, so no key is too large for a
    range. A task holds one batch of texts and one open sequence; the time and
    memory of a long text grow in proportion to it.
    """
    kind = df.schema[id].dataType
    docs = df.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hilbert(project(words)) for _, words in steps(batch.column(1), ALNUM)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["id", "text", "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 32
        # the open sequence: for each document in it the id, its ids before, its ids in all and those here
        names, before, total, here, flat = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

        def pieces(ends: np.ndarray) -> pa.RecordBatch:
            """The documents cut where sequences end, at `ends`, and where documents do, up to the last of `ends`."""
            starts = np.cumsum(here) - here
            cuts = np.union1d(starts[starts < ends[-1]], np.append(0, ends))
            at, size = cuts[:-1], np.diff(cuts)
            doc = np.searchsorted(starts, at, "right") - 1
            k = np.searchsorted(ends, at, "right")
            ids = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((4 * cuts).astype("<i4")), pa.py_buffer(np.ascontiguousarray(flat[: ends[-1]]))])
            columns = [names.take(pa.array(doc)), before[doc] + at - starts[doc], size, ids, total[doc], sequence + k, at - np.append(0, ends)[k]]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for row, words in steps(batch.column(1), NOT_SPACE, fold=False):
                ids, sizes = encoder.encode(batch.column(1).slice(row, len(words)).to_pylist(), words, end_id)
                own = batch.column(0).slice(row, len(words))
                names = own if names is None else pa.concat_arrays([names, own])
                before, total, here = np.append(before, np.zeros(len(own), np.int64)), np.append(total, sizes), np.append(here, sizes)
                flat = np.concatenate([flat, ids])
                full = len(flat) // length
                if full:
                    yield pieces(np.arange(1, full + 1) * length)
                    sequence += full
                    starts, used = np.cumsum(here) - here, full * length
                    left = np.flatnonzero(starts + here > used)
                    gone = np.maximum(0, used - starts[left])
                    names, before, total, here, flat = names.take(pa.array(left)), before[left] + gone, total[left], here[left] - gone, flat[used:].copy()
        if len(flat):
            yield pieces(np.cumsum([1 << b for b in range(len(flat).bit_length() - 1, -1, -1) if len(flat) >> b & 1]))

    ordered = docs.mapInArrow(keys, f"id {kind.simpleString()}, text string, key long").repartitionByRange("key", "id").sortWithinPartitions("key", "id", "text").select("id", "text")
    schema = f"id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return ordered.mapInArrow(pack, schema).withColumnRenamed("id", id)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

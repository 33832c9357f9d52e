"""Alignment of two tokenizers' tokens by the byte offsets at which both end."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.packing import ragged
from tidemark.llm.words import kept
from tidemark.plans.lineage import cut

#: Bytes of text whose units and pairs of ids are told apart together (a longer text is a chunk of its own),
#: texts that are encoded at a time, and units that are encoded as one string.
CHUNK_BYTES, RUN_BYTES, JOINED = 1 << 24, 1 << 20, 256

#: Where a text may be cut into units: a blank between two characters that are not white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than blanks and line ends, and pairs of those, beside which a blank may not part units.
OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["  ", " \n", "\n "]

#: Bits of a B id in the number of a pair of ids.
B_BITS = 24


def group_tokens(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end in either list of tokens, from the cumulative byte offsets at which the tokens end.

    Each side's dictionary leads from an end to the token that ends there; the
    common keys, sorted, slice both lists.
    """
    of_a, of_b = dict(zip(a_ends, range(1, len(a_ends) + 1))), dict(zip(b_ends, range(1, len(b_ends) + 1)))
    common = sorted(of_a.keys() & of_b.keys())
    return tuple(np.fromiter(map(of.get, common), np.int64, len(common)) for of in (of_a, of_b))


def link_tokens(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of tokens in either list, one pair for each two whose bytes overlap, and the offset at which the overlap ends.

    Within every slice the ends of both sides cut the bytes in stretches, and
    a stretch lies in one token of either side; no two stretches in the same two.
    """
    cuts = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    cuts = cuts[np.diff(cuts, append=-1) != 0]
    return np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts), cuts


class Units:
    """Distinct units, one after another: numbers of A tokens, B tokens, groups and links of each (A: -1 where tokens don't spell the bytes), the groups as text, the pairs of ids."""

    def __init__(self, sizes: np.ndarray, said: list[str], pairs: np.ndarray) -> None:
        self.sizes, self.said, self.pairs = sizes, said, pairs


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # a byte-level vocabulary writes printable bytes as themselves, the others as characters from U+0100 on, in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(c): c for c in plain} | {chr(0x100 + i): c for i, c in enumerate(sorted(set(range(256)) - set(plain)))}
        spelled = {i: bytes(map(byte.get, t)) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.number = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]

    def _a_ids(self, parts: list[str], size: np.ndarray) -> np.ndarray:
        """A's ids of blank + part, part by part. Parts that white space doesn't edge are encoded as one string, JOINED at a time, as A parts words there."""
        if any(p[:1].isspace() or p[-1:].isspace() or not p for p in parts):
            texts = [" " + p for p in parts]
        else:
            texts = [" " + " ".join(parts[i : i + JOINED]) for i in range(0, len(parts), JOINED)]
        return np.array([i for e in self.a.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int64)

    def encode(self, parts: list[str]) -> Units:
        """Tokens, groups and links of parts, each with a blank before it."""
        if not parts:
            return Units(np.zeros((0, 4), np.int64), [], np.zeros(0, np.int64))
        edged = [i for i, p in enumerate(parts) if p[:1].isspace() or p[-1:].isspace() or not p]
        if edged and len(edged) < len(parts):  # by themselves, behind the others
            order = [i for i in range(len(parts)) if i not in set(edged)] + edged
            plain, odd = self.encode([parts[i] for i in order[: len(parts) - len(edged)]]), self.encode([parts[i] for i in edged])
            place = np.argsort(order)
            links = np.concatenate([plain.sizes, odd.sizes])[:, 3]
            pairs = np.concatenate([plain.pairs, odd.pairs])[ragged((np.cumsum(links) - links)[place], links[place])]
            said = plain.said + odd.said
            return Units(np.concatenate([plain.sizes, odd.sizes])[place], [said[i] for i in place.tolist()], pairs)
        texts = [(" " + p).encode() for p in parts]
        size = np.array([len(t) for t in texts], np.int64)
        a = self._a_ids(parts, size)
        b_ids = self.b.encode(parts, num_threads=1)
        b = np.array([i for ids in b_ids for i in ids], np.int64)
        ends = np.cumsum(size)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        sound = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == b"".join(map(self.b_bytes.__getitem__, b.tolist())) == b"".join(texts)
        reach = [np.searchsorted(x, ends, "right") for x in (a_ends, b_ends)]
        if not sound or (a_ends[reach[0] - 1] != ends).any() or (b_ends[reach[1] - 1] != ends).any():
            if len(parts) == 1:
                return Units(np.array([[-1, 0, 0, 0]]), [""], np.zeros(0, np.int64))
            half = len(parts) // 2  # the parts that don't spell their bytes are found by halving
            one, other = self.encode(parts[:half]), self.encode(parts[half:])
            return Units(np.concatenate([one.sizes, other.sizes]), one.said + other.said, np.concatenate([one.pairs, other.pairs]))
        to_a, to_b = group_tokens(a_ends.tolist(), b_ends.tolist())
        at_a, at_b, cuts = link_tokens(a_ends, b_ends)
        pairs = (a[at_a] << B_BITS) | b[at_b]
        last = [*reach, *(np.searchsorted(x, ends, "right") for x in (a_ends[to_a - 1], cuts))]
        sizes = np.stack([np.diff(x, prepend=0) for x in last], 1)
        # ids and what follows each, in the order of the text: A's of a group, a bar, B's, and the end of a group or unit
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        place_a = np.arange(len(a)) + np.repeat(to_b - n_b, n_a)
        place_b = np.arange(len(b)) + np.repeat(to_a, n_b)
        ids, marks = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        marks[place_a[to_a - 1]], marks[place_b[to_b - 1]] = 1, 2
        marks[place_b[last[1] - 1]] = 3
        pieces = [""] * (2 * len(ids))
        pieces[::2], pieces[1::2] = map(self.number.__getitem__, ids.tolist()), map(",|;\n".__getitem__, marks.tolist())
        return Units(sizes, "".join(pieces).split("\n")[:-1], pairs)


def pair_of(a_path: str, b_path: str) -> Pair:
    """The tokenizers, loaded once in a process."""
    if (a_path, b_path) not in kept():
        kept()[a_path, b_path] = Pair(a_path, b_path)
    return kept()[a_path, b_path]


def units_of(text: str) -> list[str]:
    """Parts of space + text, each without the blank that it starts with.

    At a blank between two characters that are not white space both
    vocabularies always part tokens (A's splits begin a word there, and no
    piece of B has a blank behind another character), so parts are encoded by
    themselves.
    """
    odd = text[0] == " " or text[-1] == " " or any(x in text for x in OTHER)
    return CUT.split(text) if odd else text.split(" ")


class Chunk:
    """The distinct units of a run of texts."""

    def __init__(self, pair: Pair, number: int) -> None:
        self.pair, self.number, self.bytes = pair, number, 0
        self.place: dict[str, int] = {}
        self.sizes = np.zeros((0, 4), np.int64)
        self.said: list[str] = []
        self.pairs: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.times = np.zeros(0, np.int64)

    def take(self, texts: list[str | None]) -> list[tuple]:
        """For each text: numbers of A tokens, B tokens, groups and links, the groups' digest, and its units."""
        parts = [units_of(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(parts)).difference(self.place))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        units = self.pair.encode(new)
        self.sizes = np.concatenate([self.sizes, units.sizes])
        self.said += units.said
        self.pairs.append(units.pairs)
        self.times = np.concatenate([self.times, np.zeros(len(new), np.int64)])
        out, seen = [], []
        for own, text in zip(parts, texts):
            places = list(map(self.place.__getitem__, own))
            at = np.array(places, np.int32)
            if not len(at) or self.sizes[at, 0].min() < 0:
                out.append((0, 0, 0, 0, "", b""))
                continue
            self.bytes += len(text)
            seen.append(at)
            digest = hashlib.sha256(";".join(map(self.said.__getitem__, places)).encode()).hexdigest()
            out.append((*self.sizes[at].sum(0).tolist(), digest, at.tobytes()))
        self.times += np.bincount(np.concatenate([np.zeros(0, np.int32), *seen]), minlength=len(self.times))
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of ids, how often each is linked, and, unit by unit, how many links it has and which pairs they are."""
        size = self.sizes[:, 3]
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        times = np.bincount(at, np.repeat(self.times, size), len(pairs)).astype(np.int64)
        return pairs, times, size.astype(np.int32), at.astype(np.int32)


_CODED = [
    ("chunk", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("units", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("sizes", pa.binary()),
]


def align_tokenizers(df: DataFrame, a_path: str, b_path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """How the tokens of two vocabularies fall on each text: one row for each row of df.

    A is a byte-level vocabulary that is given space + text, B a piece
    vocabulary that puts the blank before the text itself; strings of special
    tokens are plain text. Where tokens of both end at the same byte, groups
    end; tokens whose bytes overlap are linked. Columns: id, n_a, n_b,
    n_groups, n_links, n_best (links whose pair of ids is linked as often, over
    all rows, as any pair with that B id), count_sum (those counts, over the
    links), groups_sha256 (of `a1,a2|b1;a3|b2,b3`).

    A null or empty text, and one whose A or B tokens don't spell space +
    text, has zeros and an empty groups_sha256, and its links count nowhere.
    Ids may be null or repeated: rows stay apart, and repeated rows count each
    by itself. Extra columns are ignored; an empty table gives an empty result.

    Texts are encoded once, by units that both vocabularies keep apart, each
    distinct unit once a chunk of CHUNK_BYTES (more or less, by characters). What goes on is, for each text,
    its units' numbers, and for each chunk its distinct pairs of ids with
    their counts. Only the latter are counted and joined, so the shuffle of
    pairs grows with the chunks' vocabularies and not with links, and a pair
    that is in every text is one row a chunk. Counts meet their chunks again
    in a cogroup, which holds one chunk (or one longer text) at a time.
    """
    kind = df.schema[id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, base, number = pair_of(a_path, b_path), TaskContext.get().partitionId() << 32, 0
        chunk, like = Chunk(pair, base), None

        def end() -> pa.RecordBatch:
            pairs, times, sizes, at = chunk.links()
            cells = [like] + [[x] for x in (chunk.number, None, None, None, None, None, at.tobytes(), pairs, times, sizes.tobytes())]
            return pa.RecordBatch.from_arrays([cells[0], *(pa.array(c, t) for c, (_, t) in zip(cells[1:], _CODED))], ["id", *(n for n, _ in _CODED)])

        for batch in batches:
            texts = batch.column(1)
            like = pa.nulls(1, batch.column(0).type)
            size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            row = 0
            while row < len(texts):
                to = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + RUN_BYTES, "right")))
                rows = chunk.take(texts.slice(row, to - row).to_pylist())
                cols = [[chunk.number] * len(rows), *zip(*rows), *([None] * len(rows) for _ in range(3))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), *(pa.array(c, t) for c, (_, t) in zip(cols, _CODED))], ["id", *(n for n, _ in _CODED)])
                row = to
                if chunk.bytes >= CHUNK_BYTES:
                    yield end()
                    number += 1
                    chunk = Chunk(pair, base + number)
        if len(chunk.place):
            yield end()

    coded = cut(df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        encode, f"id {kind}, chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, pairs array<long>, times array<long>, sizes binary"))
    here = coded.filter("pairs is not null").select(F.col("chunk").alias("own"), F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "x")).select("own", "at", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = here.groupBy("pair").agg(F.sum("times").alias("n"))  # at most the product of the vocabularies
    same_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << B_BITS) - 1))
    counts = cut(counts.withColumn("best", F.col("n") == F.max("n").over(same_b)))
    back = here.join(counts, "pair").select("own", "at", "n", "best")

    def finish(own: pa.Table, links: pa.Table) -> pa.Table:
        last = own.filter(pc.is_valid(own.column("pairs")))
        texts = own.filter(pc.is_null(own.column("pairs")))
        n_best = count_sum = np.zeros(len(texts), np.int64)
        if len(links):
            order = links.column("at").to_numpy()
            n, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            n[order], best[order] = links.column("n").to_numpy(), links.column("best").to_numpy()
            at, size = np.frombuffer(last.column("units")[0].as_py(), np.int32), np.frombuffer(last.column("sizes")[0].as_py(), np.int32)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[np.concatenate([[0], np.cumsum(size)])]) for x in (best, n)]
            units = [np.frombuffer(u, np.int32) for u in texts.column("units").to_pylist()]
            n_best, count_sum = (np.array([x[u].sum() for u in units], np.int64) for x in sums)
        return pa.table([texts.column("id"), *(texts.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum), texts.column("groups_sha256")], names)

    names = [id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return coded.groupBy("chunk").cogroup(back.groupBy("own")).applyInArrow(finish, f"`{id}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

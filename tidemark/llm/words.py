"""Vectorised words, word hashes and word n-grams of Arrow text columns.

Everything works on whole texts, about a megabyte at a time: hashes of words
come from one prefix sum over the bytes of a window, and a word that goes
beyond a window is carried on. A text needs about 10 bytes of memory for each
of its bytes; what is done with its n-grams comes on top of that.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of the vectorised code takes (a longer text is a step of its own).
STEP_BYTES = 1 << 20

_RNG = np.random.default_rng(20240117)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes: everything but ASCII white space; or digits, a-z and all bytes of non-ASCII characters.
NOT_SPACE = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_P), -1, 2**64))


def kept() -> dict:
    """What a process keeps between tasks; it isn't sent with functions, as this module's globals are."""
    return vars(sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept")))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, for a window."""
    if len(kept().get("powers", ((),))[0]) <= STEP_BYTES:
        with np.errstate(over="ignore"):
            kept()["powers"] = _powers(_P, STEP_BYTES + 1), _powers(_INVERSE, STEP_BYTES + 1)
    return kept()["powers"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts.

    doc, start, end, key: for each word the text's index, its bytes in buf
    (ASCII letters lower-cased, if fold) and its 64-bit hash. first: for each text the
    index of its first word, and at the end the number of words.

    Bytes are taken in windows of STEP_BYTES, across whose ends a word's hash
    is carried on, so what a long text needs beyond its words is bounded.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool = True) -> None:
        self.raw = buf
        self.buf = np.empty_like(buf) if fold else buf
        self.offsets = offsets
        starts, ends, sums = [], [], []
        up, down = _tables()
        held: tuple[int, int] | None = None  # start and hash so far of a word that goes on in the next window
        for lo in range(0, len(buf), STEP_BYTES):
            hi = min(len(buf), lo + STEP_BYTES)
            part = buf[lo:hi]
            if fold:
                self.buf[lo:hi] = part = _FOLD[part]
            inside = table[part]
            opens = inside.copy()
            opens[1:] &= ~inside[:-1]
            closes = inside.copy()
            closes[:-1] &= ~inside[1:]
            edges = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
            opens[edges] = inside[edges]
            closes[edges - 1] = inside[edges - 1]
            start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
            sum_ = (total[end] - total[start]) * down[start]
            start, end = start + lo, end + lo
            if held is not None:
                sum_[0] = np.uint64((held[1] + int(sum_[0]) * pow(int(_P), lo - held[0], 2**64)) % 2**64)
                start[0] = held[0]
                held = None
            i = int(np.searchsorted(offsets, hi))
            if len(end) and end[-1] == hi < len(buf) and offsets[i] != hi and table[_FOLD[buf[hi]] if fold else buf[hi]]:
                held = int(start[-1]), int(sum_[-1])
                start, end, sum_ = start[:-1], end[:-1], sum_[:-1]
            starts.append(start.astype(np.int32))
            ends.append(end.astype(np.int32))
            sums.append(mix(sum_ + (end - start).astype(np.uint64) * _GRAM[63]))
        none = np.zeros(0, np.int32)
        self.start, self.end = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.key = np.concatenate([none.astype(np.uint64), *sums])
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def gram_runs(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """doc, position and hash of every k words in a row, about STEP_BYTES / 8 at a time."""
        m = len(self.key) - k + 1
        size = STEP_BYTES // 8 + 1
        for lo in range(0, m, size):
            hi = min(m, lo + size)
            total = np.full(hi - lo, _GRAM[62], np.uint64) * np.uint64(k)
            for j in range(k):
                total += self.key[lo + j : hi + j] * _GRAM[j]
            ok = np.flatnonzero(self.doc[lo:hi] == self.doc[lo + k - 1 : hi + k - 1])
            doc = self.doc[lo:hi][ok]
            yield doc, lo + ok - self.first[doc], mix(total[ok])

    def short_grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts of 1 to k-1 words, and the hash of their whole sequences."""
        count = np.diff(self.first)
        few = np.flatnonzero((count > 0) & (count < k)).astype(np.int32)
        out = np.empty(len(few), np.uint64)
        with np.errstate(over="ignore"):
            for i, d in enumerate(few):
                own = self.key[self.first[d] : self.first[d + 1]]
                out[i] = (own * _GRAM[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own)) * _GRAM[62]
        return few, mix(out)

    def grams(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc, position and hash of every k words in a row; short: a text of 1 to k-1 words gives its whole sequence."""
        none = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        doc, pos, key = (np.concatenate(x) for x in zip(none, *self.gram_runs(k)))
        if not short:
            return doc, pos, key
        few, more = self.short_grams(k)
        if len(few):
            doc = np.concatenate([doc, few])
            order = np.argsort(doc, kind="stable")
            doc, pos, key = doc[order], np.concatenate([pos, np.zeros(len(few), np.int64)])[order], np.concatenate([key, more])[order]
        return doc, pos, key

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index and hash of the first n bytes of each word that is longer."""
        i = np.flatnonzero(self.end - self.start > n)
        at = self.start[i]
        total, up = np.full(len(i), _GRAM[63], np.uint64) * np.uint64(n), _tables()[0]
        for j in range(n):
            total += _BYTE[self.buf[at + j]] * up[j]
        return i, mix(mix(total) ^ np.uint64(n))

    def text(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def steps(texts: pa.Array, table: np.ndarray, fold: bool = True) -> Iterator[tuple[int, Words]]:
    """(index of the first row, Words) for runs of rows of about STEP_BYTES each."""
    buf, offsets = text_bytes(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, "right")) - 1)
        with np.errstate(over="ignore"):
            yield row, Words(buf[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], table, fold)
        row = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def words_of(text: str | None, table: np.ndarray) -> Words:
    """The words of one text."""
    return next(steps(pa.array([text or ""]), table))[1]

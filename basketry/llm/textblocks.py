"""Whole texts as numpy arrays: words, word hashes and n-gram hashes of many documents at once.

A block is a run of whole documents of a few MB. All hashes are 64-bit and equal
on every machine, so they can be joined on between tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_LANE, _LENGTH, _RUN = _RNG.integers(1, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TAIL = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the first i bytes of a lane

SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time go through ``mix``, so that no arithmetic of bytes carries over."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _LENGTH)
    if not len(out):
        return out
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    at, left, which = starts, sizes, None
    while len(at):
        lane = lanes[at].view("<u8").ravel() & _TAIL[np.minimum(left, 8)]
        if which is None:
            out = mix((out ^ lane) * _LANE)
        else:
            out[which] = mix((out[which] ^ lane) * _LANE)
        more = left > 8
        which = np.flatnonzero(more) if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    return out


class Block:
    """Documents side by side: ``data`` holds their bytes, ``offsets`` where each begins and ends."""

    def __init__(self, rows: pa.RecordBatch, text: pa.Array):
        self.rows, self.n = rows, len(text)
        text = text.cast(pa.large_binary())
        _, offs, data = text.buffers()
        offs = np.frombuffer(offs, np.int64)[text.offset : text.offset + self.n + 1]
        self.offsets = offs - offs[0]
        size = int(self.offsets[-1])
        self.data = np.frombuffer(data, np.uint8)[offs[0] : offs[0] + size] if size else np.zeros(0, np.uint8)
        self.null = np.asarray(text.is_null()) if text.null_count else np.zeros(self.n, bool)

    def arrow(self, name: str) -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))

    def column(self, name: str) -> np.ndarray:
        return self.arrow(name).to_numpy(zero_copy_only=False)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut Arrow batches into blocks of about ``size`` bytes of text; a longer document is a block alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        missing = batch.column(batch.schema.get_field_index(text)).is_null()
        offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + batch.num_rows + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
            block = Block(batch.slice(at, to - at), column.slice(at, to - at))
            block.null = np.asarray(missing.slice(at, to - at))
            yield block
            at = to


class Words:
    """Words of a block: byte ranges, 64-bit hashes and, for each document, its first word and the end."""

    def __init__(self, block: Block, inside: np.ndarray = SPACES, lower: bool = False):
        data, offsets = block.data, block.offsets
        size = len(data)
        if not size:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(block.n + 1, np.int64)
            self.hashes = np.zeros(0, np.uint64)
            self.doc = np.zeros(0, np.int64)
            return
        word = inside[data]
        before = np.empty(size, bool)
        before[0], before[1:] = False, word[:-1]
        before[offsets[:-1][offsets[:-1] < size]] = False
        after = np.empty(size, bool)
        after[-1], after[:-1] = False, word[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = hash_words(LOWER[data] if lower else data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(block.n), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first words of the k-word runs that lie in one document, and the runs' hashes."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        if k == 1:
            return at, self.hashes
        out = np.full(len(at), k, np.uint64)
        for j in range(k):
            out = mix((out ^ self.hashes[at + j]) * _RUN)
        return at, out


def shingle_sets(words: Words, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, sorted, with each document's range of them.

    A document of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    at, grams = words.grams(k)
    first = np.searchsorted(at, words.first)
    counts = np.diff(words.first)
    parts, ends = [], np.zeros(n_docs + 1, np.int64)
    for i in range(n_docs):
        if counts[i] == 0:
            own = grams[:0]
        elif counts[i] < k:
            own = mix(_folded(words.hashes[words.first[i] : words.first[i + 1]]))
        else:
            own = grams[first[i] : first[i + 1]].copy()
            own.sort()
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        parts.append(own)
        ends[i + 1] = ends[i] + len(own)
    return (np.concatenate(parts) if parts else grams[:0]), ends


def _folded(hashes: np.ndarray) -> np.ndarray:
    total = np.array([len(hashes)], np.uint64)
    for h in hashes:
        total = mix((total ^ h) * _RUN)
    return total


class Joined:
    """A block's words with one space after each, so that a run of words is one slice of bytes."""

    def __init__(self, block: Block, words: Words, lower: bool = False):
        size = len(block.data)
        inside = np.zeros(size + 1, np.int8)
        np.add.at(inside, words.starts, 1)
        np.add.at(inside, words.ends, -1)
        kept = np.cumsum(inside[:-1]) > 0
        sizes = words.ends - words.starts
        self.ends = np.cumsum(sizes + 1)
        out = np.full(int(self.ends[-1]) if len(sizes) else 0, 0x20, np.uint8)
        gap = np.ones(len(out), bool)
        gap[self.ends - 1] = False
        out[gap] = LOWER[block.data[kept]] if lower else block.data[kept]
        self.data = out.tobytes()
        self.starts = self.ends - sizes - 1

    def text(self, begin: int, end: int) -> bytes:
        """Words ``begin`` to ``end`` of the block, joined by a space."""
        return self.data[self.starts[begin] : self.ends[end - 1] - 1] if end > begin else b""

    def digest(self, begin: int, n: int) -> bytes:
        return hashlib.sha256(self.text(begin, begin + n)).digest()


def longs(x: np.ndarray) -> pa.Array:
    """Hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), longs(values))

"""Token ids in wavelet matrices: one compressed file a shard, with access, rank, select and counting."""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.storage import new_path, partitions, shared_dir

MAGIC = b"WVM2"
#: 64-bit words of a plane in one compressed frame.
FRAME = 1024
#: Ids of a shard before it is closed; a longer document is a shard alone.
SHARD_IDS = 1 << 20
CACHED_WORDS = 200_000


class _Plane:
    """Bits in frames, compressed until they are asked for, with the ones ahead of each frame."""

    def __init__(self, frames: list, starts: np.ndarray):
        self.frames, self.starts = frames, starts  # starts has the number of all ones as its last
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, words: np.ndarray) -> _Plane:
        frames = [words[i : i + FRAME] for i in range(0, len(words), FRAME)]
        ones = [int(np.bitwise_count(f).sum()) for f in frames]
        return cls(frames, np.concatenate(([0], np.cumsum(ones, dtype=np.int64))))

    def frame(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of a frame, and the ones ahead of each in the whole plane."""
        if k not in self.open:
            words = self.frames[k]
            if not isinstance(words, np.ndarray):
                words = np.frombuffer(zstandard.ZstdDecompressor().decompress(words, max_output_size=8 * FRAME), np.uint64)
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.open[k] = words, self.starts[k] + np.concatenate(([0], ones[:-1]))
        return self.open[k]

    def at(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words at the given places, 0 beyond the end, and the ones ahead of each."""
        out, ahead = np.zeros(word.shape, np.uint64), np.full(word.shape, self.starts[-1])
        of = word // FRAME
        for k in np.unique(of).tolist():
            if k < len(self.frames):
                words, ranks = self.frame(k)
                mine = (of == k) & (word - k * FRAME < len(words))
                out[mine], ahead[mine] = words[word[mine] - k * FRAME], ranks[word[mine] - k * FRAME]
        return out, ahead

    def nth(self, bit: int, nth: int) -> int:
        """Place of the ``nth`` 0 or 1."""
        before = self.starts[:-1] if bit else np.arange(len(self.frames)) * FRAME * 64 - self.starts[:-1]
        k = int(np.searchsorted(before, nth, "right")) - 1
        words, ranks = self.frame(k)
        ahead = ranks if bit else (k * FRAME + np.arange(len(words))) * 64 - ranks
        word = int(np.searchsorted(ahead, nth, "right")) - 1
        bits = np.unpackbits(words[word : word + 1].view(np.uint8), bitorder="little")
        return (k * FRAME + word) * 64 + int(np.flatnonzero(bits == bit)[nth - int(ahead[word])])

    def whole(self) -> np.ndarray:
        return np.concatenate([self.frame(k)[0] for k in range(len(self.frames))]) if self.frames else np.zeros(0, np.uint64)


class WaveletMatrix:
    """A sequence of non-negative integers as bit-planes, the highest first, each stably sorted by the ones before.

    What is read back stays compressed: a question opens the one frame of each
    plane that it touches.
    """

    def __init__(self, planes: list[_Plane], size: int):
        self.size, self.planes = size, planes
        self.zeros = [size - int(p.starts[-1]) for p in planes]

    @classmethod
    def build(cls, values: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        values = np.asarray(values)
        bits = bits if bits is not None else max(1, int(values.max(initial=0)).bit_length())
        planes = []
        for level in range(bits - 1, -1, -1):
            bit = (values & values.dtype.type(1 << level)) != 0
            packed = np.zeros(-(-len(values) // 64) * 8, np.uint8)
            packed[: -(-len(values) // 8)] = np.packbits(bit, bitorder="little")
            planes.append(_Plane.of(packed.view(np.uint64)))
            values = np.concatenate((np.compress(~bit, values), np.compress(bit, values)))
        return cls(planes, len(values))

    def _ones(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones ahead of each position, and the bits there."""
        at = np.asarray(at, np.int64)
        words, ahead = self.planes[level].at(at >> 6)
        place = (at & 63).astype(np.uint64)
        inside = np.bitwise_count(words & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
        return ahead + inside, (words >> place) & np.uint64(1)

    def access(self, at) -> np.ndarray:
        """The values at the given positions."""
        at = np.asarray(at, np.int64).copy()
        out = np.zeros(at.shape, np.int64)
        for level, zeros in enumerate(self.zeros):
            ones, bit = self._ones(level, at)
            bit = bit.astype(bool)
            out = out << 1 | bit
            at = np.where(bit, zeros + ones, at - ones)
        return out

    def all(self) -> np.ndarray:
        """The whole sequence: the planes undone from the lowest to the highest."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32 if len(self.planes) <= 32 else np.uint64
        out = np.zeros(self.size, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level].whole().view(np.uint8), count=self.size, bitorder="little").view(bool)
            out[self.zeros[level] :] |= kind(1 << (len(self.planes) - 1 - level))
            up = np.empty(self.size, kind)
            up[np.flatnonzero(~bit)] = out[: self.zeros[level]]
            up[np.flatnonzero(bit)] = out[self.zeros[level] :]
            out = up
        return out

    def rank(self, value: int, end: int, begin: int = 0) -> int:
        """Occurrences of ``value`` in ``[begin, end)``."""
        if value < 0 or value >> len(self.planes):
            return 0
        span = np.array([begin, end], np.int64)
        for level, zeros in enumerate(self.zeros):
            ones, _ = self._ones(level, span)
            span = zeros + ones if value >> (len(self.planes) - 1 - level) & 1 else span - ones
        return int(span[1] - span[0])

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def select(self, value: int, nth: int) -> int:
        """Position of the ``nth`` (from 0) occurrence of ``value``; -1 if there are not so many."""
        if nth < 0 or nth >= self.count(value):
            return -1
        begin = np.array([0], np.int64)
        for level, zeros in enumerate(self.zeros):
            ones, _ = self._ones(level, begin)
            begin = zeros + ones if value >> (len(self.planes) - 1 - level) & 1 else begin - ones
        at = int(begin[0]) + nth
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            at = self.planes[level].nth(bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, i) for i in range(self.count(value))]

    def to_bytes(self) -> bytes:
        """Header, the ones ahead of and the length of each frame, then the frames, each compressed alone."""
        pack = zstandard.ZstdCompressor(level=1).compress
        frames = [pack(np.ascontiguousarray(p.frame(k)[0]).tobytes()) for p in self.planes for k in range(len(p.frames))]
        starts = np.concatenate([p.starts for p in self.planes]) if self.planes else np.zeros(0, np.int64)
        sizes = np.array([len(f) for f in frames], np.uint32)
        return b"".join((MAGIC, struct.pack("<QII", self.size, len(self.planes), FRAME), starts.astype("<i8").tobytes(),
            sizes.astype("<u4").tobytes(), *frames))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        size, bits, frame = struct.unpack_from("<QII", data, 4)
        if frame != FRAME:
            raise ValueError(f"frames of {frame} words")
        n = -(-(-(-size // 64)) // FRAME)  # frames of a plane
        starts = np.frombuffer(data, "<i8", bits * (n + 1), 20).reshape(bits, n + 1)
        ends = np.cumsum(np.frombuffer(data, "<u4", bits * n, 20 + 8 * bits * (n + 1)), dtype=np.int64)
        begin = 20 + 8 * bits * (n + 1) + 4 * bits * n
        bounds = np.concatenate(([0], ends)) + begin
        view = memoryview(data)
        planes = [_Plane([view[bounds[i * n + k] : bounds[i * n + k + 1]] for k in range(n)], starts[i]) for i in range(bits)]
        return cls(planes, size)


class _Kept(dict):
    """A table that makes what it lacks and starts anew when it is full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[key] = self.make(key)
        return value


class _Encoder:
    """Ids of whole texts with a ``tokenizers`` file, word by word.

    For the vocabulary whose normaliser drops white space and lower-cases, a
    text's ids are those of its words in turn. Words of ASCII and Latin-1 letters,
    digits and plain punctuation go to the library's model piece by piece, all
    others through its whole pipeline; ids of frequent words are kept.
    """

    PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=-@\[-`{-~]+")
    PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.wide = self.whole.get_vocab_size() > 1 << 16
        normal, split = str(self.whole.normalizer), str(self.whole.pre_tokenizer)
        self.by_word = "Lowercase()" in normal and 'content=" "' in normal and "behavior=Removed, invert=True" in split
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x100)}
        self.code = "I" if self.wide else "H"
        self.words, self.pieces = _Kept(self._word), _Kept(self._piece)

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._bytes([t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.table))])

    def _word(self, word: str) -> bytes:
        simple = self.SIMPLE.fullmatch(word)
        if simple:
            letters, marks = simple.groups()
            ids = self.pieces[letters.lower()]
            return ids + self.pieces[marks] if marks else ids
        if self.PLAIN.fullmatch(word):
            return b"".join([self.pieces[piece] for piece in self.PIECES.findall(word.lower())])
        return self._bytes(self.whole.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)
        words = re.split("[ \t-\r]+", text) if re.search("[\x1c-\x1f]", text) else text.split()
        return b"".join(map(self.words.__getitem__, words))


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def _shards(path: str, end_id: int):
    """Encode a sorted partition and close a shard whenever it is full."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        kind = np.uint32 if encoder.wide else np.uint16
        stop = kind(end_id).tobytes()
        docs, sizes, parts, held, part, shard = [], [], [], 0, None, 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), kind)
            matrix = WaveletMatrix.build(ids, 32 if encoder.wide else 16)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([matrix.to_bytes()], pa.binary())],
                names=["part", "shard", "ids", "doc_ids", "sizes", "matrix"])

        for batch in batches:
            for p, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = encoder.encode(text or "") + stop
                n = len(ids) // kind().itemsize
                if docs and held + n > SHARD_IDS:
                    yield closed()
                    docs, sizes, parts, held, shard = [], [], [], 0, shard + 1
                part = p
                docs.append(doc)
                sizes.append(n)
                parts.append(ids)
                held += n
        if docs:
            yield closed()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1) -> str:
    """Encode all of ``docs (doc_id, text, ...)`` in ascending doc_id order into wavelet matrices under ``path``.

    Each row of the Parquet table is a shard: its partition and place, how many
    ids, the documents with their numbers of ids, and the compressed matrix of
    bit-planes. ``end_id`` closes every document, also one of null or empty text.
    Rows with equal doc_ids follow each other in the order of their texts, null
    first. Other columns are not read; an empty table gives a table without rows.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    shards = rows.mapInArrow(_shards(tokenizer_path, end_id), "part int, shard int, ids long, doc_ids array<long>, sizes array<long>, matrix binary")
    shards.write.option("compression", "uncompressed").parquet(path)
    return path


def _decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, shard, docs, sizes, matrix = (batch.column(batch.schema.get_field_index(x))[row] for x in ("part", "shard", "doc_ids", "sizes", "matrix"))
            ids = WaveletMatrix.from_bytes(matrix.as_py()).all().astype("<u4")
            sizes = sizes.values.to_numpy()
            ends = np.cumsum(sizes)
            crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * k, pa.int32()), pa.array([shard.as_py()] * k, pa.int32()), docs.values,
                pa.array(ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(spark, path: str) -> DataFrame:
    """What the files under ``path`` hold, a row for each document: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it. Only one row a shard is
    needed for that: its number of ids.
    """
    stored = spark.read.parquet(path)
    parts = stored.groupBy("part").agg(F.sum("ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    heads = stored.select("part", "shard", "ids").withColumn("before", F.sum("ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("ids"))
    heads = heads.join(parts.select("part", "base"), "part").select("part", "shard", (F.col("before") + F.col("base")).alias("before"))
    rows = stored.mapInArrow(_decoded, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(heads, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the tokens of ``docs`` under the session's shared folder and return what is read back."""
    spark = docs.sparkSession
    shared_dir(spark)
    return read_tokens(spark, write_tokens(docs, tokenizer_path, new_path(spark, "tokens"), end_id))

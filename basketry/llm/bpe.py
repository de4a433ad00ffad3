"""Byte-level BPE: encoding over a contiguous array of ranks, and decoding."""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: How byte-level vocabularies cut a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes up to which a word is a row of an array with others, and up to which its ranks are scanned alone; those of a longer one lie in a heap.
TINY, SHORT = 48, 256
#: Words of an array.
ROWS = 1 << 13
#: Distinct words whose ids a task keeps, twice over.
CACHED_WORDS = 150_000
#: Characters and words handled at a time.
BATCH_CHARS, PIECES = 1 << 20, 1 << 16
_NEVER = sys.maxsize
_ID = 24  # bits of an id beside its rank
_LOW = (1 << _ID) - 1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next letter after Latin-1 that is free."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Bpe:
    """A byte-level vocabulary with its merges, read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model, split = stored["model"], stored["pre_tokenizer"]
        plain = model["type"] == "BPE" and split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if not plain or odd or stored["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in stored["added_tokens"]):
            raise ValueError(f"{path} is no plain byte-level BPE")
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {tuple(bytes(letters[c] for c in part) for part in pair): rank for rank, pair in enumerate(pairs)}
        byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        found = sorted((self.ids[a] << _ID | self.ids[b], rank << _ID | self.ids[a + b]) for (a, b), rank in self.ranks.items())
        self.keys, self.values = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.byte, self.byte_pairs = byte, self._look(np.repeat(byte, 256), np.tile(byte, 256))
        self.words = {i: word for word, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.words |= {i: text.encode() for text, i in self.special.items()}
        self.pattern = regex.compile(SPLIT)
        apart = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.apart = regex.compile(f"({apart})") if apart else None
        self.path, self.kept, self.older, self._unsure, self._library = path, {}, {}, None, None

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of ids the rank of their merge and, in the low bits, the id it makes; ``_NEVER`` if they do not merge."""
        key = a << _ID | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NEVER)

    def _arrays(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many short words, each a row of ranks: every step finds the least rank of each row, deletes the boundary inside and looks up the ranks around it."""
        n, size = len(words), np.array([len(w) for w in words], np.int64)
        wide = int(size.max()) + 1
        text = np.zeros((n, wide), np.uint8)
        held = np.arange(wide) < size[:, None]  # the boundaries at which a part begins
        text[held] = np.frombuffer(b"".join(words), np.uint8)
        parts = self.byte[text]
        ranks = np.full((n, wide), _NEVER)
        ranks[:, :-1] = np.where(held[:, 1:], self.byte_pairs[text[:, :-1].astype(np.int64) << 8 | text[:, 1:]], _NEVER)
        after, before = np.tile(np.arange(1, wide + 1), (n, 1)), np.tile(np.arange(-1, wide - 1), (n, 1))
        row = np.arange(n)
        while True:
            at = ranks[row].argmin(1)
            least = ranks[row, at]
            row, at, least = (x[least != _NEVER] for x in (row, at, least))
            if not len(row):
                break
            gone = after[row, at]
            new, on, back = least & _LOW, after[row, gone], before[row, at]
            parts[row, at], held[row, gone], ranks[row, gone] = new, False, _NEVER
            after[row, at] = on
            before[row, np.minimum(on, wide - 1)] = at  # the last column holds no part
            there = on < size[row]
            ranks[row, at] = np.where(there, self._look(new, parts[row, np.minimum(on, wide - 1)]), _NEVER)
            some = back >= 0
            r, at_back = row[some], back[some]
            ranks[r, at_back] = self._look(parts[r, at_back], new[some])
        flat, ends = parts[held].tolist(), np.cumsum(held.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words: the adjacent parts of least rank, leftmost first, become one until no two have a rank."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            n = len(words[order[at]])
            if n > TINY:  # few: one by one
                word = words[order[at]]
                bounds = self._scanned(word) if n <= SHORT else self._heaped(word)
                out[order[at]] = [self.ids[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
                at += 1
                continue
            to = at
            while to < len(order) and to - at < ROWS and len(words[order[to]]) <= min(TINY, max(8, 2 * n)):
                to += 1
            for i, ids in zip(order[at:to], self._arrays([words[i] for i in order[at:to]]), strict=True):
                out[i] = ids
            at = to
        return out

    def _scanned(self, word: bytes) -> list[int]:
        """Part boundaries beside the ranks of neighbours: find the least, delete the boundary inside, look up the two ranks around it."""
        rank = self.ranks.get
        bounds = list(range(len(word) + 1))
        ranks = [rank((word[i : i + 1], word[i + 1 : i + 2]), _NEVER) for i in range(len(word) - 1)]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            a, b = bounds[i], bounds[i + 1]
            if i:
                ranks[i - 1] = rank((word[bounds[i - 1] : a], word[a:b]), _NEVER)
            if i < len(ranks):
                ranks[i] = rank((word[a:b], word[b : bounds[i + 2]]), _NEVER)
        return bounds

    def _heaped(self, word: bytes) -> list[int]:
        """The same boundaries for a long word, whose ranks lie in a heap: a scan for each merge would be quadratic."""
        n, rank = len(word), self.ranks.get
        ends, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))  # of the part that starts here; -1 once it is gone
        heap: list[int] = []

        def pair(a: int) -> int:
            b = ends[a]
            return rank((word[a:b], word[b : ends[b]]), _NEVER) if b < n else _NEVER

        def offer(a: int) -> None:
            found = pair(a)
            if found != _NEVER:
                heapq.heappush(heap, found << 40 | a)

        for a in range(n - 1):
            offer(a)
        while heap:
            found, a = divmod(heapq.heappop(heap), 1 << 40)
            if ends[a] < 0 or pair(a) != found:
                continue
            b = ends[a]
            ends[a], ends[b] = ends[b], -1
            if ends[a] < n:
                before[ends[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        bounds = [0]
        while bounds[-1] < n:
            bounds.append(ends[bounds[-1]])
        return bounds

    def _pieces(self, text: str) -> Iterator[str]:
        """The words of a text without special tokens.

        The two Unicode tables may differ on letters and digits that are newer than
        this Python's; a text with one is cut by the library's own table.
        """
        if not _latin(text):
            if self._unsure is None:
                newer = regex.compile(r"[\p{L}\p{N}]")
                self._unsure = {c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and newer.match(c)}
            if not self._unsure.isdisjoint(text):
                if self._library is None:
                    from tokenizers import pre_tokenizers

                    self._library = pre_tokenizers.ByteLevel(add_prefix_space=False)
                return (text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text))
        if len(text) <= BATCH_CHARS:
            return iter(self.pattern.findall(text))
        return (m.group() for m in self.pattern.finditer(text))

    def _known(self, pieces: list[str]) -> dict[str, list[int]]:
        """A table that holds the ids of all the pieces; frequent words outlast a full table."""
        if len(self.kept) >= CACHED_WORDS:
            self.older, self.kept = self.kept, {}
        new = []
        for piece in set(pieces).difference(self.kept):
            ids = self.older.get(piece)
            if ids is None:
                new.append(piece)
            else:
                self.kept[piece] = ids
        found = dict(zip(new, self.merged([p.encode() for p in new]), strict=True))
        long_ = {p: ids for p, ids in found.items() if len(p) > SHORT}
        for piece in long_:
            del found[piece]
        self.kept.update(found)
        return self.kept | long_ if long_ else self.kept

    def encode_all(self, texts: list[str]) -> list[array]:
        """Ids of whole texts. Strings of special tokens become their ids. Words of many short texts are looked up together."""
        out = [array("i") for _ in texts]
        pieces: list[str] = []
        spans: list[tuple[array, int, int]] = []  # whose pieces lie where

        def settle() -> None:
            ids = self._known(pieces).__getitem__
            for to, a, b in spans:
                to.extend(chain.from_iterable(map(ids, pieces[a:b])))
            pieces.clear()
            spans.clear()

        for text, to in zip(texts, out, strict=True):
            for part in self.apart.split(text) if self.apart and self.apart.search(text) else [text]:
                if part in self.special:
                    settle()
                    to.append(self.special[part])
                    continue
                rest = self._pieces(part)
                while chunk := list(islice(rest, PIECES)):
                    spans.append((to, len(pieces), len(pieces) + len(chunk)))
                    pieces += chunk
                    if len(pieces) >= PIECES:
                        settle()
        settle()
        return out

    def encode(self, text: str) -> array:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 come as replacement characters, unknown ids as nothing."""
        return b"".join([self.words.get(i, b"") for i in ids]).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def vocabulary(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _runs(batch: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose sizes add up to about ``most``."""
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if len(sizes) > at:
        yield batch.slice(at)


def _mapped(name: str, to: str, kind: pa.DataType, each):
    """Put a column ``to`` made of the column ``name`` in its place, a run of rows at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(name)
            column = batch.column(place)
            length = pc.binary_length if pa.types.is_string(column.type) else pc.list_value_length
            sizes = length(column).fill_null(0).to_pylist()
            for part in _runs(batch, sizes, BATCH_CHARS):
                made = pa.array(each(part.column(place)), kind)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if i != place), made],
                    names=[*(f for f in part.schema.names if f != name), to])

    return run


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (list of int) in place of ``text``: the whole text's ids, without special ones put around.

    ``path`` is a byte-level BPE in the ``tokenizers`` format on every executor. The ids are those of that
    library, also for strings of special tokens within a text. Null and empty texts
    have no ids; rows are encoded one by one, so repeated rows and ids need no
    rule. All other columns are kept; a column already named ``ids`` is an error. An
    empty table gives an empty result.
    """
    if ids in docs.columns:
        raise ValueError(f"the table has a column {ids} already")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]

    def each(texts: pa.Array) -> list[array]:
        return vocabulary(path).encode_all([t or "" for t in texts.to_pylist()])

    return docs.select(*[f"`{f.name}`" for f in docs.schema if f.name != text], f"`{text}`").mapInArrow(
        _mapped(text, ids, pa.list_(pa.int32()), each), ", ".join([*fields, f"`{ids}` array<int>"]))


def decoded(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with a column ``text`` beside ``ids``: the text that the ids stand for, special tokens included.

    Null ids give a null text, no ids an empty one. All columns are kept; a column
    already named ``text`` is an error. An empty table gives an empty result.
    """
    if text in rows.columns:
        raise ValueError(f"the table has a column {text} already")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]

    def each(ids: pa.Array) -> list[str | None]:
        return [vocabulary(path).decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in ids]

    copy = "decoded_from"
    while copy in rows.columns:
        copy += "_"
    return rows.selectExpr("*", f"`{ids}` as `{copy}`").mapInArrow(_mapped(copy, text, pa.string(), each), ", ".join([*fields, f"`{text}` string"]))

"""Repeated passages across documents: winnowed anchors, matches extended along them, maximal repeats compared word by word."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.storage import keyed
from basketry.llm.textblocks import Block, Joined, Words, blocks, longs, mix

#: Entries that a task holds before it sends them on.
HELD = 1 << 19
#: Parts that the claims against one document are dealt to.
CHUNKS = 16
#: Where rows without doc_id stand in the order of documents: last, side by side.
NO_ID = (1 << 63) - 1
_ANCHOR = "slot long, id long, doc long, at int, known boolean"
_WINDOW = "slot long, id long, doc long, at int, run long, src long, src_at int, hashes array<long>"
_CLAIM = ("src", "src_begin", "n", "digest")


class _Held(ABC):
    """Keys of a task's documents with their places, sent on in sorted stretches."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, block: Block, doc: np.ndarray, key: np.ndarray, at: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((key, block.column("doc_id")[doc], block.column("id")[doc], at, *more))
        self.size += len(key)
        if self.size >= HELD:
            yield from self.sent()

    def taken(self) -> list[np.ndarray]:
        """Of each key and row the first place: key, document, row, place, further columns, and the row and place of the key's least document."""
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        columns = [x[order] for x in columns]
        key, own = columns[0], columns[2]
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new = new_key.copy()
        new[1:] |= own[1:] != own[:-1]
        first = np.maximum.accumulate(np.where(new_key, np.arange(len(key)), 0))[new]
        return [*(x[new] for x in columns), columns[1][first], own[first], columns[3][first]]

    @abstractmethod
    def sent(self) -> Iterator[pa.RecordBatch]:
        """What the held keys come to; none are held after."""


class _HeldAnchors(_Held):
    def sent(self) -> Iterator[pa.RecordBatch]:
        """An entry for each key and row. Those that know a lesser document need no search and go to a slot of their row.

        So a frequent key sends one searching entry from each task, and the least
        document's has a twin that needs no search if others have the key.
        """
        if not self.size:
            return
        key, doc, own, at, src_doc, _, _ = self.taken()
        known = doc > src_doc
        several = np.zeros(len(key), bool)
        several[:-1] = known[1:] & ~known[:-1]
        pick = np.concatenate((np.arange(len(key)), np.flatnonzero(several)))
        known = np.concatenate((known, np.ones(several.sum(), bool)))
        key, doc, own, at = (x[pick] for x in (key, doc, own, at))
        slot = np.where(known, mix(own.astype(np.uint64)), key)
        order = np.lexsort((at, own))  # neighbours that are alike take fewer bytes
        slot, known, doc, own, at = (x[order] for x in (slot, known, doc, own, at))
        columns = [longs(slot), pa.array(own), pa.array(doc, mask=doc == own), pa.array(at.astype(np.int32)), pa.array(known)]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "id", "doc", "at", "known"])


class _HeldWindows(_Held):
    def sent(self) -> Iterator[pa.RecordBatch]:
        """Windows that no lesser document of the task has, one row for each anchor with its windows' hashes; all others as runs along one source."""
        if not self.size:
            return
        key, doc, own, at, anchor, src_doc, src, src_at = self.taken()
        order = np.lexsort((at, own))
        key, doc, own, at, anchor, src_doc, src, src_at = (x[order] for x in (key, doc, own, at, anchor, src_doc, src, src_at))
        for known in (False, True):
            mine = (doc > src_doc) == known
            k, d, o, p, a, s, sp = (x[mine] for x in (key, doc, own, at, anchor, src, src_at))
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)
            new[1:] |= (s[1:] != s[:-1]) | (sp[1:] != sp[:-1] + 1) if known else a[1:] != a[:-1]
            first = np.flatnonzero(new)
            ends = np.append(first, len(k))
            none = np.ones(len(first), bool) & (not known)
            hashes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), longs(k)) if not known else pa.nulls(len(first), pa.list_(pa.int64()))
            slot = mix(o[first].astype(np.uint64)) if known else a[first]
            yield pa.RecordBatch.from_arrays([longs(slot), pa.array(o[first]), pa.array(d[first], mask=d[first] == o[first]), pa.array(p[first].astype(np.int32)),
                pa.array(np.diff(ends)), pa.array(s[first], mask=none), pa.array(sp[first].astype(np.int32), mask=none), hashes],
                names=["slot", "id", "doc", "at", "run", "src", "src_at", "hashes"])


def least_seeds(words: Words, seed: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ``seed``-word runs, and which of them is the least of each ``window`` runs in a row of one document.

    The second array holds the first word of each such stretch, the third the
    run that winnowing picks there.
    """
    at, grams = words.grams(seed)
    n = len(at) - window + 1
    if n <= 0:
        return grams, at[:0], at[:0]
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, window):
        ahead = grams[j : j + n]
        less = ahead < least
        least = np.where(less, ahead, least)
        place = np.where(less, np.arange(j, j + n), place)
    whole = words.doc[at[:n]] == words.doc[at[window - 1 :]]
    return grams, at[:n][whole], place[whole]


def _anchors(seed: int, window: int):
    """Every row's winnowed anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _HeldAnchors()
        for block in blocks(batches):
            words = Words(block)
            at, _ = words.grams(seed)
            grams, starts, place = least_seeds(words, seed, window)
            chosen = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
            doc = words.doc[starts[chosen]]
            yield from held.add(block, doc, grams[place[chosen]], at[place[chosen]] - words.first[doc])
        yield from held.sent()

    return run


def _listed(block: Block, column: str) -> Iterator[tuple[int, pa.StructArray]]:
    """The documents of a block that have entries in a column of lists, and these."""
    lists = block.arrow(column)
    for i in np.flatnonzero(np.asarray(lists.is_valid())):
        own = lists[int(i)].values
        if len(own):
            yield int(i), own


def _places(words: Words, doc: int, hashes: np.ndarray, bounds: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All runs of a document that are the same as those at the places ``at``, and which of them."""
    own = slice(bounds[doc], bounds[doc + 1])
    first = int(words.first[doc])
    wanted = hashes[own][at]  # the runs of one document lie side by side, the i-th begins at its i-th word
    order = np.argsort(wanted, kind="stable")
    spot = np.minimum(np.searchsorted(wanted[order], hashes[own]), len(wanted) - 1)
    same = wanted[order][spot] == hashes[own]
    return starts[own][same] - first, order[spot[same]]


def _windows(size: int, seed: int):
    """The windows whose own anchor another document has too: the anchor's extensions to either side."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _HeldWindows()
        for block in blocks(batches):
            words = Words(block)
            grams, starts, place = least_seeds(words, seed, size - seed + 1)
            bounds = np.searchsorted(words.grams(seed)[0], words.first)
            _, long_ = words.grams(size)
            near = np.zeros(len(starts), bool)
            for doc, own in _listed(block, "anchors"):
                mine = slice(*np.searchsorted(starts, words.first[doc : doc + 2]))
                near[mine] = np.isin(grams[place[mine]], grams[bounds[doc] + own.to_numpy()])
            doc = words.doc[starts[near]]
            yield from held.add(block, doc, long_[near], starts[near] - words.first[doc], grams[place[near]])
        yield from held.sent()

    return run


def _opened(places: np.ndarray, src: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry for each window of entries that stand for several: ``run`` is how many follow the first in a row, or, if negative, bits of which do."""
    many = run > 0
    n = np.where(many, run, 64)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    bits = np.repeat(np.where(many, 0, -run), n)
    there = np.repeat(many, n) | ((bits >> np.minimum(step, 63)) & 1).astype(bool)
    step = step[there]
    return np.repeat(places, n)[there] + (step << 32) + step, np.repeat(src, n)[there]


def _matches(block: Block, words: Words, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each document's maximal matches: first word, length, source, first word there.

    Windows that follow each other both here and in one source lie on one
    diagonal; the longest such runs are the matches, extended as far as they go.
    """
    starts, long_ = words.grams(size)
    bounds = np.searchsorted(starts, words.first)
    for doc, own in _listed(block, "windows"):
        both, src = _opened(*(own.field(c).to_numpy() for c in ("places", "src", "run")))
        at, which = _places(words, doc, long_, bounds, both >> 32, starts)
        src, src_at = src[which], (both & 0xFFFFFFFF)[which]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (src[1:] != src[:-1]) | (src_at[1:] != src_at[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at))) + size - 1
        yield doc, at[first], n, src[first], src_at[first]


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"src_begin": pa.int32(), "n": pa.int32(), "digest": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(c, pa.int64())) for i, c in enumerate(names)], names=list(names))


def _claims(size: int):
    """What each match says of its source: so many words from there on have this digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block)
            joined, ids, rows = Joined(block, words), block.column("id"), []
            for doc, begin, n, src, src_begin in _matches(block, words, size):
                first = int(words.first[doc])
                for b, k, s, sb in zip(begin.tolist(), n.tolist(), src.tolist(), src_begin.tolist(), strict=True):
                    rows.append((int(ids[doc]), s, sb, k, joined.digest(first + b, k)))
            yield _rows(rows, ("id", *_CLAIM))

    return run


def _refuted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Claims against a document that its words do not bear out."""
    for block in blocks(batches):
        words = Words(block)
        joined, ids, rows = Joined(block, words), block.column("id"), []
        for doc, own in _listed(block, "claims"):
            first, last = int(words.first[doc]), int(words.first[doc + 1])
            for begin, n, digest in zip(*(own.field(c).to_pylist() for c in _CLAIM[1:]), strict=True):
                if first + begin + n > last or joined.digest(first + begin, n) != digest:
                    rows.append((int(ids[doc]), begin, n, digest))
        yield _rows(rows, _CLAIM)


def _repeats(size: int, texts: bool):
    """Maximal repeats of each document, and what stays of its text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block)
            joined = Joined(block, words)
            change = np.zeros(len(words.hashes) + 1, np.int64)
            refuted = {i: {tuple(x[c] for c in _CLAIM) for x in own.to_pylist()} for i, own in _listed(block, "refuted")}
            for doc, begin, n, src, src_begin in _matches(block, words, size):
                first = int(words.first[doc])
                if doc in refuted:
                    said = zip(src.tolist(), src_begin.tolist(), n.tolist(), begin.tolist(), strict=True)
                    true = np.array([(s, sb, k, joined.digest(first + b, k)) not in refuted[doc] for s, sb, k, b in said])
                    begin, n = begin[true], n[true]
                np.add.at(change, first + begin, 1)
                np.add.at(change, first + begin + n, -1)
            gone = np.cumsum(change[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            digests, spans, kept = [], [], []
            for i in range(block.n):
                a, b = int(words.first[i]), int(words.first[i + 1])
                edges = np.diff(np.concatenate(([0], gone[a:b].astype(np.int8), [0])))
                begins, ends = np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()
                pieces = [joined.text(a + x, a + y) for x, y in zip([0, *ends], [*begins, b - a], strict=True) if y > x]
                stays = b" ".join(pieces)
                digests.append(hashlib.sha256(stays).hexdigest())
                spans.append([{"begin": x, "end": y} for x, y in zip(begins, ends, strict=True)])
                if texts:
                    kept.append(stays.decode())
            columns = {
                "doc_id": block.arrow("named"), "n_words": pa.array(np.diff(words.first)),
                    "n_removed": pa.array(total[words.first[1:]] - total[words.first[:-1]]),
                "kept_sha256": pa.array(digests, pa.string()), "repeats": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
            }
            if texts:
                columns["kept_text"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def remove_repeats(docs: DataFrame, size: int = 13, seed: int = 5, texts: bool = False) -> DataFrame:
    """One row per row of ``docs (doc_id, text, ...)``: ``doc_id, n_words, n_removed, kept_sha256, repeats``.

    Words are runs of bytes other than space and tab to carriage return. A word
    goes if a window of ``size`` words over it also starts in a document with a
    smaller doc_id. ``repeats`` are the maximal spans of such words (``begin``,
    ``end``, in words), ``kept_sha256`` hashes the kept words joined by a space;
    with ``texts`` they come as ``kept_text``. Null and empty texts have no words.
    Rows with one doc_id count as the same document, so none of them is a source
    of the others; rows without one come after all others, and none of them is a
    source. Other columns are not read; an empty table gives an empty result.

    Winnowing gives every window its least run of ``seed`` words as its anchor.
    Documents meet on anchors; the windows around an anchor that several have meet
    in its task by their hashes, each document with the least one that has the window. Windows in a
    row here and there extend to one match as long as the texts agree. Each
    match then claims that its source has the same words, by the SHA-256 of all of
    them, and the source's own words decide; words of a refuted match stay.
    """
    if not seed <= size < seed + 60:
        raise ValueError("a seed is not longer than a window, nor over 59 words shorter")
    docs, _ = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "id")
    docs = docs.select("id", F.col("doc_id").alias("named"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    docs = docs.where("id is not null")  # true of all; said here, so that every join below reads one and the same shuffle of the texts
    over, doc = Window.partitionBy("slot"), F.coalesce("doc", "id")

    def gathered(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        one = columns[0] if len(columns) == 1 else F.struct(*columns)
        return rows.groupBy(F.col("id").alias(f"{name}_id")).agg(F.collect_list(one).alias(name))

    def beside(rows: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
        return rows.join(lists.hint("shuffle_hash"), F.col("id") == F.col(f"{name}_id"), how).drop(f"{name}_id")

    found = docs.mapInArrow(_anchors(seed, size - seed + 1), _ANCHOR)
    found = found.withColumn("lo", F.min(F.when(~F.col("known"), doc)).over(over)).withColumn("hi", F.max(F.when(~F.col("known"), doc)).over(over))
    anchors = gathered(found.where(F.col("known") | (F.col("lo") < F.col("hi"))).select("id", "at"), "anchors", "at")

    found = beside(docs, anchors, "anchors", "inner").mapInArrow(_windows(size, seed), _WINDOW).repartition("slot")  # all windows of an anchor are in one task
    opened = found.select("slot", "id", doc.alias("doc"), "at", "run", "src", "src_at", F.posexplode_outer("hashes").alias("i", "hash"))
    least = F.min(F.when(F.col("src").isNull(), F.struct("doc", "id", (F.col("at") + F.col("i")).alias("at")))).over(Window.partitionBy("slot", "hash"))
    opened = opened.withColumn("least", least).where(F.col("src").isNotNull() | (F.col("least.doc") < F.col("doc")))

    def places(at: Column, src_at: Column) -> Column:
        return F.shiftleft(at.cast("long"), 32) + src_at

    known, i = F.col("src").isNotNull(), F.coalesce("i", F.lit(0))
    back = F.coalesce("src_at", F.col("least.at") - i)  # where the row's first window lies there, or would
    rows = opened.select("slot", "id", "at", F.coalesce("src", "least.id").alias("src"), back.alias("back"), known.alias("known"), "run", i.alias("i"))
    rows = rows.groupBy("slot", "id", "at", "src", "back", "known").agg(F.min("i").alias("i"), F.max("run").alias("run"),
        F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits"))
    run = F.when(F.col("known"), F.col("run")).otherwise(-F.expr("shiftright(bits, i)")).alias("run")
    windows = gathered(rows.select("id", places(F.col("at") + F.col("i"), F.col("back") + F.col("i")).alias("places"), "src", run), "windows", "places", "src", "run")
    matched = beside(docs, windows, "windows", "left")

    claims = matched.where("windows is not null").mapInArrow(_claims(size), "id long, src long, src_begin int, n int, digest binary")
    chunk = F.pmod(F.xxhash64(*_CLAIM[1:]), F.lit(CHUNKS))
    once = claims.select(*_CLAIM).distinct().groupBy("src", chunk).agg(F.collect_list(F.struct(*_CLAIM[1:])).alias("claims"))
    asked = beside(docs, once.select(F.col("src").alias("claims_id"), "claims"), "claims", "inner")
    refuted = asked.mapInArrow(_refuted, "src long, src_begin int, n int, digest binary")
    # a refuted claim goes to all that have a match with its source: those that made it know it again, and the claims are worked out once
    pairs = windows.select(F.col("windows_id").alias("id"), F.explode(F.array_distinct("windows.src")).alias("src"))
    wrong = gathered(pairs.join(refuted.distinct(), "src").select("id", *_CLAIM), "refuted", *_CLAIM)

    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<begin:long,end:long>>" + ", kept_text string" * texts
    return beside(matched, wrong, "refuted", "left").mapInArrow(_repeats(size, texts), kinds)

"""Benchmark passages in documents: a prefix-filtered join of item windows, verified word by word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.storage import keyed, written
from basketry.llm.textblocks import ALNUM, LOWER, Words, blocks, longs

SHINGLE = 3
#: A shingle filter has 64 bits for each shingle, between these powers of two (8 KB to 32 MB).
LEAST_BITS, MOST_BITS = 16, 28
#: Up to so many windows are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 50_000
#: Shingle counts that a task holds before it sends them on.
HELD = 1 << 20
_SPAN = "array<struct<begin:long,end:long>>"


def _lowered(words: Words, data: bytes, a: int, b: int) -> list[str]:
    """Words ``a`` to ``b`` of a block whose lower-cased bytes are ``data``."""
    return [data[s:e].decode("utf-8", "replace") for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)]


def _windows(size: int):
    """Each item's windows: the words, and their shingles with the places of those (shorter shingles in windows of under three words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block, ALNUM, lower=True)
            data, own = LOWER[block.data].tobytes(), block.column("item_id")
            hashes = {k: np.zeros(len(words.hashes), np.uint64) for k in range(1, SHINGLE + 1)}
            for k, of in hashes.items():
                at, grams = words.grams(k)
                of[at] = grams
            ids, texts, sizes, shingles = [], [], [], []
            for i in range(block.n):
                a, b = int(words.first[i]), int(words.first[i + 1])
                for at in range(a, max(a + 1, b - size + 1) if b > a else a):
                    to = min(b, at + size)
                    k = min(SHINGLE, to - at)
                    ids.append(own[i])
                    texts.append(_lowered(words, data, at, to))
                    sizes.append(to - at)
                    shingles.append(hashes[k][at : to - k + 1].view(np.int64))
            kinds = [pa.int64(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64())]
            columns = [pa.array(x, kind) for x, kind in zip((ids, texts, sizes, shingles), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "words", "n", "shingles"])

    return run


class _Filter:
    """A bitmap of shingle hashes, by their first bits: what it lacks is no shingle, what it has may be one."""

    def __init__(self, bits: int, rows: Iterable[tuple[int, int]]):
        self.shift = np.uint64(64 - bits)
        cells = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
        for cell, mask in rows:
            cells[cell] = np.uint64(mask & 0xFFFFFFFFFFFFFFFF)
        self.bytes = cells.view(np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> self.shift
        byte = self.bytes[(place >> np.uint64(3)).astype(np.int64)]
        return np.flatnonzero((byte >> (place & np.uint64(7)).astype(np.uint8)) & 1)


def _shingle_filter(shingles: DataFrame) -> _Filter:
    """The filter of ``shingles (h)``. Its rows are set bits joined by 64, so its size is bounded whatever the table's."""
    n = shingles.count()
    bits = min(MOST_BITS, max(LEAST_BITS, int(64 * n).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits)
    cells = shingles.groupBy(F.shiftrightunsigned(place,
        6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - bits}) & 63))")).alias("mask"))
    return _Filter(bits, ((r.cell, r.mask) for r in cells.toLocalIterator()))


def _counted(known: _Filter, orders: list[int]):
    """How many times shingles that pass the filter occur in the documents, summed within each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def sent() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([longs(keys), pa.array(n)], names=["h", "n"])

        for block in blocks(batches):
            words = Words(block, ALNUM, lower=True)
            for k in orders:
                grams = words.grams(k)[1]
                held.append(grams[known(grams)])
                size += len(held[-1])
            if size >= HELD:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    return run


def _prefix_hits(known: _Filter, orders: list[int], size: int):
    """Each row's number of words, and where prefix shingles may occur in it, with the words around that a window can cover."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("before", pa.int64()), ("words", pa.list_(pa.string()))]))
        for block in blocks(batches):
            words = Words(block, ALNUM, lower=True)
            hits: list[list] = [[] for _ in range(block.n)]
            data = None
            for k in orders:
                at, grams = words.grams(k)
                for j in known(grams).tolist():
                    data = LOWER[block.data].tobytes() if data is None else data
                    i = int(at[j])
                    doc = int(words.doc[i])
                    a, b = max(int(words.first[doc]), i - size + k), min(int(words.first[doc + 1]), i + size)
                    place = i - int(words.first[doc])
                    hits[doc].append({"h": int(grams[j].view(np.int64)), "at": place, "before": i - a, "words": _lowered(words, data, a, b)})
            yield pa.RecordBatch.from_arrays([block.arrow("doc_id"), pa.array(np.diff(words.first)), pa.array(hits, entry)],
                names=["doc_id", "n_words", "hits"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """One row per row of ``docs (doc_id, text, ...)``: its words inside windows of ``benchmark (item_id, text, ...)``.

    Words are runs of a-z, 0-9 and non-ASCII bytes after lower-casing A-Z. A
    window is ``size`` consecutive words of an item; an item of fewer is one
    window, one without words has none. Columns: ``doc_id, n_words, n_hit`` (words
    inside an occurrence of a window), ``n_items, items`` (item_ids in order),
    ``items_sha256`` (of the ids, sorted as strings, comma-joined), ``spans`` (of
    hit words) and ``contaminated`` (n_hit > 0 and 20 * n_hit >= n_words).
    Null and empty texts have no words; an empty benchmark hits nothing. Each row
    is judged by its own text, also where doc_ids repeat or are null; repeated
    items count once by id, items without id or text are left out. Other columns
    are not read.

    Equal windows are merged. The shingles of a window are ordered by their number
    in the documents, and the rarest is its prefix: the window can only occur where
    that occurs. Documents meet windows in a join on prefixes; the window's place
    and the document's length bound a match, and all its words confirm it. Before
    the join a bitmap of prefixes, of at most 32 MB, keeps most words of the
    documents out of the shuffle; it loses none. The documents are read twice,
    however large the benchmark is.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    split = written(items.mapInArrow(_windows(size), "item_id long, words array<string>, n long, shingles array<long>"), "item-windows")
    of_items = split.select("words", "item_id").distinct()
    windows = split.dropDuplicates(["words"]).select("words", "n", "shingles")
    orders = sorted(r.k for r in windows.select(F.least("n", F.lit(SHINGLE)).cast("int").alias("k")).distinct().collect())

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = windows.select(F.explode("shingles").alias("h")).distinct()
    counts = texts.mapInArrow(_counted(_shingle_filter(own), orders), "h long, n long") if orders else own.select("h",
        F.lit(0).cast("long").alias("n")).limit(0)
    rarity = own.join(counts.groupBy("h").agg(F.sum("n").alias("found")), "h", "left")
    places = windows.select("words", "n", F.posexplode("shingles").alias("offset", "h")).join(rarity, "h")
    first = F.min(F.struct(F.coalesce("found", F.lit(0)).alias("found"), "h", "offset")).alias("p")
    prefixed = written(places.groupBy("words", "n").agg(first).select("words", "n", "p.h", "p.offset"), "prefixed-windows")

    hits = "doc_id long, n_words long, hits array<struct<h:long,at:long,before:long,words:array<string>>>"
    prefixes = _shingle_filter(prefixed.select("h").distinct())
    found = texts.mapInArrow(_prefix_hits(prefixes, orders, size), hits).withColumn("row", F.monotonically_increasing_id())
    found = written(found, "prefix-hits")

    met = found.select("row", F.explode("hits").alias("at")).select("row", F.col("at.h").alias("h"), F.col("at.at").alias("place"),
        F.col("at.before").alias("before"), F.col("at.words").alias("around"))
    window = prefixed.select("h", "offset", "n", F.col("words").alias("window"))
    if prefixed.count() <= BROADCAST_WINDOWS:
        window = F.broadcast(window)
    begin = F.col("before") - F.col("offset")
    fits = (begin >= 0) & (begin + F.col("n") <= F.size("around"))  # position and length bounds
    same = F.slice("around", (begin + 1).cast("int"), F.col("n").cast("int")) == F.col("window")
    occurs = met.join(window, "h").where(F.when(fits, same).otherwise(False))
    start = F.col("place") - F.col("offset")
    occurs = written(occurs.select("row", start.alias("begin"), (start + F.col("n")).alias("end"), "window"), "occurrences")

    before = Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = occurs.select("row", "begin", "end").distinct().withColumn("reached", F.max("end").over(before))
    spans = spans.withColumn("island", F.sum((F.col("reached").isNull() | (F.col("begin") > F.col("reached"))).cast("int")).over(upto))
    spans = spans.groupBy("row", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"), F.sum(F.col("end") - F.col("begin")).alias("n_hit"))
    named = occurs.select("row", F.col("window").alias("words")).distinct().join(of_items, "words").select("row", "item_id").distinct()
    named = named.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))

    out = found.drop("hits").join(spans, "row", "left").join(named, "row", "left")
    no_spans, no_items = F.expr(f"cast(array() as {_SPAN})"), F.expr("cast(array() as array<long>)")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", no_items).alias("items"),
        F.coalesce("spans", no_spans).alias("spans"))
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"),
        contaminated.alias("contaminated"), "items", "spans",
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """The rows of ``docs (doc_id, text, ...)`` that are not contaminated, with all their columns; each follows its own text."""
    own, _ = keyed(docs, "contamination_key")
    found = contamination(own.select(F.col("contamination_key").alias("doc_id"), "text"), benchmark, size)
    bad = found.where("contaminated").select(F.col("doc_id").alias("contamination_key"))
    return own.join(bad, "contamination_key", "left_anti").select(*[f"`{c}`" for c in docs.columns])

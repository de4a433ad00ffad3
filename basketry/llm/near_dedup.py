"""Near-duplicate documents: circulant MinHash signatures, banding, exact Jaccard verification."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.components import components, contracted, labels
from basketry.llm.storage import keyed, written
from basketry.llm.textblocks import Joined, Words, blocks, lists, longs, mix, shingle_sets

BANDS, ROWS = 32, 4
#: Up to so many clusters have their numbers of blocks broadcast.
BROADCAST_CLUSTERS = 50_000
_ALL = "id long, n long, words binary, bands array<long>"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _permute(x: np.ndarray) -> np.ndarray:
    """One fixed permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(shingles: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """MinHash signatures ``(documents, size)`` from two permutations.

    The first scatters shingles over the 32-bit ring; the second, shifted
    circularly by k, gives coordinate k. Rows of empty sets are the maximum.
    """
    out = np.full((len(ends) - 1, size), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        ring = (mix(shingles ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
        for k in range(size):
            out[full, k] = np.minimum.reduceat(_permute(ring - np.uint32(k)), ends[full])
    return out


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, size=1 << 18):
            words = Words(block, lower=True)
            shingles, ends = shingle_sets(words, block.n, k)
            joined = Joined(block, words, lower=True)
            digests = [joined.digest(a, b - a) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
            wide = circulant_signatures(shingles, ends, bands * rows).astype(np.uint64).reshape(block.n, bands, rows)
            keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (block.n, bands)).copy()
            for j in range(rows):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.column("id")), pa.array(np.diff(ends)), pa.array(digests, pa.binary()), lists(keys.ravel(), np.arange(block.n + 1) * bands)],
                names=["id", "n", "words", "bands"],
            )

    return run


def word_shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The distinct ``k``-word shingles of a text, as words."""
    words = _WORD.findall(text.lower())  # of bytes: A-Z alone
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def _overlaps(k: int, percent: int):
    """Pairs of texts whose full shingle sets, word by word, reach the Jaccard similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 64
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                sides = []
                for name in ("text_a", "text_b"):
                    parts = [(shingle_sets(Words(b, lower=True), b.n, k), b.n) for b in blocks([rows], name)]
                    sides.append([s[e[i] : e[i + 1]] for (s, e), n in parts for i in range(n)])
                texts = [rows.column(rows.schema.get_field_index(x)).cast(pa.binary()) for x in ("text_a", "text_b")]
                keep, last, own = [], None, set()
                for i, (x, y) in enumerate(zip(*sides, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(y) - both):  # by hashes; now by the words
                        a, b = (t[i].as_py() for t in texts)
                        if a != last:
                            last, own = a, word_shingles(a, k)
                        other = word_shingles(b, k)
                        both = len(own & other)
                        if both and 100 * both >= percent * (len(own) + len(other) - both):
                            keep.append(i)
                yield rows.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _shingle_rows(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            shingles, ends = shingle_sets(Words(block, lower=True), block.n, k)
            yield pa.RecordBatch.from_arrays([longs(shingles), pa.array(np.repeat(block.column("id"), np.diff(ends)))], names=["h", "id"])

    return run


def _set_rows(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            shingles, ends = shingle_sets(Words(block, lower=True), block.n, k)
            yield pa.RecordBatch.from_arrays([pa.array(block.column("id")), lists(shingles, ends)], names=["id", "h"])

    return run


def verified_links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of ``pairs (a, b)`` whose ``texts (id, text)`` have a Jaccard similarity of ``percent``/100 or more."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_overlaps(k, percent), "a long, b long")


def near_groups(docs: DataFrame, k: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(id, n, rep)`` for every row of ``docs (id, text)``, ids being unique: set size and the least id of the row's component.

    Rows of the same words are merged first, by the SHA-256 of all of them. Within a bucket of a band, members are compared
    with the bucket's first member only; buckets that still hold several
    components are settled in ``_rest``. With 32 bands of 4 rows a pair at 0.8 shares no
    bucket with probability 5e-8.
    """
    signed = written(docs.mapInArrow(_signatures(k, bands, rows), _ALL), "signatures")
    full = signed.where("n > 0")
    classes = full.groupBy("words").agg(F.min("id").alias("rep"))
    member = full.select("id", "words").join(classes, "words").select("id", "rep")
    firsts = full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    spread = written(firsts.select("id", "n", F.explode("bands").alias("bucket")).join(_crowded(firsts), "bucket"), "buckets")
    wanted = spread.select("id").distinct()
    texts = written(docs.join(wanted, "id", "left_semi"), "texts")
    pairs = spread.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = written(verified_links(pairs, texts, k, percent), "links")
    comp = components(_rest(spread, texts, pairs, links, k, percent))
    named = member.join(comp, member.rep == comp.node, "left").select("id", F.coalesce("component", "rep").alias("rep"))
    return signed.select("id", "n").join(named, "id", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs (doc_id, text, ...)``: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of bytes other than space and tab to carriage return, A-Z
    lower-cased; a document's set is its distinct ``k``-word shingles. Documents
    are linked at a Jaccard similarity of ``percent``/100, and a component takes
    its least doc_id, which is kept. Null and empty texts have no shingles and
    stand alone. Each row is judged by its own text, also where doc_ids repeat or
    are null: rows that repeat the kept doc_id count as kept too, and a component
    without any doc_id has the component_id null and keeps none but its first row.
    Other columns are not read. An empty table gives an empty result.
    """
    own, plain = keyed(docs.select("doc_id", "text"), "id")
    groups = near_groups(own.select("id", "text"), k, percent, bands, rows)
    if plain:
        return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"),
            (F.col("id") == F.col("rep")).alias("kept"))
    groups = written(groups.join(own.select("id", F.col("doc_id").cast("long").alias("doc_id")), "id"), "groups")
    least = groups.groupBy("rep").agg(F.min("doc_id").alias("component_id"), F.min("id").alias("first"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("id") == F.col("first")))
    return groups.join(least, "rep").select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of near duplicates one row of ``docs (doc_id, text, ...)``, with all its columns: that of the least doc_id.

    Of rows that repeat that doc_id only the first stays. Rows without doc_id come
    after all others. Rows without words stand alone and stay.
    """
    own, plain = keyed(docs, "near_dedup_key")
    groups = near_groups(own.select(F.col("near_dedup_key").alias("id"), "text"), k, percent)
    if plain:
        gone = groups.where("id <> rep").select(F.col("id").alias("near_dedup_key"))
    else:
        groups = written(groups.join(own.select(F.col("near_dedup_key").alias("id"), F.col("doc_id").cast("long").alias("doc_id")), "id"), "groups")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
        first = groups.groupBy("rep").agg(F.min(order).alias("s")).select("rep", F.col("s.id").alias("stays"))
        gone = groups.join(first, "rep").where("id <> stays").select(F.col("id").alias("near_dedup_key"))
    return own.join(gone, "near_dedup_key", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def _crowded(firsts: DataFrame) -> DataFrame:
    """Buckets with two members or more, and their least member."""
    return firsts.select("id", F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.min("id").alias("leader"),
        F.max("id").alias("last")).where("leader < last").select("bucket", "leader")


def _chunks(ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, grams: np.ndarray, most: int = 256) -> Iterator[tuple[np.ndarray, ...]]:
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for at in range(0, len(ids), most):
        to = min(len(ids), at + most)
        yield ids[at:to], comps[at:to], sizes[at:to], grams[ends[at] : ends[to]]


def _similar(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sets, of different components, that reach the similarity. Only shingles on both sides are counted."""
    both = np.intersect1d(x[3], y[3])
    marks = []
    for _, _, sizes, grams in (x, y):
        at = np.minimum(np.searchsorted(both, grams), max(0, len(both) - 1))
        real = both[at] == grams if len(both) else np.zeros(len(grams), bool)
        mark = np.zeros((len(sizes), len(both)), np.float32)
        mark[np.repeat(np.arange(len(sizes)), sizes)[real], at[real]] = 1
        marks.append(mark)
    same = (marks[0] @ marks[1].T).astype(np.int64)
    union = x[2][:, None] + y[2][None, :] - same
    return np.nonzero((same > 0) & (100 * same >= percent * union) & (x[1][:, None] != y[1][None, :]))


def _blocks_compared(percent: int):
    """Links between the texts of two blocks of shingle sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for name in ("x", "y"):
                    sets = batch.column(batch.schema.get_field_index(name))[row].values
                    ids, comps, lists_ = (sets.field(f) for f in ("id", "c", "h"))
                    sides.append((ids.to_numpy(), comps.to_numpy(), np.diff(lists_.offsets.to_numpy()), lists_.flatten().to_numpy()))
                for x in _chunks(*sides[0]):
                    for y in _chunks(*sides[1]):
                        i, j = _similar(x, y, percent)
                        _, once = np.unique(np.stack((i, y[1][j])), axis=1, return_index=True)  # one link from a text to a component
                        i, j = i[once], j[once]
                        yield pa.RecordBatch.from_arrays([pa.array(x[0][i]), pa.array(y[0][j])], names=["a", "b"])

    return run


def _open(spread: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, as far as ``edges`` show them, with their component."""
    label = labels(edges)
    now = spread.join(label, F.col("id") == F.col("node"), "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("c"))
    mixed = now.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least")).where("lo < hi").select("bucket", "least")
    return written(now.join(mixed, "bucket"), "open")


def _rest(spread: DataFrame, texts: DataFrame, pairs: DataFrame, links: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges with the same components as all links: those given, and those between components that still meet in a bucket.

    A shingle that no other text of the unsettled buckets has cannot be shared,
    so a text with many of them reaches no partner of its bucket and leaves. In
    each bucket the text with the fewest is then compared with the other
    components. What is unsettled after that is compared in blocks: buckets that
    share texts form a cluster, and the texts outside a cluster's largest
    component meet all texts of the cluster, a block of sets with a block of sets.
    """
    edges = contracted(links)
    now = _open(spread, edges)
    grams = texts.join(now.select("id").distinct(), "id", "left_semi").mapInArrow(_shingle_rows(k), "h long, id long")
    alone = grams.groupBy("h").agg(F.count("*").alias("df"), F.min("id").alias("id")).where("df = 1").groupBy("id").agg(F.count("*").alias("own"))
    most = F.col("n") - F.coalesce("own", F.lit(0))
    able = now.join(alone, "id", "left").withColumn("most", most).where(f"100 * most >= {percent} * (n + greatest(least, most) - most)")
    able = written(able.select("bucket", "id", "n", "c", "most"), "able")
    hub = able.groupBy("bucket").agg(F.min(F.struct((F.col("n") - F.col("most")).alias("own"), "id", "n", "most", "c")).alias("h")).select("bucket", "h.*")
    bound = f"x.c <> y.c and 100 * least(x.most, y.most) >= {percent} * (x.n + y.n - least(x.most, y.most))"
    ends = F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    new = hub.alias("x").join(able.alias("y"), "bucket").where(bound).select(*ends).distinct()
    more = verified_links(new.join(pairs, ["a", "b"], "left_anti"), texts, k, percent)
    edges = contracted(edges.union(more))

    left = _open(able.select("bucket", "id", "n"), edges).select("bucket", "id", "n", "c")
    if left.isEmpty():
        return edges
    first = left.groupBy("bucket").agg(F.min("id").alias("first"))
    cluster = components(left.join(first, "bucket").select(F.col("first").alias("a"), F.col("id").alias("b")))
    texts_of = left.select("id", "n", "c").distinct().join(cluster, F.col("id") == F.col("node")).select("id", "n", "c", F.col("component").alias("cluster"))
    texts_of = written(texts_of, "unsettled")
    main = texts_of.groupBy("cluster", "c").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max(F.struct("m", "c")).alias("m"))
    main = main.select("cluster", F.col("m.c").alias("main"))
    sets = texts.join(texts_of.select("id"), "id", "left_semi").mapInArrow(_set_rows(k), "id long, h array<long>")
    sets = written(texts_of.join(main, "cluster").join(sets, "id"), "sets")

    def blocked(rows: DataFrame, block: str, name: str) -> tuple[DataFrame, DataFrame]:
        """The blocks of each cluster, of about 32768 shingles, and their numbers."""
        sizes = written(rows.groupBy("cluster").agg(F.ceil(F.sum("n") / 32768).alias("blocks")), "block-counts")
        at = F.pmod(F.xxhash64("id"), F.col("blocks")).alias(block)
        held = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_CLUSTERS else sizes, "cluster")
        held = held.groupBy("cluster", at).agg(F.collect_list(F.struct("id", "c", "h")).alias(name))
        return held, sizes.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias(block))

    (x, x_blocks), (y, y_blocks) = blocked(sets.where("c <> main"), "block_x", "x"), blocked(sets, "block_y", "y")
    pairs_of_blocks = x_blocks.join(y_blocks, "cluster")  # numbers alone meet by cluster, sets by cluster and block
    met = pairs_of_blocks.join(x, ["cluster", "block_x"]).join(y, ["cluster", "block_y"]).select("x", "y")
    alike = met.mapInArrow(_blocks_compared(percent), "a long, b long").distinct()
    return written(edges.union(verified_links(alike, texts, k, percent)), "links")

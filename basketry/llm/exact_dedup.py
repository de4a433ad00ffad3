"""Exact duplicates through sharded cuckoo-filter indexes of live texts."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.storage import partitions, written

SLOTS = 4
MAX_KICKS = 200
SALTS = 16
#: Bytes of text that one shard's index holds, about, and that a task combines before it sends.
SHARD_BYTES, HELD_BYTES = 1 << 26, 1 << 25


class CuckooIndex:
    """Live texts, each with a value, behind a cuckoo filter of their digests.

    ``tags`` is the filter: buckets of ``SLOTS`` 16-bit fingerprints, 0 for a free
    slot. ``numbers`` says which stored text a slot stands for. A hit of the filter
    is verified against that text, so texts whose digests agree stay apart; a table
    that overflows is rebuilt at twice the size from the stored digests. Texts of one
    digest that outnumber its two buckets wait in ``spare``.
    """

    def __init__(self, buckets: int = 64):
        self.buckets = 1 << max(1, int(buckets - 1).bit_length())
        self.live = 0
        self.stored: list = []  # (digest, text, value) or None
        self.free: list[int] = []
        self._clear()

    def _clear(self) -> None:
        self.tags = array("H", bytes(2 * SLOTS * self.buckets))
        self.numbers = array("q", bytes(8 * SLOTS * self.buckets))
        self.spare: list[int] = []

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ (tag * 0x5BD1E995 & (self.buckets - 1))

    def _slot(self, digest: bytes, text: str) -> tuple[int | None, int] | None:
        """The slot (None if spare) and number of a live text."""
        tag, a, b = self._places(digest)
        for bucket in {a, b}:
            for slot in range(bucket * SLOTS, (bucket + 1) * SLOTS):
                if self.tags[slot] == tag and self.stored[self.numbers[slot]][1] == text:
                    return slot, self.numbers[slot]
        return next(((None, n) for n in self.spare if self.stored[n][1] == text), None)

    def get(self, digest: bytes, text: str):
        """The text's value, or None."""
        at = self._slot(digest, text)
        return self.stored[at[1]][2] if at else None

    def put(self, digest: bytes, text: str, value) -> None:
        """Insert a text, or replace the value of a live one."""
        at = self._slot(digest, text)
        if at:
            self.stored[at[1]] = (digest, text, value)
            return
        if self.free:
            number = self.free.pop()
            self.stored[number] = (digest, text, value)
        else:
            number = len(self.stored)
            self.stored.append((digest, text, value))
        self.live += 1
        if not self._place(digest, number):
            self._grow(number)

    def delete(self, digest: bytes, text: str) -> bool:
        """Remove a live text; False if there is none."""
        at = self._slot(digest, text)
        if not at:
            return False
        slot, number = at
        if slot is None:
            self.spare.remove(number)
        else:
            self.tags[slot] = 0
        self.stored[number] = None
        self.free.append(number)
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, str, object]]:
        return (x for x in self.stored if x is not None)

    def _place(self, digest: bytes, number: int) -> bool:
        tag, a, b = self._places(digest)
        for bucket in (a, b):
            if self._set_free(bucket, tag, number):
                return True
        path, bucket = [], b
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (tag + kick) % SLOTS
            path.append((slot, self.tags[slot], self.numbers[slot]))
            old = self.tags[slot], self.numbers[slot]
            self.tags[slot], self.numbers[slot] = tag, number
            (tag, number), bucket = old, self._other(bucket, old[0])
            if self._set_free(bucket, tag, number):
                return True
        for slot, old_tag, old_number in reversed(path):  # leave the table as it was
            self.tags[slot], self.numbers[slot] = old_tag, old_number
        return False

    def _set_free(self, bucket: int, tag: int, number: int) -> bool:
        for slot in range(bucket * SLOTS, (bucket + 1) * SLOTS):
            if not self.tags[slot]:
                self.tags[slot], self.numbers[slot] = tag, number
                return True
        return False

    def _grow(self, number: int) -> None:
        if self.live < self.buckets:  # a quarter full: no larger table parts equal digests
            self.spare.append(number)
            return
        self.buckets *= 2
        self._clear()
        self.spare = [n for n, x in enumerate(self.stored) if x is not None and not self._place(x[0], n)]


def _combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a stretch of a task as one row: least document, number of rows and of those to delete."""
    held: dict[str, list] = {}
    size = 0

    def sent() -> pa.RecordBatch:
        columns = [[x[0] for x in held.values()], list(held), *([x[i] for x in held.values()] for i in (1, 2, 3))]
        kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "text", "least", "n", "gone"])

    for batch in batches:
        for digest, text, doc, gone in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            known = held.get(text)
            if known is None:
                held[text] = [digest, doc, 1, int(gone)]
                size += len(text)
                continue
            known[1] = doc if known[1] is None else known[1] if doc is None else min(known[1], doc)
            known[2] += 1
            known[3] += gone
        if size >= HELD_BYTES:
            yield sent()
            held, size = {}, 0
    if held:
        yield sent()


def _indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Insert a shard's texts into its index, delete those to go, and list what is live."""
    index, gone = CuckooIndex(), []
    for batch in batches:
        for digest, text, least, n, away in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            known = index.get(digest, text)
            if known is not None:
                n += known[1]
                least = known[0] if least is None else least if known[0] is None else min(least, known[0])
            index.put(digest, text, (least, n))
            if away:
                gone.append((digest, text, away))
    for digest, text, away in gone:
        least, n = index.get(digest, text)
        if n == away:
            index.delete(digest, text)
        else:
            index.put(digest, text, (least, n - away))
    rows = [(digest, value[0], value[1]) for digest, _, value in index.items()]
    for at in range(0, max(1, len(rows)), 10_000):
        part = rows[at : at + 10_000]
        columns = [pa.array([x[i] for x in part], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["digest", "least", "n"])


def _normal() -> Column:
    return F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _answers(docs: DataFrame, deleted: Column, shards: int | None) -> DataFrame:
    """Each row of ``docs`` as ``doc_id, digest`` with ``keep_id`` and ``n`` of its text, null where none is live."""
    clean = _normal()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(clean, 256)).alias("digest"), F.length(clean).alias("size"))
    own = written(own.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "digests")
    if shards is None:
        shards = max(partitions(docs.sparkSession), (own.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES)
    texts = docs.select(clean.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(deleted, F.lit(False)).alias("gone"))
    texts = texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text", "doc_id", "gone")
    combined = texts.mapInArrow(_combined, "digest binary, text string, least long, n long, gone long")
    dealt = combined.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition(shards, "digest", "part").drop("part")
    live = dealt.mapInArrow(_indexed, "digest binary, least long, n long").groupBy("digest").agg(F.min("least").alias("keep_id"), F.sum("n").alias("n"))
    placed = own.select("digest", "salt").distinct().join(live, "digest")  # a hot text's rows meet its answer in SALTS parts
    return own.join(placed, ["digest", "salt"], "left").select("doc_id", "digest", "keep_id", "n")


def exact_duplicates(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per row of ``docs (doc_id, text, ...)``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are the same after each run of space and tab to
    carriage return has become one space; null is an empty text. The least doc_id
    of equal texts stays. Of rows with one doc_id and equal texts all count as
    kept. A row without doc_id counts in its group; it is kept only if no row of the
    group has a doc_id, and keep_id is null then. Other columns are not read; an
    empty table gives an empty result.

    Each task combines its equal texts; a combined text goes to the shard of its
    digest (in ``SALTS`` parts by task, for a text that a third of all rows share),
    whose index looks it up, verifies hits against the stored text and counts.
    Shards grow in number with the corpus, not in size.
    """
    found = _answers(docs, F.lit(False), shards)
    kept = F.when(F.col("keep_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def live_texts(docs: DataFrame, deleted: Column, shards: int | None = None) -> DataFrame:
    """``doc_id, live, n_live`` of each row of ``docs``: is its text in the index once the rows where ``deleted`` holds have left it?

    Texts compare as in ``exact_duplicates``; ``n_live`` counts the rows that stay. A null condition deletes nothing.
    """
    found = _answers(docs, deleted, shards)
    return found.select("doc_id", F.col("n").isNotNull().alias("live"), F.coalesce("n", F.lit(0)).cast("long").alias("n_live"))

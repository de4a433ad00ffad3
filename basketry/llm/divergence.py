"""How far the sources of a language differ in their words, over a frequent-pattern tree of term rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.storage import written

#: Entries of a task's counts, and nodes of a tree, before they are sent on.
HELD, NODES = 200_000, 1 << 18
#: Bytes of a text that are cut into terms at a time.
SLICE = 1 << 20
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^a-z\x80-\xff]")
_COUNT = "lang string, source string, term string, n long, docs long"


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in slices of about a MB that end where no term runs on."""
    at = 0
    while at < len(text):
        stop = _BREAK.search(text, at + SLICE)
        to = stop.start() if stop else len(text)
        yield text[at:to]
        at = to


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group of a task's rows; a row without a term for each group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            k = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            group = held.get((lang, source))
            if group is None:
                group = held[lang, source] = Counter({b"": 0}), Counter()
            n, docs = group
            before, seen = len(n), set()
            for part in _slices(text.as_py().lower()):
                terms = _TERM.findall(part)
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - before
            if size >= HELD:
                yield from sent()
                held, size = {}, 0
    yield from sent()


def term_rows(docs: DataFrame) -> DataFrame:
    """``(lang, term, docs, row)``: in how many documents of the language a term is, and its nonzero counts by source.

    The row of the empty term lists all sources of the language.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    found = docs.select(*columns).mapInArrow(_counts, _COUNT).repartition("lang", "term")  # both groupings below keep to this
    cells = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("row"))


class PatternTree:
    """A frequent-pattern tree: rows of items, in one order, share the nodes of their common beginnings."""

    def __init__(self):
        self.child: dict[tuple[int, int], int] = {}
        self.parent: list[int] = []
        self.item: list[int] = []
        self.times: list[int] = []

    def insert(self, row: Iterable[int], times: int) -> None:
        node = -1
        for item in row:
            at = self.child.get((node, item))
            if at is None:
                at = self.child[node, item] = len(self.parent)
                self.parent.append(node)
                self.item.append(item)
                self.times.append(0)
            self.times[at] += times
            node = at

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Every node with every one of its ancestors, once: the two items and how many rows pass through; a level of ancestors at a time."""
        parent, item, times = (np.array(x, np.int64) for x in (self.parent, self.item, self.times))
        node, above = np.arange(len(parent)), parent.copy()
        while True:
            node, above = node[above >= 0], above[above >= 0]
            if not len(node):
                return
            yield item[node], item[above], times[node]
            above = parent[above]


def _corrections(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two sources of a language: what the terms that both have add to the sums of the one-sided differences."""
    tree, sums, now = PatternTree(), Counter(), None
    codes: dict[tuple, int] = {}
    sources: dict[str, int] = {}

    def settle() -> None:
        if codes:
            own, p, p0 = (np.array(x, np.int64) for x in zip(*((sources[s], p, p0) for s, p, p0 in codes), strict=True))
            for x, y, times in tree.pairs():
                value = abs(p[x] - p[y]) - abs(p[x] - p0[y]) - abs(p0[x] - p[y]) + abs(p0[x] - p0[y])
                key, place = np.unique(own[x] * len(sources) + own[y], return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, place, value * times)
                names = list(sources)
                for k, v in zip(key.tolist(), total.tolist(), strict=True):
                    sums[names[k // len(names)], names[k % len(names)]] += v
        tree.__init__()
        codes.clear()
        sources.clear()

    def sent() -> pa.RecordBatch:
        settle()
        a, b = ([k[i] for k in sums] for i in (0, 1))
        out = pa.RecordBatch.from_arrays([pa.array([now] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()),
            pa.array(list(sums.values()), pa.int64())], names=["lang", "a", "b", "value"])
        sums.clear()
        return out

    for batch in batches:
        for lang, row, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if lang != now or len(sums) >= HELD:
                yield sent()
                now = lang
            items = []
            for cell in row:
                sources.setdefault(cell["source"], len(sources))
                items.append(codes.setdefault((cell["source"], cell["p"], cell["p0"]), len(codes)))
            tree.insert(items, times)
            if len(tree.parent) >= NODES:
                settle()
    yield sent()


def _share(n: str, size: str, v: str) -> Column:
    """``1 + floor(10^9 (n + 5) / (size + 5 v))`` without rounding; 38 digits hold any count."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * cast({n} + 5 as decimal(20, 0))) div cast(greatest({size} + 5 * {v}, 1) as decimal(20, 0))")


def _one_sided(hist: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each ordered pair: the sum over the first one's terms of how much nearer or farther they are than its unused share.

    ``hist`` has the shares of each source with their numbers of terms. Running sums in the order of the shares
    give the sum of distances to every other source's unused share in one sort.
    """
    seen = hist.select("lang", "source", F.col("p").alias("x"), "m", F.lit(None).cast("string").alias("other"), F.lit(0).cast("long").alias("p0"))
    asked = pairs.select("lang", "source", F.col("other_p0").alias("x"), F.lit(0).cast("long").alias("m"), "other", "p0")
    whole = Window.partitionBy("lang", "source")
    upto = whole.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = seen.union(asked).select("*", F.sum("m").over(upto).alias("m1"), F.sum(F.col("m") * F.col("x")).over(upto).alias("s1"),
        F.sum("m").over(whole).alias("m2"), F.sum(F.col("m") * F.col("x")).over(whole).alias("s2"))
    value = F.expr("x * m1 - s1 + (s2 - s1) - x * (m2 - m1) - m2 * abs(x - p0)")
    return rows.where("other is not null").select("lang", "source", "other", value.alias("value"))


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank`` over ``docs (lang, source, text, ...)``; null counts as ''.

    Terms are runs of letters A-Z (lower-cased), a-z and characters beyond ASCII. A
    language keeps the terms that ``least_docs`` of its rows have. Part ``pair``: for
    each other source of the language the sum of differences of smoothed shares over
    all kept terms (0 where there are none). Part ``term``: the ``top`` kept terms
    whose share in the group most exceeds that in the language. Each row of
    ``docs`` counts as a document, whatever its doc_id; groups without terms are
    groups too, ties go by item, other columns are not read, an empty table gives an
    empty result.

    A kept term's row of nonzero counts, in the order of sources, is inserted in a
    tree of its task's range of rows, equal rows at once. What a pair of sources owes to terms that
    both have is added up once for each node and ancestor; terms that one of them has
    need only the histogram of its shares, all other terms one product.
    """
    rows = written(term_rows(docs).where(f"term = '' or docs >= {int(least_docs)}"), "term-rows")
    kept = rows.where("term <> ''").select("lang", "term", F.expr("aggregate(row, 0L, (s, x) -> s + x.n)").alias("n_lang"), "row")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("size_lang"))
    sizes = kept.select("lang", F.inline("row")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = rows.where("term = ''").select("lang", F.inline("row")).drop("n").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["size", "v", "size_lang"]).withColumn("p0", _share("0", "size", "v"))
    groups = written(groups, "groups")

    cells = kept.select("lang", "term", "n_lang", F.inline("row")).join(groups, ["lang", "source"])
    cells = written(cells.select("lang", "term", "source", "p0", _share("n", "size", "v").alias("p"), _share("n_lang", "size_lang", "v").alias("q")), "cells")

    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    pairs = written(groups.join(other, "lang").where("source <> other").select("lang", "source", "other", "v", "p0", "other_p0"), "pairs")
    one = _one_sided(cells.groupBy("lang", "source", "p").agg(F.count("*").alias("m")), pairs)

    paths = cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("row"))
    paths = paths.groupBy("lang", "row").agg(F.count("*").alias("times")).repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")
    both = paths.mapInArrow(_corrections, "lang string, a string, b string, value long")
    both = both.select("lang", F.col("a").alias("source"), F.col("b").alias("other"), "value")

    def turned(df: DataFrame) -> DataFrame:
        return df.union(df.select("lang", "other", "source", "value"))

    base = pairs.select("lang", "source", "other", F.expr("v * abs(p0 - other_p0)").alias("value"))
    apart = base.union(turned(one)).union(turned(both)).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    above = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    apart = apart.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(order))
    return apart.union(above)

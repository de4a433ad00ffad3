"""Mix overlapping sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.storage import written

#: Up to so many membership patterns are broadcast; more are joined by a shuffle.
BROADCAST_PATTERNS = 10_000
LEVEL = 4096
TAKEN = "(b1 < last_b1 or (b1 = last_b1 and (b2 < last_b2 or (b2 = last_b2 and coalesce(struct(u, doc_id, size) <= last, false)))))"


def capped_targets(sizes: Mapping, weights: Mapping, total: float, cap: float) -> dict:
    """Share ``total`` by weight; a target stops at ``cap`` times its source's size and the others share the excess."""
    open_, targets, left = dict(weights), {}, float(total)
    while open_:
        whole = sum(open_.values())
        over = [x for x in open_ if left * open_[x] / whole >= cap * sizes[x]]
        if not over:
            return targets | {x: left * w / whole for x, w in open_.items()}
        for x in over:
            targets[x] = float(cap * sizes[x])
            del open_[x]
        left = float(total) - sum(targets.values())
    return targets


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int) -> list[int]:
    """Tokens to take of each pattern so that the sources' quotas are met at the least cost of repetition.

    ``capacity[p]`` is the size of pattern p, ``members[p]`` its sources. Each
    further pass over a pattern costs more than the one before (convex), so no
    pattern repeats while another that serves the same quota is unread.

    All cost lies on the edges into the patterns, and it only depends on the pass.
    A cheapest path is then one whose first edge is of the earliest pass, so the
    flow of least cost is found pass by pass: open the pass's edges, then augment
    to the greatest flow (blocking flows on levels).
    """
    patterns, sources = len(capacity), len(quotas)
    room = [0] * patterns  # left on the open passes of each pattern
    flow: list[dict[int, int]] = [dict.fromkeys(own, 0) for own in members]
    served: list[dict[int, int]] = [{} for _ in range(sources)]  # of each source, what each pattern gives it
    left = list(quotas)
    taken = [0] * patterns

    def levels() -> tuple[list[int], list[int], bool]:
        """Distance of each pattern and source from the open capacity; whether an open quota is reached."""
        of_pattern, of_source = [0 if r else -1 for r in room], [-1] * sources
        now, at, open_ = [p for p in range(patterns) if room[p]], 1, False
        while now and not open_:
            met = sorted({s for p in now for s in members[p] if of_source[s] < 0})
            for s in met:
                of_source[s] = at
                open_ |= left[s] > 0
            now = []
            for s in met:
                for p, x in served[s].items():
                    if x and of_pattern[p] < 0:
                        of_pattern[p] = at + 1
                        now.append(p)
            at += 2
        return of_pattern, of_source, open_

    for _ in range(repeats):
        for p in range(patterns):
            room[p] += capacity[p]
        while True:
            of_pattern, of_source, open_ = levels()
            if not open_:
                break
            tries_p = [iter(own) for own in members]
            tries_s = [iter(list(served[s])) for s in range(sources)]
            current_p, current_s = [next(t, None) for t in tries_p], [next(t, None) for t in tries_s]
            for start in range(patterns):
                while room[start] and of_pattern[start] == 0:
                    path = [start]  # pattern, source, pattern, source ...
                    while path:
                        if len(path) % 2:
                            p, s = path[-1], current_p[path[-1]]
                            if s is None:
                                path.pop()
                                if path:
                                    current_s[path[-1]] = next(tries_s[path[-1]], None)
                            elif of_source[s] == of_pattern[p] + 1:
                                path.append(s)
                                if left[s]:
                                    break
                            else:
                                current_p[p] = next(tries_p[p], None)
                        else:
                            s, q = path[-1], current_s[path[-1]]
                            if q is None:
                                path.pop()
                                current_p[path[-1]] = next(tries_p[path[-1]], None)
                            elif of_pattern[q] == of_source[s] + 1 and served[s].get(q, 0):
                                path.append(q)
                            else:
                                current_s[s] = next(tries_s[s], None)
                    if not path:
                        break
                    amount = min(room[start], left[path[-1]], *[served[path[i]][path[i + 1]] for i in range(1, len(path) - 1, 2)])
                    for i in range(0, len(path), 2):
                        flow[path[i]][path[i + 1]] += amount
                        served[path[i + 1]][path[i]] = served[path[i + 1]].get(path[i], 0) + amount
                    for i in range(1, len(path) - 1, 2):
                        flow[path[i + 1]][path[i]] -= amount
                        served[path[i]][path[i + 1]] -= amount
                    room[start] -= amount
                    left[path[-1]] -= amount
                    taken[start] += amount
    return taken


def _cuts(docs: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """The last document to take of each pattern, in seeded order, before sizes pass ``need``, and one more that fits the gap best.

    Two levels of histogram over the order find the small range where the sum
    crosses, so no task holds a pattern's documents. Rows that are equal in the
    order are taken together or not at all. ``small``: there are few patterns, each
    of which may hold a third of the rows.
    """
    near = F.broadcast if small else lambda rows: rows

    def crossing(rows: DataFrame, level: str, base: str, more: list) -> DataFrame:
        sums = rows.groupBy("pattern", "need", *more, level).agg(F.sum("size").alias("s"))
        before = f"{base} + sum(s) over (partition by pattern order by {level}) - s"
        at = sums.withColumn("before", F.expr(before)).where("before <= need")
        last = F.max(level).alias(f"last_{level}"), F.max("before").alias(f"before_{level}")
        return at.groupBy("pattern", "need", *[c for c in more if c != base]).agg(*last)

    first = crossing(docs.join(near(wanted), "pattern"), "b1", "0L", [])
    second = crossing(docs.join(near(first), "pattern").where("b1 = last_b1"), "b2", "before_b1", ["last_b1", "before_b1"])
    inside = docs.join(near(second), "pattern").where("b1 = last_b1 and b2 = last_b2")
    peers = inside.groupBy("pattern", "need", "before_b2", "u", "doc_id", "size").agg(F.sum("size").alias("own"))
    upto = F.expr("before_b2 + sum(own) over (partition by pattern order by u, doc_id, size)")
    last = F.max(F.struct("u", "doc_id", "size")).alias("last"), F.max("upto").alias("upto")
    taken = peers.withColumn("upto", upto).where("upto <= need").groupBy("pattern").agg(*last)
    gap = (F.col("need") - F.coalesce("upto", "before_b2")).alias("gap")
    cuts = written(second.join(taken, "pattern", "left").select("pattern", "last_b1", "last_b2", "last", gap), "cuts")
    after = docs.join(near(cuts), "pattern").where(f"size > 0 and not {TAKEN}")
    after = after.groupBy("pattern", "gap", "u", "doc_id", "size").agg(F.sum("size").alias("own")).where("abs(gap - own) < gap")
    more = F.struct(F.abs(F.col("gap") - F.col("own")).alias("off"), "u", "doc_id", "size")
    return cuts.join(after.groupBy("pattern").agg(F.min(more).alias("more")), "pattern", "left")


def _source_key(name: str | None) -> tuple[bool, bytes]:
    return name is None, (name or "").encode()


def with_passes(docs: DataFrame, memberships: Column, weights: Mapping[str | None, float] | Sequence[float], share: float = 1.5, cap: float = 2.0,
    seed: int = 0) -> DataFrame:
    """``docs (doc_id, text, ...)`` with one more column, the struct ``mix``: ``size, source_size, target, passes``.

    No row is lost or repeated: what the mix takes is worked out from sums, and each
    row finds its answer by its own columns. Columns of ``docs`` keep their names,
    also those named like the columns here; only ``mix`` must not be one of them.
    See ``mix`` for the rules.
    """
    if cap != int(cap):
        raise ValueError("cap counts whole passes")
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    names = F.array_sort(F.array_distinct(memberships))
    u = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)))
    key = F.struct(
        F.coalesce(F.to_json(names), F.lit("null")).alias("pattern"),  # a hash of the array would skip its nulls
        u.alias("u"),
        F.pmod(u, F.lit(LEVEL)).alias("b1"),
        F.pmod(F.shiftright(u, 12), F.lit(LEVEL)).alias("b2"),
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
    )
    own = written(docs.select(key.alias("k"), names.alias("memberships")).select("k.*", "memberships"), "sizes")
    table = own.groupBy("pattern").agg(F.first("memberships").alias("memberships"), F.sum("size").alias("size")).collect()
    table = sorted(table, key=lambda r: [_source_key(x) for x in r.memberships or []])
    sources = sorted({s for r in table for s in r.memberships or []}, key=_source_key)
    place = {s: i for i, s in enumerate(sources)}
    sizes = dict.fromkeys(sources, 0)
    for r in table:
        for s in r.memberships or []:
            sizes[s] += r["size"]
    by = {s: weights[s] if isinstance(weights, Mapping) else weights[i % len(weights)] for s, i in place.items()}
    targets = capped_targets(sizes, by, share * sum(r["size"] for r in table), cap)
    members = [[place[s] for s in r.memberships or []] for r in table]
    flows = min_cost_flow([r["size"] for r in table], members, [round(targets[s]) for s in sources], int(cap))
    rows = []
    for r, flow in zip(table, flows, strict=True):
        first = (r.memberships or [None])[0] if r.memberships else ""
        whole = flow // r["size"] if r["size"] else 0
        known = first in sizes and bool(r.memberships)
        rows.append((r.pattern, sizes[first] if known else 0, float(targets[first]) if known else 0.0, whole, flow - whole * r["size"]))
    wanted = docs.sparkSession.createDataFrame(rows, "pattern string, source_size long, target double, whole long, need long")
    small = len(rows) <= BROADCAST_PATTERNS
    cuts = _cuts(own, wanted.select("pattern", "need"), small).drop("need")
    wanted = written(wanted.join(cuts, "pattern", "left"), "wanted")
    if small:
        wanted = F.broadcast(wanted)
    answer = wanted.select(F.col("pattern").alias("mix_pattern"), F.struct(*wanted.columns).alias("mix_answer"))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k"))
    found = found.join(answer, F.col("k.pattern") == F.col("mix_pattern"), "left").select("row", "k.*", "mix_answer.source_size", "mix_answer.target",
        "mix_answer.whole", "mix_answer.need", "mix_answer.last_b1", "mix_answer.last_b2", "mix_answer.last", "mix_answer.more")
    extra = f"need > 0 and ({TAKEN} or (doc_id <=> more.doc_id and u = more.u and size = more.size))"
    passes = F.expr(f"if(size > 0, whole + if(coalesce({extra}, false), 1, 0), 0)").cast("long").alias("passes")
    return found.select("row.*", F.struct("size", "source_size", "target", passes).alias("mix"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | Sequence[float], share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """One row per row of ``docs (doc_id, text, memberships, ...)``: ``doc_id, size, source_size, target, taken, passes``.

    ``memberships`` is an array of source names (null is a name too, apart from a
    null array); a document without any is taken by none and has target 0. Size is
    the number of words, runs of bytes other than space and tab to carriage return;
    null texts have none. ``weights`` maps sources to weights, or repeats along the
    sources in code-point order, null last. All sources share ``share`` times all
    sizes, each up to ``cap`` (whole) times its own size. ``source_size`` and
    ``target`` are those of the first membership. ``passes`` says how often the
    document is taken, ``taken`` = passes * size, never above ``cap`` times size.
    Documents of no words are never taken. The order is seeded by doc_id, for rows
    without one by their text, so reruns agree; repeated rows, equal in both and in
    size, are taken together or not at all. An empty table gives an empty result.
    Other columns are not read.

    One row of sums for each membership pattern reaches the driver, so its memory
    grows with the distinct combinations of sources, not with the documents.
    """
    named = with_passes(docs.select("doc_id", "text", "memberships"), F.col("memberships"), weights, share, cap, seed)
    taken = (F.col("mix.passes") * F.col("mix.size")).alias("taken")
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), "mix.size", "mix.source_size", "mix.target", taken, "mix.passes")


def repeated(docs: DataFrame, memberships: Column, weights: Mapping[str | None, float] | Sequence[float], share: float = 1.5, cap: float = 2.0,
    seed: int = 0) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it, with all of its columns; rows of no pass go."""
    named = with_passes(docs.select(F.struct("*").alias("row"), "doc_id", "text", memberships.alias("of")), F.col("of"), weights, share, cap, seed)
    turns = F.explode(F.sequence(F.lit(1), F.col("mix.passes").cast("int")))
    return named.where("mix.passes > 0").select("row", turns.alias("turn")).select("row.*")

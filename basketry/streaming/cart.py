"""The cart as a stream: keyed state, the same fold as in batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from basketry.sources.storage import new_path

#: Parts that a cart's lines are dealt to; a clear goes to all of them, and each part costs its own calls on the state.
PARTS = 4
OUT = "cart_id long, item long, quantity int, price double, name string, step long"
STORE = "spark.sql.streaming.stateStore.providerClass"


def fold_line(state: tuple, action: str, price: float | None, name: str | None) -> tuple:
    """One event on a line's (quantity, price, name)."""
    quantity, own, label = state
    if action == "remove":
        return 0, None, None
    if action == "add":
        return (quantity + 1, own, label) if quantity > 0 else (1, price, name)
    if quantity <= 0:
        return 0, None, None
    quantity += {"increment": 1, "decrement": -1}.get(action, 0)
    return (quantity, own, label) if quantity > 0 else (0, None, None)


def fold_lines(lines: dict[str, tuple], events: list[tuple]) -> dict[str, tuple]:
    """The live lines after ``events (item, action, price, name)``, in their order."""
    out = dict(lines)
    for item, action, price, name in events:
        if action == "clear":
            out = {}
            continue
        line = fold_line(out.get(item, (0, None, None)), action, price, name)
        if line[0] > 0:
            out[item] = line
        else:
            out.pop(item, None)
    return out


class CartPart(StatefulProcessor):
    """A part of a cart's lines as keyed state: a batch reads and writes only the lines that its events touch.

    ``lines`` maps an item to what events behind the watermark have made of it,
    ``waiting`` a seq to an event that may still be overtaken, ``seen`` holds the last
    seq that was folded for good and how often the part has changed. What comes before the
    latest clear can change nothing and does not wait; what the watermark has passed does not
    either. A part without lines and waiting events keeps nothing. Each call on the state is a
    message to the executor, so what cannot be there is not asked for.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "item string", "quantity int, price double, name string")
        self.waiting = handle.getMapState("waiting", "seq string", "at long, item string, action string, price double, name string")
        self.seen = handle.getValueState("seen", "applied string, step long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.seen.get()
        applied, step = held or ("", 0)
        known = self._waiting() if held else {}
        new = {r.seq: (r.at, "" if r["item"] is None else str(r["item"]), r.action, r.price, r.name) for r in rows if r.seq > applied and r.seq not in known}
        cleared = max((seq for events in (known, new) for seq, event in events.items() if event[2] == "clear"), default="")
        new = {seq: event for seq, event in new.items() if seq >= cleared}
        if not new:
            return
        touched = {e[1] for e in new.values() if e[2] != "clear"}
        start: dict[str, tuple] = {}
        if cleared in new:
            start = {item: tuple(line) for (item,), line in self.lines.iterator()} if applied else {}
            touched |= start.keys() | {e[1] for e in known.values() if e[2] != "clear"}
        elif not cleared:
            start = self._lines(touched, applied)
        alive = {seq: event for seq, event in (known | new).items() if seq >= cleared}
        before, after = (fold_lines(start, _in_order(e, touched)) for e in (known, alive))
        self._settle(known, alive, held, step + 1, timerValues.getCurrentWatermarkInMs())
        for item in sorted(touched):
            if before.get(item) != after.get(item):
                quantity, price, name = after.get(item, (0, None, None))
                yield Row(cart_id=key[0], item=int(item) if item else None, quantity=quantity, price=price, name=name, step=step + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        """What waited is folded for good; it was shown before, so nothing changes."""
        held, known = self.seen.get(), self._waiting()
        self._settle(known, known, held, held[1] if held else 0, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def _waiting(self) -> dict[str, tuple]:
        return {seq: tuple(event) for (seq,), event in self.waiting.iterator()}

    def _lines(self, items: set[str], applied: str) -> dict[str, tuple]:
        """The lines of ``items``; none are there before anything was folded for good."""
        return {item: tuple(line) for item in sorted(items) if (line := self.lines.getValue((item,))) is not None} if applied else {}

    def _settle(self, stored: dict[str, tuple], waiting: dict[str, tuple], held: tuple | None, step: int, upto: int) -> None:
        """Fold the events behind the watermark into their lines; of ``waiting`` the others are kept, and of those ``stored`` before no more."""
        applied = held[0] if held else ""
        done = {seq: event for seq, event in waiting.items() if event[0] < upto}
        rest = {seq: event for seq, event in waiting.items() if seq not in done}
        gone = stored.keys() - rest.keys()
        if gone and len(gone) == len(stored):
            self.waiting.clear()
        else:
            for seq in gone:
                self.waiting.removeKey((seq,))
        for seq in rest.keys() - stored.keys():
            self.waiting.updateValue((seq,), rest[seq])
        emptied = any(e[2] == "clear" for e in done.values())
        touched = {e[1] for e in done.values() if e[2] != "clear"}
        start = {} if emptied else self._lines(touched, applied)
        left = fold_lines(start, _in_order(done, touched))
        if emptied and applied:
            self.lines.clear()
        for item in touched:
            if item in left:
                self.lines.updateValue((item,), left[item])
            elif item in start:
                self.lines.removeKey((item,))
        if rest:
            wake = max(upto, *(event[0] for event in rest.values())) + 1
            if not held or wake not in set(self.handle.listTimers()):
                self.handle.registerTimer(wake)
        elif not left and (emptied or not applied or not any(True for _ in self.lines.keys())):
            if held:
                self.seen.clear()
            return
        self.seen.update((max(applied, *done) if done else applied, step))


def _in_order(events: dict[str, tuple], items: set[str]) -> list[tuple]:
    """Events of the items, and clears, in order of seq: ``(item, action, price, name)``."""
    return [events[seq][1:] for seq in sorted(events) if events[seq][2] == "clear" or events[seq][1] in items]


def cart_changes(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """State changes of a stream ``(ts, cart_id, item, seq, action, price, name)``; ``seq`` is text that sorts in the order of ``ts``.

    Events wait until the watermark, ``delay`` behind the latest ``ts``, has passed
    them, and are then folded in order of ``seq`` for good; what is shown in between
    has the waiting ones folded in too, so it is always in order, however events
    arrive within the delay. Later ones are dropped, and so is one whose seq has
    been seen, in the same batch or another. A clear empties the whole cart.
    A cart without lines and waiting events has no state.
    """
    part = F.pmod(F.xxhash64("item"), F.lit(PARTS)).cast("int")
    parts = F.when(F.col("action") == "clear", F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(part))
    rows = events.withWatermark("ts", delay).withColumn("part", F.explode(parts)).withColumn("at", F.unix_millis("ts"))
    rows = rows.select("ts", "cart_id", "part", "at", F.col("item").cast("long").alias("item"), "seq", "action", F.col("price").cast("double").alias("price"), "name")
    return rows.groupBy("cart_id", "part").transformWithState(CartPart(), OUT, "update", "eventTime")


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which reads and writes single keys."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def run_to_table(spark: SparkSession, events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Run the stream over all input that is there and return the live lines, from the last change of each."""
    out, check = new_path(spark, "cart-changes"), new_path(spark, "cart-stream")

    def save(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(out)

    with keyed_store(spark):
        cart_changes(events, delay).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation",
            check).trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(OUT + ", batch long").parquet(out)
    last = changes.groupBy("cart_id", "item").agg(F.max_by(F.struct("quantity", "price", "name"), F.struct("batch", "step")).alias("s"))
    return last.select("cart_id", "item", "s.quantity", "s.price", "s.name").where("quantity > 0")

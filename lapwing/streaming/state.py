"""Keyed streaming state: a user's weights and patterns, and reading sessions with expiry.

Events reach a key in any order within the watermark's delay. They are held in a list state and folded, in event order, once
the watermark has passed them; a timer wakes the key for that. What is held is no more than a key's events of one delay, and
what is folded is a small state row (items of a session are a map state) in RocksDB. Events older than the watermark are
dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lapwing.functions.tuner import Fold, resumed, start

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Holds events back until the watermark has passed them. The first columns of `held` are the time in microseconds and
    the event's id, by which `fold` gets them sorted."""

    held = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("held", self.held)
        self.names = [field.split()[0] for field in self.held.split(", ")]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = [tuple(None if x is None or x != x else x for x in row) for row in frame[self.names].itertuples(index=False, name=None)]
            self.waiting.appendList(new)
            self.wake(min(row[0] for row in new) // 1000, timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        every = list(self.waiting.get())
        due = sorted((row for row in every if row[0] // 1000 < mark), key=lambda row: row[:2])
        later = [row for row in every if row[0] // 1000 >= mark]
        if due and later:
            self.waiting.put(later)
        elif due:
            self.waiting.clear()
        if later:
            self.wake(min(row[0] for row in later) // 1000, mark)
        yield from self.fold(key, due, mark)

    def wake(self, at: int, mark: int) -> None:
        """Wake this key once the watermark has passed `at` (milliseconds). Timers before the watermark `mark` do not help:
        they ring in this batch, the ringing one included."""
        if not any(mark <= timer <= at for timer in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def fold(self, key, due: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class ProfileProcessor(InOrder):
    """Weights and patterns of a user, moved by ratings and interactions in one order; the fold is that of the batch form."""

    held = "at long, event_id long, action string, value double, label string"
    KEYS = {
        "lambda": "double", "alpha": "double", "beta": "double", "confidence": "double", "feedback_count": "long",
        "avg_dwell_time": "double", "skip_rate": "double", "category_switches": "long", "total_interactions": "long",
    }

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("profile", ", ".join(f"{k} {t}" for k, t in self.KEYS.items()) + ", last string, clicked boolean")

    def fold(self, key, due, mark) -> Iterator[pd.DataFrame]:
        if not due:
            return
        *values, last, clicked = self.state.get() or (*start().values(), None, False)
        state = dict(zip(self.KEYS, values))
        piece = Fold(key[0], state["total_interactions"], state["feedback_count"], (last,) if clicked else None)
        for _, _, action, value, label in due:
            piece.add(action, value if value is not None else float("nan") if action == "rate" else 0.0, label)
        state = resumed(state, piece.summary())
        self.state.update((*(state[k] for k in self.KEYS), piece.last[0] if piece.last else None, piece.last is not None))
        yield pd.DataFrame({"user_id": [key[0]], **{k: [state[k]] for k in self.KEYS}})


PROFILE_SCHEMA = "user_id long, " + ", ".join(f"{k} {t}" for k, t in ProfileProcessor.KEYS.items())


def keyed(events: DataFrame, delay: str):
    return events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay).groupBy("user_id")


def profile_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """events (user_id, ts, event_id, action, value, label), as for `operators.personal.personal_state`, to updated profiles."""
    return keyed(events, delay).transformWithStateInPandas(ProfileProcessor(), PROFILE_SCHEMA, "Update", "EventTime")


class SessionProcessor(InOrder):
    """Reading session: items in first-read order, clicks counted, reset to the seed history, expiry after 24 h of silence.

    Events: seed (the item joins the history and the seed history), click, reset (the history becomes the seed history
    again). The item list is a map state, so a long session is never rewritten as a whole, except by a reset: a fold reads
    the items it meets, and writes each of them that changed once.
    """

    held = "at long, event_id long, action string, item_id long"

    def __init__(self, with_history: bool = False):
        self.with_history = with_history

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.items = handle.getMapState("items", "item_id long", "ord long, seed long")
        self.meta = handle.getValueState("meta", "clicked long, size long, next long, seeds long, last long")

    def met(self, due: list[tuple], size: int) -> dict:
        """(ord, seed) of the items that a fold needs, by item: of a short session all in one read, of a long one those of
        `due`; with None for items it does not have."""
        read = {item for *_, item in due}
        if not size or not read:
            return dict.fromkeys(read)
        if size <= 4 * len(read) or any(action == "reset" for _, _, action, _ in due):
            return dict.fromkeys(read) | {item: tuple(entry) for (item,), entry in self.items.iterator()}
        return {item: tuple(entry) if (entry := self.items.getValue((item,))) is not None else None for item in read}

    def fold(self, key, due, mark) -> Iterator[pd.DataFrame]:
        fresh = (0, 0, 0, 0, None)
        clicked, size, next_, seeds, last = self.meta.get() or fresh
        if last is None and not due:
            return
        items = self.met(due, size)
        before = {item: entry for item, entry in items.items() if entry is not None}
        for at, _, action, item in due:
            if last is not None and at - last > DAY_MS * 1000:  # the watermark came past the gap and this event at once
                self.items.clear()
                items, before = dict.fromkeys(items), {}
                clicked, size, next_, seeds, last = fresh
            last = at
            if action == "reset":
                items = {read: (entry[1], entry[1]) if entry is not None and entry[1] >= 0 else None for read, entry in items.items()}
                clicked, size, next_ = 0, seeds, seeds
                continue
            ord_, seed = items.get(item) or (None, -1)
            if ord_ is None or (action == "seed" and seed < 0):
                if action == "seed":
                    seed, seeds = seeds, seeds + 1
                if ord_ is None:
                    ord_, next_, size = next_, next_ + 1, size + 1
                items[item] = (ord_, seed)
            clicked += action == "click"
        for item, entry in items.items():
            if entry is None and item in before:
                self.items.removeKey((item,))
            elif entry is not None and entry != before.get(item):
                self.items.updateValue((item,), entry)
        over = last // 1000 + DAY_MS < mark
        if due or over:
            yield self._row(key, clicked, size, last, over)
        if over:
            self.items.clear()
            self.meta.clear()
        else:
            self.meta.update((int(clicked), size, next_, seeds, last))
            self.wake(last // 1000 + DAY_MS, mark)

    def _row(self, key, clicked, size, last, expired) -> pd.DataFrame:
        row = {"user_id": [key[0]], "history_size": [size], "clicked_count": [clicked], "last_accessed": [pd.Timestamp(last, unit="us")], "expired": [expired]}
        if self.with_history:
            row["history"] = [[item for _, item in sorted((ord_, item) for (item,), (ord_, _) in self.items.iterator())]]
        return pd.DataFrame(row)


SESSION_SCHEMA = "user_id long, history_size long, clicked_count long, last_accessed timestamp, expired boolean"


def session_stream(events: DataFrame, delay: str = "1 hour", with_history: bool = False) -> DataFrame:
    """events (user_id, ts, event_id, action, item_id) to session rows; expired sessions come once with expired.

    `with_history` adds the items of the session in order.
    """
    rows = events.withColumn("item_id", F.coalesce("item_id", F.lit(-1).cast("bigint")))
    schema = SESSION_SCHEMA + (", history array<long>" if with_history else "")
    return keyed(rows, delay).transformWithStateInPandas(SessionProcessor(with_history), schema, "Update", "EventTime")


def session_window_stream(events: DataFrame, gap: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """Closed activity sessions (append mode): a session is final once the watermark passes its gap."""
    windows = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("session_start"), F.max("ts").alias("last_event")).drop("w")


class ReadProcessor(StatefulProcessor):
    """Items that a user has clicked in any batch; a user's map grows with the catalogue at most."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item_id long", "known boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for item in frame["item_id"].dropna().unique():
                self.items.updateValue((int(item),), (True,))
        yield pd.DataFrame({"user_id": [key[0]], "items": [[item for (item,) in self.items.keys()]]})

    def close(self) -> None:
        pass


def feed_updates(clicks: DataFrame, candidates: DataFrame, rerank, path: str, checkpoint: str):
    """Start a stream that re-ranks the prepared candidates of the users who clicked and appends their feeds.

    `rerank(candidates) -> DataFrame` is any method of lapwing.operators.rerank bound to its context. Items clicked in this
    or any earlier batch fall out first: they are kept as state of the user, so a batch reads only what its users
    clicked. Each batch writes a folder of its own, which a retried batch overwrites.
    """
    use_rocksdb(clicks.sparkSession)

    def update(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}_clicked/batch={batch_id}")  # the state is read once
        users = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}_clicked/batch={batch_id}").withColumnRenamed("user_id", "impression_id")
        mine = candidates.join(users.select("impression_id"), "impression_id", "left_semi")
        seen = users.select("impression_id", F.explode("items").alias("item_id"))
        fresh = mine.join(seen, ["impression_id", "item_id"], "left_anti")
        rerank(fresh).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    clicked = clicks.where(F.col("user_id").isNotNull()).select("user_id", "item_id").groupBy("user_id").transformWithStateInPandas(ReadProcessor(), "user_id long, items array<long>", "Update", "None")
    return clicked.writeStream.outputMode("update").foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Process everything available; each micro-batch overwrites its own folder, so a retried batch stays exact."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, key: str = "user_id") -> DataFrame:
    """Newest row per key of a table written by `run_to_table`."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(key, "r.*")



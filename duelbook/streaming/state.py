"""Keep-first as a stateful stream: which keys were seen is state, not a look at the table.

Keys are dealt by hash into shards. The processor has one value for each shard, the open keys with the times of their first rows, and
a timer at the first of them to end; a key is closed when the watermark is ``late`` past its time. So a batch asks for state once
a shard it touches, not several times a key. It marks every row: ``first`` of its key, a ``repeat`` (one row with their number for
each key and batch), or ``late`` if it is behind the watermark and its key is not open. A late row may be a repeat of a key whose state
has gone, or a key never seen: it is set aside with the batch and compared exactly with the store, by the store's filters.

State is bounded by the keys whose first row is less than ``late`` behind the watermark, whatever the table holds. A key that comes
again later than that, with a newer time, is compared by the store's filters as well, so the table has one row for each key.
The number of shards belongs to a checkpoint and cannot change under it: a shard's open keys, and its first rows in a batch, are held by one task.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from duelbook.session import cut
from duelbook.sources.store import KeyedStore

# the processor is sent by value, so the workers need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIRST, REPEAT, LATE = "first", "repeat", "late"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


SHARDS = 1 << 14
#: keys as texts that are equal if the keys are
_TEXT = {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class KeepFirst(StatefulProcessor):
    """Marks the rows of the keys of a shard; ``order`` names the columns that decide between rows of one time."""

    def __init__(self, names: list[str], order: list[str], late_ms: int):
        self.names, self.order, self.late_ms = names, order, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "at string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 (Spark calls them by these names)
        behind, held = timerValues.getCurrentWatermarkInMs(), self._held()
        before, told = self._ends(held), Row(*self.names, "kind", "n")
        best, repeats, fields = {}, {}, None
        for row in rows:
            if fields is None:
                fields = row.__fields__
                at_, key_, names, order = fields.index("_at"), fields.index("_key"), [fields.index(c) for c in self.names], [fields.index(c) for c in self.order]
            own, at = row[key_], row[at_]
            if own in held:
                repeats[own] = repeats.get(own, 0) + 1
            elif at is None or at < behind:
                yield told(*[row[i] for i in names], LATE, 1)
            else:
                place = (at, *((row[i] is not None, row[i]) for i in order))
                known = best.get(own)
                if known is not None:
                    repeats[own] = repeats.get(own, 0) + 1
                if known is None or place < known[0]:
                    best[own] = (place, row)
        for own, (place, row) in best.items():
            held[own] = place[0]
            yield told(*[row[i] for i in names], FIRST, 1)
        if best:
            self._hold(held, before)
        for n in repeats.values():
            yield told(*[None] * len(self.names), REPEAT, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        behind, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        self._hold({own: at for own, at in self._held().items() if at + self.late_ms >= behind and at + self.late_ms != fired}, None)
        return iter(())

    def close(self) -> None:
        pass

    def _held(self) -> dict[str, int]:
        found = self.opened.get()
        return json.loads(found[0]) if found is not None else {}

    def _ends(self, held: dict[str, int]) -> int | None:
        return min(held.values()) + self.late_ms if held else None

    def _hold(self, held: dict[str, int], timer: int | None) -> None:
        """Keeps the open keys, and the timer at the first of them to end; ``timer`` is the one that stands."""
        ends = self._ends(held)
        if held:
            self.opened.update((json.dumps(held, ensure_ascii=False, separators=(",", ":")),))
        else:
            self.opened.clear()
        if ends != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if ends is not None:
                self.handle.registerTimer(ends)


def marked(stream: DataFrame, key: list[str], event_time: str, order: list[str], late: str = "1 day", shards: int = SHARDS) -> DataFrame:
    """The first rows, late rows and numbers of repeats of a stream, with ``kind`` and ``n``. Needs the RocksDB state store."""
    delay = int(stream.sparkSession.sql(f"select unix_millis(timestamp_seconds(0) + interval {late})").first()[0])
    names = stream.columns
    # the time goes on as a plain number: a watermarked column would have late rows dropped before they are marked
    timed = stream.withColumn("_time", F.col(event_time)).withWatermark("_time", late)
    # zeros of either sign are one key
    parts = [F.col(c) + F.lit(0.0) if isinstance(stream.schema[c].dataType, T.FractionalType) and not isinstance(stream.schema[c].dataType, T.DecimalType) else F.col(c) for c in key]
    own = F.to_json(F.struct(*[c.alias(str(i)) for i, c in enumerate(parts)]), _TEXT)
    plain = timed.select(*names, F.unix_millis("_time").alias("_at"), own.alias("_key"))
    dealt = plain.withColumn("_shard", F.pmod(F.xxhash64("_key"), F.lit(shards)).cast("int"))
    out = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema.fields] + [T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())])
    return dealt.groupBy("_shard").transformWithState(KeepFirst(names, order, delay), out, "Append", "EventTime")


def run_to_store(stream: DataFrame, store: KeyedStore, checkpoint: str, event_time: str, order: list[str], late: str = "1 day") -> None:
    """Appends the first row of each key to the store, batch by batch, until all that has landed is processed.

    What a batch sets aside (late rows, numbers of repeats) is committed with it; its late rows are then compared with the
    store and appended if their key is new. A replayed batch finds what it has committed.
    """
    spark = stream.sparkSession

    def append(batch: DataFrame, number: int) -> None:
        rows = cut(batch)  # the state is run through once
        data, places = rows.drop("kind", "n"), [F.col(event_time), *[F.col(c) for c in order]]
        store.append(f"stream-{number}-first", data.where(rows["kind"] == FIRST), places, rows.where(F.col("kind") != FIRST))
        store.append(f"stream-{number}-late", data.where(rows["kind"] == LATE), places)

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = (
            marked(stream, store.key, event_time, order, late).writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    query.awaitTermination()


def told(store: KeyedStore) -> DataFrame:
    """(kind, rows) of what the stream has set aside."""
    aside = T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())])
    return store.set_aside(aside).groupBy("kind").agg(F.sum("n").alias("rows"))

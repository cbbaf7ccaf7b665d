"""A registry of values by namespace and name over a stream of operations, in keyed state that survives restarts.

Operations (namespace, ts, seq, op, name, backend, value) register a value, look a name up or clear a namespace. They wait in state
until the watermark has passed them and are then applied in the order of (ts, seq), so that any order of arrival within the
watermark's delay gives what a batch gives. A namespace holds entries of one backend: registering for another one raises
until it is cleared.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.guards import require

REGISTER, LOOK_UP, CLEAR = "register", "look up", "clear"
ANSWERS = "namespace string, seq long, name string, value string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Operations of a run, which are sorted in memory, and of a page of it, of which there is one in memory for each run.
RUN, PAGE = 20_000, 500
#: Entries that are in memory at most while operations are applied.
KNOWN = 10_000


class _Registry(StatefulProcessor):
    """Waiting operations are sorted runs in pages of JSON; those that the watermark has passed are merged from all runs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "run long, page long", "operations string")
        self.runs = handle.getMapState("runs", "run long", "page long, row long, pages long, at long")  # where its first waiting operation is
        self.count = handle.getValueState("count", "runs long")
        self.timer = handle.getValueState("timer", "at long")
        self.backend = handle.getValueState("backend", "backend string")
        self.entries = handle.getMapState("entries", "name string", "value string")

    def _wake(self, at: int) -> None:
        """One timer a namespace, at its earliest waiting operation."""
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        while new := sorted(((int(r.ts.timestamp() * 1_000_000), r.seq, r.op, r.name, r.backend, r.value) for r in islice(rows, RUN)), key=lambda r: r[:2]):
            run = self.count.get()[0] if self.count.exists() else 0
            self.count.update((run + 1,))
            for first in range(0, len(new), PAGE):
                self.pages.updateValue((run, first // PAGE), (json.dumps(new[first : first + PAGE]),))
            self.runs.updateValue((run,), (0, 0, -(-len(new) // PAGE), new[0][0]))
            self._wake(new[0][0] // 1000)
        return iter(())

    def _due(self, run: int, page: int, row: int, pages: int, passed: int) -> Iterator[list]:
        """A run's operations before ``passed``, in order; they leave the state, and the run begins with the next one."""
        while page < pages:
            own = json.loads(self.pages.getValue((run, page))[0])
            for n in range(row, len(own)):
                if own[n][0] >= passed:
                    self.runs.updateValue((run,), (page, n, pages, own[n][0]))
                    return
                yield own[n]
            self.pages.removeKey((run, page))
            page, row = page + 1, 0
        self.runs.removeKey((run,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        runs = [(k[0], *v) for k, v in self.runs.iterator()]
        due = heapq.merge(*(self._due(run, page, row, pages, passed) for run, page, row, pages, at in runs if at < passed), key=lambda r: r[:2])
        holder = self.backend.get()[0] if self.backend.exists() else None
        known: dict[Any, tuple | None] = {}  # entries as they are now (None: not there), of which state lacks the changed ones
        changed: set[Any] = set()
        cleared = False

        def keep() -> None:
            nonlocal cleared
            if cleared:
                self.entries.clear()
            for name in changed:
                self.entries.updateValue((name,), known[name])
            known.clear()
            changed.clear()
            cleared = False

        for _, seq, op, name, backend, value in due:
            if len(known) >= KNOWN:
                keep()
            if op == REGISTER:
                if holder is not None and holder != backend:
                    raise ValueError(f"namespace {key[0]} holds entries of {holder}, not {backend}")
                holder, known[name] = backend, (value,)
                changed.add(name)
            elif op == CLEAR:
                holder, cleared = None, True
                known.clear()
                changed.clear()
            else:
                if name not in known:
                    known[name] = tuple(self.entries.getValue((name,))) if not cleared and self.entries.containsKey((name,)) else None
                found = known[name]
                yield Row(namespace=key[0], seq=seq, name=name, value=found[0] if found else None)
        keep()
        if holder is None:
            self.backend.clear()
        else:
            self.backend.update((holder,))
        waiting = [v[3] for _, v in self.runs.iterator()]
        if waiting:
            self._wake(max(min(waiting) // 1000, passed // 1000 + 1))
        else:
            self.count.clear()

    def close(self) -> None:
        pass


def streamed_answers(operations: DataFrame, late: str = "1 hour") -> DataFrame:
    """Answers to the look-ups of a stream, once the watermark has passed them: namespace, seq, name, value (null: not there)."""
    spark = operations.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    own = operations.select("namespace", F.col("ts").cast("timestamp").alias("ts"), "seq", "op", "name", "backend", "value").withWatermark("ts", late)
    return own.groupBy("namespace").transformWithState(_Registry(), ANSWERS, "append", "eventTime")


def batch_answers(operations: DataFrame) -> DataFrame:
    """The same for a table: each look-up sees the last registration of its name since the namespace was cleared last. No window
    holds more than one name's operations, the clearings, which are spread by range, aside."""
    own = operations.where(F.col("op") != CLEAR).select("namespace", "ts", "seq", "op", "name", "backend", "value")
    order = F.struct("ts", "seq")
    cleared = operations.where(F.col("op") == CLEAR).select(F.col("namespace").alias("c_namespace"), order.alias("c_at")).distinct()
    era = own.select("namespace", order.alias("at"), F.lit(None).cast(cleared.schema["c_at"].dataType).alias("mark"), "op", "name", "backend", "value", "seq")
    names = own.select("namespace", "name").distinct()
    marks = cleared.join(names, F.col("c_namespace") == F.col("namespace")).select("namespace", F.col("c_at").alias("at"), F.col("c_at").alias("mark"), F.lit(CLEAR).alias("op"), "name", F.lit(None).cast("string").alias("backend"), F.lit(None).cast("string").alias("value"), F.col("c_at.seq").alias("seq"))
    before = Window.partitionBy("namespace", "name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") == REGISTER, F.struct(F.lit(False).alias("gone"), "value")).when(F.col("op") == CLEAR, F.struct(F.lit(True).alias("gone"), F.lit(None).cast("string").alias("value"))), ignorenulls=True).over(before)
    seen = era.unionByName(marks).withColumn("last", last)
    return seen.where(F.col("op") == LOOK_UP).select("namespace", "seq", "name", F.when(~F.col("last.gone"), F.col("last.value")).alias("value"))


def one_backend(operations: DataFrame) -> DataFrame:
    """The registrations of a table; one for another backend than the last in its namespace, not cleared since, raises."""
    w = Window.partitionBy("namespace").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    told = F.when(F.col("op") == REGISTER, F.col("backend")).when(F.col("op") == CLEAR, F.lit(""))
    seen = operations.where(F.col("op") != LOOK_UP).withColumn("now", F.last(told, ignorenulls=True).over(w))
    mine = seen.where(F.col("op") == REGISTER)
    fits = F.col("now").isNull() | (F.col("now") == "") | (F.col("now") == F.col("backend"))
    return require(mine, fits, F.concat(F.lit("namespace "), F.col("namespace"), F.lit(" holds entries of another backend"))).drop("now")


def operations_stream(spark: SparkSession, path: str, schema: Any, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

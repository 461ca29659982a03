"""Alert onsets of a stream from keyed state: what a batch costs does not grow with the history."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from starcell.functions import arguments
from starcell.operators.health import active_alerts, alert_kpis, new_alerts
from starcell.streaming.telemetry import append_batches, run_available

# Keyed state with timers needs this store.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Cells are dealt over so many groups, whose state is read and written as a whole. A checkpoint belongs to one number.
BUCKETS = 1_024


def _block(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    """Rows as one value of the state."""
    batch = pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def _rows(blocks: Iterable[tuple]) -> pd.DataFrame:
    return pa.concat_tables([pa.ipc.open_stream(bytes(b[0])).read_all() for b in blocks]).to_pandas()


class OnsetProcessor(StatefulProcessor):
    """Holds the observations of a bucket of cells until the watermark has passed them, then puts them in order.

    State per bucket: what waits, in blocks of rows; the alert bits of the last observation of each
    cell put in order, unless there are none; and when the one timer is due. `waiting` is the
    schema of the rows, whose first column is the cell, `order` the columns that the rows of a
    cell are sorted by; the first is the time in microseconds.
    """

    def __init__(self, waiting: StructType, order: Sequence[str]) -> None:
        self.waiting, self.order = to_arrow_schema(waiting), list(order)
        self.known = pa.schema([self.waiting.field("cell"), self.waiting.field("active")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "block binary")
        self.last = handle.getValueState("last", "block binary")
        self.due = handle.getValueState("due", "ms bigint")

    def _wake(self, micros: int) -> None:
        """Keep one timer, at the earliest waiting observation."""
        ms, held = int(micros) // 1000, self.due.get()
        if held is not None:
            if held[0] <= ms:
                return
            self.handle.deleteTimer(held[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            if len(part):
                part = part[self.waiting.names]
                self.rows.appendValue(_block(part, self.waiting))
                self._wake(part[self.order[0]].min())
        return iter(())

    def _carried(self, cells: Sequence, latest: np.ndarray) -> np.ndarray:
        """The kept alert bits of these cells, in whose place `latest` is kept."""
        held = self.last.get()
        kept = {} if held is None else dict(_rows([held]).itertuples(index=False, name=None))
        before = np.array([kept.get(c, 0) for c in cells], dtype=np.int32)
        if (before != latest).any():
            kept.update(zip(cells, latest.tolist()))
            kept = {c: bits for c, bits in kept.items() if bits}
            if kept:
                rows = pd.DataFrame({"cell": pd.Series(list(kept), dtype=object), "active": list(kept.values())})
                self.last.update(_block(rows, self.known))
            else:
                self.last.clear()
        return before

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = _rows(self.rows.get())
        ready = held[self.order[0]] < passed
        done, later = held[ready], held[~ready]
        self.due.clear()
        if len(later):
            self.rows.put([_block(later, self.waiting)])
            self._wake(later[self.order[0]].min())
        else:
            self.rows.clear()
        if not len(done):
            return
        codes, cells = pd.factorize(done["cell"].to_numpy(dtype=object), use_na_sentinel=False)
        done = done.assign(__cell=codes).sort_values(["__cell", *self.order], kind="stable")
        codes, active = done.pop("__cell").to_numpy(), done["active"].to_numpy()
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        latest = active[np.append(first[1:], len(codes)) - 1]
        before = np.concatenate([[0], active[:-1]]).astype(np.int32)
        before[first] = self._carried([None if pd.isna(c) else c for c in cells], latest)
        # The others have nothing to tell.
        fresh = (active & ~before) != 0
        if fresh.any():
            yield done.assign(before=before)[fresh].reset_index(drop=True)

    def close(self) -> None:
        pass


def _kept(stream: DataFrame, name: str) -> tuple[Column, Column]:
    """A column without NULLs, and whether it was one: pandas would turn integers beside NULLs into floats."""
    kind = stream.schema[name].dataType
    if not isinstance(kind, (IntegralType, StringType)):
        raise ValueError(f"{name!r} must be a whole number or a text to break ties")
    filler = F.lit("") if isinstance(kind, StringType) else F.lit(0)
    return F.coalesce(F.col(name), filler.cast(kind)), F.col(name).isNotNull().cast("int")


def keyed_onsets(stream: DataFrame, delay: str = "10 minutes", tie: Sequence[str] = (),
                 thresholds: Mapping[str, float] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Alerts that a cell's previous observation did not have, as a streaming frame to append.

    An onset is given once, when the watermark (the latest time seen less `delay`) has
    passed its observation; by then all that came in time is in order. So the last `delay`
    of a stream waits for what follows it. Observations later than that are left out, as
    are those without a time. A NULL cell is a cell. Observations that agree in time and
    `tie` follow each other in the order in which they came. State holds the waiting
    observations and one number per cell that has alerts, whatever the history. Cells are dealt
    over `buckets`, which may not change while a checkpoint lives: a batch reads what waits in
    the buckets that it decides on, and the numbers of their cells, as a whole. The rows of a
    bucket in one batch meet in one task; bound the batch where a cell is very busy.
    """
    buckets = arguments.whole_number(buckets, "buckets", 1)
    # Inside the state, names must not begin with an underscore.
    kpis = alert_kpis(stream.columns)
    tied = {f"tie{i}": _kept(stream, name) for i, name in enumerate(tie)}
    rows = stream.select(
        F.col("cell_id").alias("cell"), F.col("timestamp").cast("timestamp").alias("time"),
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"),
        *[column.alias(name + part) for name, pair in tied.items() for part, column in zip(("_has", ""), pair[::-1])],
        *[F.col(k).cast("double").alias(k) for k in kpis],
        active_alerts(stream.columns, thresholds).cast("int").alias("active"))
    rows = rows.where(F.col("time").isNotNull()).withWatermark("time", delay)
    waiting = StructType([f for f in rows.schema.fields if f.name != "time"])
    order = ["at", *[f"{name}{part}" for name in tied for part in ("_has", "")]]
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)).cast("int"))
    ordered = dealt.groupBy("bucket").transformWithStateInPandas(
        OnsetProcessor(waiting, order),
        StructType([*waiting.fields, StructField("before", rows.schema["active"].dataType)]),
        "Append", "EventTime")
    kind = stream.schema["timestamp"].dataType
    found = ordered.select(
        F.col("cell").alias("cell_id"), F.timestamp_micros("at").cast(kind).alias("timestamp"),
        *[F.when(F.col(f"tie{i}_has") == 1, F.col(f"tie{i}")).alias(name) for i, name in enumerate(tie)],
        F.inline(new_alerts(stream.columns, F.col("active"), F.col("before"), thresholds)))
    return found.where(F.col("alert_type").isNotNull())


def keyed_onset_stream(stream: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes",
                       tie: Sequence[str] = (), thresholds: Mapping[str, float] | None = None,
                       buckets: int = BUCKETS) -> None:
    """Run `keyed_onsets` over what has arrived; a folder of `out` per batch, read by `read_batches`."""
    conf = stream.sparkSession.conf
    # A restarted query keeps the store that its checkpoint names, so other streams are not touched.
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        run_available(keyed_onsets(stream, delay, tie, thresholds, buckets), checkpoint, append_batches(out))
    finally:
        conf.set(PROVIDER, before)

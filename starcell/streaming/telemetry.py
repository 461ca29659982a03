"""Streaming forms of the telemetry operators, equal to their batch results.

Scores and alerts are stateless projections, so `health.with_health` and
`health.alert_rows` take a streaming frame as they are. The roll-up keeps windowed
aggregates under a watermark. Onsets carry each cell's last reading from one
micro-batch to the next as a table.

Every micro-batch writes into a folder named by its id and replaces it on a retry.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcell.functions import arguments, timeparts
from starcell.operators.health import alert_onsets
from starcell.plans import measures
from starcell.plans.marts import EXACT_DIGITS, KPIS, kpi_means

WINDOWS = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "1 week"}


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None],
                  mode: str = "append") -> None:
    """Process what has arrived, then stop; progress is kept in `checkpoint`."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(sink).start())
    query.awaitTermination()


def batch_folder(root: str, batch: int) -> str:
    return f"{root}/batch={batch:012d}"


def append_batches(root: str) -> Callable[[DataFrame, int], None]:
    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(batch_folder(root, batch))

    return sink


def windowed_parts(stream: DataFrame, level: str = "minute", delay: str = "10 minutes",
                   digits: Mapping[str, int | None] | None = None) -> DataFrame:
    """Partial roll-up aggregates per time window, dropped once the watermark passes."""
    level = arguments.pick(level, WINDOWS, "stream roll-up level")
    timed = stream.withColumn("__ts", F.col("timestamp").cast("timestamp")).withWatermark("__ts", delay)
    # Weeks start on Monday; the epoch was a Thursday.
    offset = "4 days" if level == "week" else None
    window = F.window("__ts", WINDOWS[level], startTime=offset)
    rows = measures.first_pass(timed, [window], _block(digits))
    return rows.select(F.col("window.start").alias("time_bucket"),
                       *[c for c in rows.columns if c != "window"])


def _block(digits: Mapping[str, int | None] | None) -> list[measures.Measure]:
    return [measures.row_count("observation_count"),
            *kpi_means(digits or dict.fromkeys(KPIS, EXACT_DIGITS))]


def rollup_stream(stream: DataFrame, out: str, checkpoint: str, level: str = "minute",
                  delay: str = "10 minutes", digits: Mapping[str, int | None] | None = None) -> None:
    """Keep the roll-up of a stream current under `out`."""
    parts = windowed_parts(stream, level, delay, digits)
    run_available(parts, checkpoint, append_batches(out), mode="update")


def read_rollup(spark: SparkSession, out: str, level: str = "minute",
                digits: Mapping[str, int | None] | None = None) -> DataFrame:
    """The latest figures of every bucket; a later batch replaces an earlier one."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in ("batch", "time_bucket")]
    rows = rows.groupBy("time_bucket").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    done = measures.finish(rows.select("time_bucket", "v.*"), ["time_bucket"], _block(digits))
    return done.withColumn("time_bucket", timeparts.bucket_text("time_bucket", level))


def onset_stream(stream: DataFrame, out: str, state: str, checkpoint: str, tie: Sequence[str] = (),
                 thresholds: Mapping[str, float] | None = None) -> None:
    """Alerts that a cell's previous observation did not have, across micro-batches.

    Observations may come late. A batch decides anew on all of a cell from its earliest new
    observation on, and says so in `out/since`; `read_onsets` leaves out what a later batch
    has decided. `state` keeps the observations, a folder per batch; a folder may be dropped
    when none older than its newest observation is expected, but for each cell's last one.
    """
    columns = ["cell_id", "timestamp", *tie, *KPIS]
    place = F.struct("timestamp", *tie)

    def sink(batch_rows: DataFrame, batch: int) -> None:
        spark = batch_rows.sparkSession
        batch_rows.select(*columns).write.mode("overwrite").parquet(batch_folder(state, batch))
        # What is stored is read, so that every step of a batch sees the same rows.
        held = spark.read.schema(batch_rows.select(*columns).schema).parquet(
            *[batch_folder(state, n) for n in range(batch + 1)])
        fresh = spark.read.schema(held.schema).parquet(batch_folder(state, batch))
        fresh.groupBy("cell_id").agg(F.min(place).alias("since")).write.mode("overwrite").parquet(
            batch_folder(f"{out}/since", batch))
        since = spark.read.parquet(batch_folder(f"{out}/since", batch)).withColumnRenamed("cell_id", "__cell")
        rows = held.join(since, held["cell_id"].eqNullSafe(since["__cell"])).drop("__cell")
        again = rows.where(place >= F.col("since")).drop("since").withColumn("__again", F.lit(1))
        before = rows.where(place < F.col("since")).groupBy("cell_id").agg(
            F.max(F.struct("timestamp", *tie, F.struct(*columns).alias("row"))).alias("l"))
        rows = again.unionByName(before.select("l.row.*", F.lit(0).alias("__again")))
        onsets = alert_onsets(rows, tie=[*tie, "__again"], thresholds=thresholds)
        onsets.where("__again = 1").drop("__again").write.mode("overwrite").parquet(
            batch_folder(f"{out}/rows", batch))

    run_available(stream.select(*columns), checkpoint, sink)


def read_onsets(spark: SparkSession, out: str, tie: Sequence[str] = ()) -> DataFrame:
    """The onsets of `onset_stream`, each as the last batch that looked at it has decided."""
    rows = spark.read.parquet(f"{out}/rows")
    later = spark.read.parquet(f"{out}/since").select(
        F.col("cell_id").alias("__cell"), "since", F.col("batch").alias("__later"))
    decided = (rows["cell_id"].eqNullSafe(later["__cell"]) & (F.col("__later") > F.col("batch"))
               & (F.struct("timestamp", *tie) >= F.col("since")))
    return rows.join(later, decided, "left_anti").drop("batch")


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")

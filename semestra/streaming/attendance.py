"""Attendance statistics as a Structured Streaming query.

Events arrive as files (JSON text lines from the ingestion sink, or Parquet).
The stream parses them (S5) and merges each micro-batch into tables under its
output folder:

``seen``    the deduplicated records (D10: ids repeat across producer runs),
            by day of ingestion, a folder per batch in it
``late``    the records that came after the watermark, for reports
the table   counts per (teacher, start hour, event type), a version per batch

A record's day belongs to its key, so a repeat always has the same day. A batch
is held only against the days it names; memory holds no state between batches,
and days that no record names are never read again, however long the stream
runs. A watermark therefore bounds what is read without losing anything: a
record beyond it is counted like any other (its old day is read once more) and
listed in ``late``.

A batch that dies half way leaves the last counts readable and is done again
from its own folders; a batch that was committed is not merged twice. With every
file read, the rollups equal the batch Q14 on the deduplicated events.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semestra.plans.attendance import ABSENT, PRESENT
from semestra.session import scratch_path
from semestra.sources.files import parse_events
from semestra.streaming import versions

KEY = ["asistencia_id", "timestamp_ingesta"]
EVENT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_event_stream(spark: SparkSession, path: str, fmt: str = "text",
                      schema: T.StructType | None = None,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source of attendance records. ``text`` parses JSON lines
    (several objects per line are split); other formats need a schema."""
    r = spark.readStream.format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "text":
        return parse_events(r.load(path))
    return r.schema(schema).load(path)


def with_event_time(events: DataFrame, time_col: str = "fecha_hora_evento",
                    fmt: str = EVENT_TIME_FORMAT) -> DataFrame:
    """Parse the text event time; unparsable times become null."""
    return events.withColumn("event_ts", F.try_to_timestamp(F.col(time_col), F.lit(fmt)))


def ingestion_day() -> F.Column:
    """Day of the record's ingestion text, 'none' without one. Texts that are no
    time go to one of a hundred names by hash, so the days stay few."""
    text = F.col("timestamp_ingesta")
    day = F.date_format(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")
    return F.coalesce(day, F.concat(F.lit("other-"), F.pmod(F.xxhash64(text), F.lit(100)).cast("string")), F.lit("none"))


_RECORD = [*KEY, "grupo_id", "tipo_evento"]
_SEEN = T.StructType([T.StructField(c, T.StringType()) for c in _RECORD] + [
    T.StructField("event_ts", T.TimestampType()), T.StructField("day", T.StringType()), T.StructField("batch", T.LongType())])


def _seen(spark: SparkSession, output_path: str, days: list[str]) -> DataFrame | None:
    """The records seen on some days; only their folders are listed and read."""
    base = f"{output_path}/_seen"
    paths = [f"{base}/day={d}" for d in days]
    paths = [p for p in paths if versions.exists(spark, p)]
    return spark.read.schema(_SEEN).option("basePath", base).parquet(*paths) if paths else None


def merge_batch(batch: DataFrame, batch_id: int, sections: DataFrame, output_path: str,
                watermark: dt.timedelta | None = None) -> None:
    """Merge one micro-batch of parsed records (with ``event_ts``) into the
    tables under ``output_path``; nothing if the batch is committed already."""
    spark = batch.sparkSession
    last = versions.newest(spark, output_path)
    if last is not None and last >= batch_id:
        return
    note = versions.notes(spark, output_path, last) if last is not None else {}
    mine = f"{output_path}/_batch/{batch_id}"
    # The batch's records once each; read from here on instead of from the source.
    batch.select(*_RECORD, "event_ts").dropDuplicates(KEY).withColumn("day", ingestion_day()).write.mode("overwrite").parquet(mine)
    fresh = spark.read.parquet(mine)
    days = [r.day for r in fresh.select("day").distinct().collect()]
    known = _seen(spark, output_path, days)
    if known is not None:
        known = known.where(F.col("batch") < batch_id)
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KEY]
        fresh = fresh.alias("n").join(known.alias("k"), [F.col("n.day") == F.col("k.day"), *same], "left_anti")
    (fresh.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{output_path}/_seen"))
    written = _seen(spark, output_path, days)
    fresh = written.where(F.col("batch") == batch_id) if written is not None else fresh
    high = fresh.agg(F.max("event_ts")).first()[0]
    before = dt.datetime.fromisoformat(note["high"]) if note.get("high") else None
    if watermark is not None and before is not None:
        (fresh.where(F.col("event_ts") < F.lit(before - watermark)).drop("batch").write.mode("overwrite")
         .parquet(f"{output_path}/_late/batch={batch_id}"))
    counts = (fresh.join(sections.select("grupo_id", "profesor_id", "hora_inicio_promedio"), "grupo_id")
              .groupBy("profesor_id", "hora_inicio_promedio", "tipo_evento").agg(F.count(F.lit(1)).alias("n")))
    if last is not None:
        counts = (spark.read.parquet(versions.folder(output_path, last)).unionByName(counts)
                  .groupBy("profesor_id", "hora_inicio_promedio", "tipo_evento").agg(F.sum("n").alias("n")))
    high = max((t for t in (high, before) if t is not None), default=None)
    versions.write_version(counts, output_path, batch_id, {"high": high.isoformat() if high else None})
    versions.remove(spark, mine)


def run_attendance_stream(events: DataFrame, sections: DataFrame, output_path: str,
                          checkpoint_path: str | None = None,
                          watermark: dt.timedelta | None = None, available_now: bool = True,
                          processing_time: str | None = None):
    """Start W1 under ``output_path``; ``read_counts`` reads its newest counts.
    ``available_now`` processes every file present and stops; otherwise a
    processing-time trigger keeps it running. Returns the StreamingQuery."""
    spark = events.sparkSession
    if checkpoint_path is None:
        checkpoint_path = scratch_path(spark, "stream")
    output_path = output_path.rstrip("/")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, sections, output_path, watermark)

    w = (with_event_time(events).writeStream
         .option("checkpointLocation", checkpoint_path)
         .foreachBatch(write_batch))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def read_counts(spark: SparkSession, output_path: str) -> DataFrame:
    """The newest complete counts of W1."""
    return versions.read_newest(spark, output_path.rstrip("/"))


def read_late(spark: SparkSession, output_path: str) -> DataFrame:
    """The records that came after the watermark, each counted once."""
    return spark.read.parquet(f"{output_path.rstrip('/')}/_late")


def stats_from_counts(counts: DataFrame) -> DataFrame:
    """Per-teacher totals from the count table (same columns as Q14a)."""
    from semestra.functions.numeric import attendance_adjustment
    agg = counts.groupBy("profesor_id").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("tipo_evento") == PRESENT, F.col("n")).otherwise(0)).alias("asistencias"),
        F.sum(F.when(F.col("tipo_evento") == ABSENT, F.col("n")).otherwise(0)).alias("faltas"))
    return (agg.select("profesor_id", *[F.col(c).cast("long").alias(c)
                                        for c in ("total", "asistencias", "faltas")])
            .withColumn("factor_asistencia",
                        attendance_adjustment("total", "asistencias", "faltas")))


def by_hour_from_counts(counts: DataFrame) -> DataFrame:
    """Per-hour attendance rate and volume from the count table."""
    from semestra.functions.numeric import round_half_up
    from semestra.operators.ordering import numeric_text_order
    agg = counts.groupBy("hora_inicio_promedio").agg(
        F.sum(F.when(F.col("tipo_evento") == PRESENT, F.col("n")).otherwise(0)).alias("_p"),
        F.sum("n").alias("volumen_datos"))
    return (agg.select("hora_inicio_promedio",
                       round_half_up(F.col("_p") / F.col("volumen_datos"), 2)
                       .alias("tasa_asistencia_promedio"),
                       F.col("volumen_datos").cast("long").alias("volumen_datos"))
            .orderBy(numeric_text_order("hora_inicio_promedio")))


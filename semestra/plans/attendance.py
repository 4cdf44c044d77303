"""Attendance statistics (Q14) over parsed attendance events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semestra.functions.numeric import attendance_adjustment, round_half_up
from semestra.operators.aggregates import count_if
from semestra.operators.ordering import numeric_text_order

PRESENT, ABSENT = "Entrada", "Ausencia"  # fixed values: event types


def dedupe_events(events: DataFrame) -> DataFrame:
    """Ids restart per producer run, so a record is identified by
    (asistencia_id, timestamp_ingesta). A hash aggregate, partial per task."""
    return events.dropDuplicates(["asistencia_id", "timestamp_ingesta"])


def events_with_sections(events: DataFrame, sections: DataFrame) -> DataFrame:
    """Events joined to their section's teacher and start hour."""
    return events.join(sections.select("grupo_id", "profesor_id", "hora_inicio_promedio"),
                       "grupo_id", "inner")


def attendance_stats(joined: DataFrame) -> DataFrame:
    """Per teacher total, present and absent counts (one pass) and the
    score adjustment F15."""
    return (joined.groupBy("profesor_id")
            .agg(F.count(F.lit(1)).alias("total"),
                 count_if(F.col("tipo_evento") == PRESENT).alias("asistencias"),
                 count_if(F.col("tipo_evento") == ABSENT).alias("faltas"))
            .withColumn("factor_asistencia",
                        attendance_adjustment("total", "asistencias", "faltas")))


def attendance_by_hour(joined: DataFrame) -> DataFrame:
    """Attendance rate (2 decimals) and volume per start hour, by hour
    as a number."""
    return (joined.groupBy("hora_inicio_promedio")
            .agg(F.avg(F.when(F.col("tipo_evento") == PRESENT, 1.0).otherwise(0.0))
                 .alias("_rate"),
                 F.count(F.lit(1)).alias("volumen_datos"))
            .select("hora_inicio_promedio",
                    round_half_up("_rate", 2).alias("tasa_asistencia_promedio"),
                    "volumen_datos")
            .orderBy(numeric_text_order("hora_inicio_promedio")))

"""The streaming attendance counts equal the batch statistics on the
deduplicated events (JSON text files with junk, duplicates and two objects
on one line)."""

import datetime as dt
import json
import os

import pytest

from semestra.plans import attendance as att
from semestra.sources.files import read_text_events
from semestra.streaming import attendance as stream
from semestra.streaming import versions


def rec(i, grupo, tipo, run="r1"):
    return json.dumps({"asistencia_id": str(i), "alumno_id": "a", "grupo_id": grupo,
                       "fecha_hora_evento": f"2024-01-0{1 + i % 3}T08:00:00.000000",
                       "tipo_evento": tipo, "timestamp_ingesta": run})


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    (src / "a.json").write_text("\n".join([
        rec(1, "G1", "Entrada"), rec(2, "G1", "Ausencia"), "not json",
        rec(3, "G2", "Entrada") + rec(4, "G2", "Entrada")]) + "\n")
    (src / "b.json").write_text("\n".join([
        rec(1, "G1", "Entrada"),                 # duplicate of a.json line 1
        rec(1, "G1", "Entrada", run="r2"),       # same id, another run: kept
        rec(5, "G3", "Ausencia")]) + "\n")
    sections = spark.createDataFrame([("G1", "P1", "7"), ("G2", "P1", "9"), ("G3", "P2", "7")],
                                     "grupo_id string, profesor_id string, hora_inicio_promedio string")
    out = str(tmp_path / "counts")
    q = stream.run_attendance_stream(stream.read_event_stream(spark, str(src)), sections, out,
                                     str(tmp_path / "ckpt"))
    q.awaitTermination()
    counts = stream.read_counts(spark, out)
    got = sorted(tuple(r) for r in stream.stats_from_counts(counts).collect())

    batch = att.events_with_sections(att.dedupe_events(read_text_events(spark, str(src))), sections)
    want = sorted(tuple(r) for r in att.attendance_stats(batch).collect())
    assert got == want
    assert got == [("P1", 5, 4, 1, 0.5), ("P2", 1, 0, 1, -0.5)]
    hours = sorted(tuple(r) for r in stream.by_hour_from_counts(counts).collect())
    assert hours == sorted(tuple(r) for r in att.attendance_by_hour(batch).collect())


def _sections(spark):
    return spark.createDataFrame([("G1", "P1", "7"), ("G2", "P1", "9"), ("G3", "P2", "7")],
                                 "grupo_id string, profesor_id string, hora_inicio_promedio string")


def _line(i, day, grupo="G1", seen=None):
    return json.dumps({"asistencia_id": str(i), "alumno_id": "a", "grupo_id": grupo,
                       "fecha_hora_evento": f"{day}T08:00:00.000000", "tipo_evento": "Entrada",
                       "timestamp_ingesta": seen or f"{day}T09:00:00"})


def test_watermark_loses_nothing(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    parts = [[_line(1, "2024-05-01"), _line(2, "2024-05-02")], [_line(3, "2024-05-20"), _line(1, "2024-05-01")],
             [_line(4, "2024-01-01", "G3"), _line(2, "2024-05-02"), _line(5, "2024-05-20", seen="no time")],
             [_line(4, "2024-01-01", "G3"), _line(5, "2024-05-20", seen="no time"), _line(6, "2024-05-21", "G9")],
             [_line(7, "2024-05-21", seen=None).replace('"2024-05-21T09:00:00"', "null")] * 2]
    for n, lines in enumerate(parts):
        (src / f"{n}.json").write_text("\n".join(lines))
        os.utime(src / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # the order they are read in
    out = str(tmp_path / "counts")
    events = stream.read_event_stream(spark, str(src), max_files_per_trigger=1)
    stream.run_attendance_stream(events, _sections(spark), out, str(tmp_path / "ckpt"),
                                 watermark=dt.timedelta(days=7)).awaitTermination()
    got = sorted(tuple(r) for r in stream.stats_from_counts(stream.read_counts(spark, out)).collect())
    batch = att.events_with_sections(att.dedupe_events(read_text_events(spark, str(src))), _sections(spark))
    assert got == sorted(tuple(r) for r in att.attendance_stats(batch).collect())
    assert got == [("P1", 5, 5, 0, 0.5), ("P2", 1, 1, 0, 0.5)]
    assert [r.asistencia_id for r in stream.read_late(spark, out).collect()] == ["4"]
    assert len(versions.versions(spark, out)) == versions.KEEP  # older counts are gone


def test_a_batch_that_dies_leaves_the_last_counts(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "events", str(tmp_path / "counts")
    src.mkdir()
    (src / "0.json").write_text("\n".join([_line(1, "2024-05-01"), _line(2, "2024-05-02", "G3")]))

    def run():
        stream.run_attendance_stream(stream.read_event_stream(spark, str(src)), _sections(spark), out,
                                     str(tmp_path / "ckpt")).awaitTermination()

    def stats():
        return sorted(tuple(r) for r in stream.stats_from_counts(stream.read_counts(spark, out)).collect())

    run()
    first = stats()
    assert first == [("P1", 1, 1, 0, 0.5), ("P2", 1, 1, 0, 0.5)]
    (src / "1.json").write_text("\n".join([_line(3, "2024-05-03"), _line(1, "2024-05-01")]))
    whole = versions.write_version

    def dies(df, table, version, note=None):
        df.limit(1).write.mode("overwrite").parquet(versions.folder(table, version))  # half a table, no marker
        raise RuntimeError("lost")

    monkeypatch.setattr(versions, "write_version", dies)
    with pytest.raises(Exception):
        run()
    assert stats() == first
    monkeypatch.setattr(versions, "write_version", whole)
    run()
    assert stats() == [("P1", 2, 2, 0, 0.5), ("P2", 1, 1, 0, 0.5)]
    # A committed batch that is played again changes nothing.
    again = stream.with_event_time(read_text_events(spark, str(src / "1.json")))
    stream.merge_batch(again, versions.newest(spark, out), _sections(spark), out)
    assert stats() == [("P1", 2, 2, 0, 0.5), ("P2", 1, 1, 0, 0.5)]

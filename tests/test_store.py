"""Stored tables: merges and refreshes rewrite only what changed; lookups read one
partition; ordered documents; snapshots read once."""

import glob
import json
import os
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from semestra.sources import files, snapshots, store

ROW = "k long, v string, n int"


def state(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/part-*")}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    rng = random.Random(1)
    path, keys = str(tmp_path / "t"), ["k"]
    base = {k: (k, f"v{k}", k % 7) for k in range(300)}
    store.write_store(spark.createDataFrame(list(base.values()), ROW), path, keys, 16)
    before = state(path)
    assert len(before) == 16  # one file a partition
    log = [(k, f"w{i}", i, op, i) for i, (k, op) in enumerate(
        (rng.choice([3, 3, 5, 300, 301]), rng.choice(["put", "delete", None])) for _ in range(40))]
    changes = spark.createDataFrame(log, ROW + ", op string, at int")
    touched = store.merge_store(changes, path, keys, ["at"], buckets=16)
    for k, v, n, op, _ in log:
        base.pop(k, None)
        if op != "delete":
            base[k] = (k, v, n)
    assert rows(store.scan_store(spark, path)) == sorted(base.values())
    after = state(path)
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 4 and kept and all(after[f] == before[f] for f in kept)
    # Done again, the merge changes nothing.
    store.merge_store(changes, path, keys, ["at"], buckets=16)
    assert rows(store.scan_store(spark, path)) == sorted(base.values())
    # A partition whose rows are all deleted goes.
    gone = spark.createDataFrame([(k, None, None, "delete", 99) for k in base], ROW + ", op string, at int")
    store.merge_store(gone, path, keys, ["at"], buckets=16)
    assert not glob.glob(f"{path}/bucket=*/part-*")


def test_refresh_rewrites_changed_partitions_only(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["k"]
    df = spark.createDataFrame([(k, f"v{k}", None if k % 5 else k) for k in range(200)], ROW)
    store.write_store(df, path, keys, 16)
    before = state(path)
    assert store.refresh_store(df.repartition(3), path, keys, 16) == [] and state(path) == before
    new = df.where("k <> 7").withColumn("v", F.when(F.col("k") == 9, "other").otherwise(F.col("v"))).union(
        spark.createDataFrame([(1000, "x", 1)], ROW))
    touched = store.refresh_store(new, path, keys, 16)
    assert 1 <= len(touched) <= 3 and rows(store.scan_store(spark, path).select("k", "v")) == rows(new.select("k", "v"))
    assert sum(before.get(f) == t for f, t in state(path).items()) == 16 - len(touched)
    store.refresh_store(df.limit(0), path, keys, 16)
    assert not state(path)


def test_lookup_reads_one_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_store(spark.createDataFrame([(k, f"v{k % 3}", k) for k in range(500)], ROW), path, ["k", "v"], 16)
    found = store.lookup_store(spark, path, ["k", "v"], [77, "v2"], 16)
    assert rows(found) == [(77, "v2", 77)]
    scan = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line][0]
    bucket = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in bucket and "xxhash" not in bucket  # a constant: one folder
    assert found.select(F.input_file_name()).distinct().count() == 1
    assert store.lookup_store(spark, path, ["k", "v"], [77, "v0"], 16).count() == 0


def test_document_is_ordered_and_dealt_over_tasks(spark, tmp_path):
    df = spark.range(200_000).select(F.col("id"), F.concat(F.lit('x"\n,'), F.col("id").cast("string")).alias("t")).repartition(7, "t")
    parts = str(tmp_path / "parts")
    files.write_json_document(df, parts, [F.desc("id")], parts=16, join=False)
    sizes = [open(f, "rb").read().count(b'{"id"') for f in glob.glob(f"{parts}/part-0*")]
    assert sum(sizes) == 200_000 and max(sizes) < 200_000 / 8
    files.join_document(spark, parts, str(tmp_path / "one.json"))
    whole = json.load(open(tmp_path / "one.json", encoding="utf-8"))
    assert [r["id"] for r in whole] == list(range(199_999, -1, -1)) and whole[0]["t"] == 'x"\n,199999'
    assert files.read_json_document(spark, parts, df.schema).exceptAll(df).count() == 0
    assert files.read_json_document(spark, parts).count() == 200_000
    for n in (0, 1):
        files.write_json_document(df.limit(n), str(tmp_path / f"few{n}"))
        text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/few{n}/part-*")))
        assert len(json.loads(text)) == n


STUDENT = T.StructType([T.StructField(c, T.StringType()) for c in ("alumno_id", "carrera", "semestre_actual")])


def test_snapshots_are_parsed_once(spark, tmp_path, monkeypatch):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()

    def put(name, *lines):
        (src / name).write_text("alumno_id,carrera,semestre_actual\n" + "\n".join(lines) + "\n")

    read = []
    inner = snapshots.read_snapshots
    monkeypatch.setattr(snapshots, "read_snapshots", lambda spark, paths, *a: (read.append(sorted(p.rsplit("/", 1)[-1] for p in paths)), inner(spark, paths, *a))[1])

    def table_rows():
        return rows(snapshots.read_table(spark, table, STUDENT))

    run = lambda: snapshots.ingest_snapshots(spark, f"{src}/*.csv", table, STUDENT)
    put("alumnos_2024-1.csv", "1,ISC,1", '2,"I,D",3')
    assert run() == ["2024-1"] and run() == []
    put("alumnos_2024-2.csv", "1,ISC,2")
    assert run() == ["2024-2"]
    assert read == [["alumnos_2024-1.csv"], ["alumnos_2024-2.csv"]]
    assert table_rows() == [("1", "ISC", "1", "2024-1"), ("1", "ISC", "2", "2024-2"), ("2", "I,D", "3", "2024-1")]
    put("alumnos_2024-2.csv", "1,ISC,2", "3,IND,1")   # a corrected file
    put("mas_alumnos_2024-2.csv", "4,IND,1")           # and a second one of its term
    assert run() == ["2024-2"] and read[-1] == ["alumnos_2024-2.csv", "mas_alumnos_2024-2.csv"]
    assert [r[0] for r in table_rows() if r[3] == "2024-2"] == ["1", "3", "4"] and len(table_rows()) == 5
    # A run that dies before its commit is done again.
    put("alumnos_2025-1.csv", "9,ISC,1")
    whole = snapshots.versions.write_version

    def dies(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(snapshots.versions, "write_version", dies)
    try:
        run()
    except RuntimeError:
        pass
    monkeypatch.setattr(snapshots.versions, "write_version", whole)
    assert run() == ["2025-1"] and len(table_rows()) == 6

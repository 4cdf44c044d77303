"""Versioned tables: each write is a folder of its own, and a marker written
after it makes it the newest version. A writer that dies half way leaves no
marker, so readers go on with the version before; nothing is ever overwritten
under a reader. All paths go through the Hadoop file system of the table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from semestra.session import hadoop_path

KEEP = 3  # newest versions kept for readers that began on them


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, p = hadoop_path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def versions(spark: SparkSession, table: str) -> list[int]:
    """Committed versions, oldest first."""
    return _numbers(spark, f"{table}/_commits")


def folder(table: str, version: int) -> str:
    return f"{table}/_versions/{version}"


def newest(spark: SparkSession, table: str) -> int | None:
    found = versions(spark, table)
    return found[-1] if found else None


def notes(spark: SparkSession, table: str, version: int) -> dict:
    """What the writer of a version noted in its marker."""
    return json.loads("".join(r.value for r in spark.read.text(f"{table}/_commits/{version}").collect()))


def read_newest(spark: SparkSession, table: str) -> DataFrame:
    """The newest committed version."""
    version = newest(spark, table)
    if version is None:
        raise FileNotFoundError(f"no committed version of {table}")
    return spark.read.parquet(folder(table, version))


def write_version(df: DataFrame, table: str, version: int, note: dict | None = None) -> None:
    """Write ``df`` as a version and commit it. What a dead writer left of the
    same version is replaced; a version that is committed stays as it is."""
    spark = df.sparkSession
    if version in versions(spark, table):
        return
    df.write.mode("overwrite").parquet(folder(table, version))
    fs, marker = hadoop_path(spark, f"{table}/_commits/{version}")
    _, draft = hadoop_path(spark, f"{table}/_drafts/{version}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(note or {}).encode()))
    out.close()
    fs.mkdirs(marker.getParent())
    if not fs.rename(draft, marker):  # a marker appears whole or not at all
        raise OSError(f"version {version} of {table} was not committed")
    for old in versions(spark, table)[:-KEEP]:
        remove(spark, f"{table}/_commits/{old}")
        remove(spark, folder(table, old))

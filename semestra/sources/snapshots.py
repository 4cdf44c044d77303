"""S4 a term at a time: snapshot files are parsed once, when they are new.

A table of snapshots is a folder of Parquet partitions by term and a versioned
manifest of the files read (path, length, time of change). A run lists the
files, parses those the manifest lacks or has otherwise, and rewrites only their
terms' partitions; then it commits the manifest. A run that dies before that is
done again. The terms of files that are gone stay.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from semestra.session import hadoop_path
from semestra.sources.files import TERM_PATTERN, read_snapshots
from semestra.streaming import versions

TERM = "semestre_historico"


def _listed(spark: SparkSession, glob: str) -> dict[str, list]:
    """path -> [length, time of change] of the files of a glob."""
    fs, p = hadoop_path(spark, glob)
    return {s.getPath().toString(): [s.getLen(), s.getModificationTime()] for s in (fs.globStatus(p) or []) if s.isFile()}


def _term(path: str) -> str:
    found = re.search(TERM_PATTERN, path.rsplit("/", 1)[-1])
    return found[1] if found else ""


def ingest_snapshots(spark: SparkSession, glob: str, table: str, schema: T.StructType, fmt: str = "csv") -> list[str]:
    """Bring ``table`` up to the files of ``glob``; the terms that were read."""
    last = versions.newest(spark, f"{table}/_manifest")
    known = versions.notes(spark, f"{table}/_manifest", last)["files"] if last is not None else {}
    listed = _listed(spark, glob)
    changed = {_term(p) for p, state in listed.items() if known.get(p) != state}
    if not changed:
        return []
    paths = [p for p in listed if _term(p) in changed]  # a term may have several files
    (read_snapshots(spark, paths, schema, fmt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(TERM).parquet(f"{table}/_data"))
    note = spark.createDataFrame([(p, _term(p)) for p in sorted(listed)], "path string, term string")
    versions.write_version(note, f"{table}/_manifest", 0 if last is None else last + 1, {"files": known | listed})
    return sorted(changed)


def read_table(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """All terms of ``table``; a filter on the term reads its partition only."""
    fields = [f for f in schema.fields if f.name != TERM]
    return spark.read.schema(T.StructType([*fields, T.StructField(TERM, T.StringType())])).parquet(f"{table}/_data")

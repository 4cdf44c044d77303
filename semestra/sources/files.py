"""File scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semestra.session import drop_written, hadoop_path

CORRUPT_COL = "_corrupt_record"

# Fixed value: the attendance event record, all text fields.
ATTENDANCE_SCHEMA = T.StructType([
    T.StructField("asistencia_id", T.StringType()),
    T.StructField("alumno_id", T.StringType()),
    T.StructField("grupo_id", T.StringType()),
    T.StructField("fecha_hora_evento", T.StringType()),
    T.StructField("tipo_evento", T.StringType()),
    T.StructField("timestamp_ingesta", T.StringType()),
])


def _with_corrupt(schema: T.StructType) -> T.StructType:
    if CORRUPT_COL in schema.fieldNames():
        return schema
    return T.StructType(schema.fields + [T.StructField(CORRUPT_COL, T.StringType())])


def read_csv_permissive(spark: SparkSession, path: str | Sequence[str],
                        schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Header, UTF-8 (a BOM on the first header is dropped), multi-line
    quoted fields, ``"`` as quote and escape, PERMISSIVE with the broken line
    kept in ``_corrupt_record``. The schema is explicit: without the corrupt
    column in it Spark never fills that column. A file that may hold fields over
    several lines cannot be split, so one task reads it whole; ``multi_line``
    False lets many tasks read a large file whose fields are on one line each."""
    return (spark.read
            .option("header", True).option("encoding", "UTF-8")
            .option("multiLine", multi_line).option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT_COL)
            .schema(_with_corrupt(schema))
            .csv(path))


def read_csv_plain(spark: SparkSession, path: str | Sequence[str],
                   schema: T.StructType | None = None) -> DataFrame:
    """Header, quote and escape only, single-line records; all columns
    arrive as text unless a schema is given."""
    r = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_json_lines(spark: SparkSession, path: str | Sequence[str],
                    schema: T.StructType | None = None) -> DataFrame:
    """S3: JSON lines. Without a schema Spark infers one (a column mixing text
    and arrays is inferred as text holding the raw JSON)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


TERM_PATTERN = r"(\d{4}-\d)"


def read_snapshots(spark: SparkSession, glob: str | Sequence[str], schema: T.StructType | None = None,
                   fmt: str = "csv") -> DataFrame:
    """Many files at once; the term (``2019-1``) comes from each row's
    file name via the ``_metadata`` column (no per-file loop on the driver)."""
    if fmt == "csv":
        df = read_csv_plain(spark, glob, schema)
    else:
        df = spark.read.format(fmt).load(glob)
    return df.withColumn("semestre_historico",
                         F.regexp_extract(F.col("_metadata.file_name"), TERM_PATTERN, 1))


#: One record of a line: what stands outside texts, whole texts, and closing
#: braces that no opening brace follows. Each character is passed once.
_RECORD = r'(?s)(?:[^"}]++|"(?:[^"\\]++|\\.)*+"|\}(?!\s*+\{))*+\}?+'


def split_concatenated_json(value) -> F.Column:
    """A line may hold several objects written back to back (``}{``);
    split them into an array of JSON texts, in time linear in the line.

    A line whose quotes are paired is read from its start, texts as a whole, so
    a ``}{`` inside a text splits nothing. A line with an open text (a broken
    record) is split at every ``}{``, so its other records are kept."""
    v = F.col(value) if isinstance(value, str) else value
    quotes = F.length(F.regexp_replace(F.regexp_replace(v, r'\\.', ""), '[^"]++', ""))
    whole = F.filter(F.regexp_extract_all(v, F.lit(_RECORD), F.lit(0)), lambda x: x != "")
    return F.when(quotes % 2 == 0, whole).otherwise(F.split(F.regexp_replace(v, r"\}\s*+\{", "}\u0001{"), "\u0001"))


def parse_events(lines: DataFrame, schema: T.StructType = ATTENDANCE_SCHEMA,
                 id_col: str = "asistencia_id", value_col: str = "value") -> DataFrame:
    """S5 on a DataFrame of text lines: every JSON object on the line is
    parsed with the fixed schema; records without an id are dropped."""
    objs = lines.select(F.explode(split_concatenated_json(value_col)).alias("_j"))
    parsed = objs.select(F.from_json("_j", schema).alias("_r")).select("_r.*")
    return parsed.filter(F.col(id_col).isNotNull())


def read_text_events(spark: SparkSession, path: str | Sequence[str],
                     schema: T.StructType = ATTENDANCE_SCHEMA,
                     id_col: str = "asistencia_id") -> DataFrame:
    """Text files of JSON records -> fixed-schema rows."""
    return parse_events(spark.read.text(path), schema, id_col)


def read_parquet(spark: SparkSession, path: str | Sequence[str],
                 columns: Sequence[str] | None = None) -> DataFrame:
    """S6. Selecting ``columns`` here makes the scan's ReadSchema explicit."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small table from literal rows (fixed, bounded size)."""
    return spark.createDataFrame(list(rows), schema)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite; partitioned by e.g. term so later reads prune."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv_by(df: DataFrame, path: str, term: str, name: str = "datos") -> None:
    """CSV files named after a column's value, ``<name>_<value>.csv`` (with a
    number where a value has several), as snapshots arrive. The column itself is
    in the file names only; its values are few."""
    spark = df.sparkSession
    drop_written(spark, [path])
    df.write.partitionBy(term).option("header", True).option("escape", '"').csv(f"{path}/_parts")
    fs, parts = hadoop_path(spark, f"{path}/_parts")
    for folder in fs.listStatus(parts):
        value = folder.getPath().getName().partition("=")[2]
        if folder.isDirectory() and value:
            found = sorted(f.getPath().toString() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            for n, part in enumerate(found):
                fs.rename(hadoop_path(spark, part)[1], hadoop_path(spark, f"{path}/{name}{n or ''}_{value}.csv")[1])
    drop_written(spark, [f"{path}/_parts"])


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, overwrite. Readers must read every part file."""
    df.write.mode("overwrite").json(path)


def write_json_document(df: DataFrame, path: str, order_by: Sequence[str | Column] = (), parts: int | None = None,
                        join: bool = True) -> None:
    """One JSON array document, its rows in order of ``order_by`` (all
    columns by default; equal keys in no particular order).

    Rows are dealt by ranges of the order and sorted within, so no task holds
    more than its range. The parts, read by name, are the document; ``join``
    makes one file of them (``join_document``), else the folder keeps them. Every
    row is a line of its own between lines '[', ',' and ']'."""
    spark = df.sparkSession
    order = [F.col(f"`{c}`") if isinstance(c, str) else c for c in (order_by or df.columns)]
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = f"{path}/_parts" if join else path
    drop_written(spark, [path])
    # The first range always holds a row, so row 0 of partition 0 opens the array.
    opens = F.when(F.monotonically_increasing_id() == 0, "[").otherwise(",")
    (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
       .select(F.concat(opens, F.lit("\n"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("value"))
       .write.mode("overwrite").text(folder))
    fs, p = hadoop_path(spark, folder)
    head = "" if fs.getContentSummary(p).getLength() else "[\n"
    out = fs.create(hadoop_path(spark, f"{folder}/part-end.txt")[1], True)
    out.write(bytearray(f"{head}]\n".encode()))
    out.close()
    if join:
        join_document(spark, folder, f"{path}/part-00000.json")
        drop_written(spark, [folder])


def join_document(spark: SparkSession, folder: str, target: str) -> None:
    """The parts of a document as one file, joined by the file system in order
    of their names; the bytes go through a buffer of fixed size."""
    fs, p = hadoop_path(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    out = fs.create(hadoop_path(spark, target)[1], True)
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    try:
        for name in names:
            if name.startswith("part-"):
                part = fs.open(hadoop_path(spark, f"{folder}/{name}")[1])
                copy(part, out, 1 << 16, False)
                part.close()
    finally:
        out.close()


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Inverse of S10, for the folder of parts or the joined file."""
    r = spark.read.option("mode", "DROPMALFORMED")  # the lines between the rows
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)

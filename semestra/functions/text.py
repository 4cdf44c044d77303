"""Column -> Column text, list and JSON functions.

All of them are native Catalyst expressions: no Python UDF crosses the JVM
boundary, so they stay inside whole-stage codegen and do not block pushdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Java regex class for any whitespace run (the reference's intent, D4).
_WS = r"\s+"

# List entries that mean "no prerequisite" (D20).
EMPTY_MARKERS = ("", "NULL")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_ws(col) -> Column:
    """P1 on one column: to string, collapse whitespace runs, trim."""
    return F.trim(F.regexp_replace(_c(col).cast("string"), _WS, " "))


def clean_str_cols(df: DataFrame) -> DataFrame:
    """Every column to string with whitespace collapsed, in one select."""
    return df.select([collapse_ws(F.col(f"`{c}`")).alias(c) for c in df.columns])


def upper_name(col) -> Column:
    """Upper-cased, whitespace-collapsed name."""
    return F.upper(collapse_ws(col))


def clean_name_array(arr) -> Column:
    """trim, collapse inner whitespace, upper-case every entry; drop empty."""
    cleaned = F.transform(_c(arr), lambda x: F.upper(collapse_ws(x)))
    return F.filter(cleaned, lambda x: x.isNotNull() & (x != F.lit("")))


def _comma_split(text: Column, strip_pattern: str | None = None) -> Column:
    body = text if strip_pattern is None else F.regexp_replace(text, strip_pattern, "")
    parts = F.transform(F.split(body, ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != F.lit(""))


def _json_list(t: Column) -> tuple[Column, Column]:
    """(the list, if the whole text is a JSON list; whether the whole text is
    one JSON value). Read as the only element of a list around it, so that
    anything after a first value shows."""
    names = T.ArrayType(T.StringType())
    inside = F.from_json(F.concat(F.lit("["), t, F.lit("]")), names)
    whole = F.coalesce(F.size(inside) == 1, F.lit(False)) & (F.trim(t) != "")
    return F.when(whole, F.from_json(t, names)), whole


def parse_name_list(text) -> Column:
    """text holding a list of names.

    null -> []; a JSON list -> the list; other valid JSON -> [];
    anything else -> comma split, trimmed, empties dropped.
    """
    t = _c(text)
    as_list, is_json = _json_list(t)
    empty = F.array().cast("array<string>")

    def read(plain: Column) -> Column:
        return (F.when(t.isNull(), empty)
                .when((F.size(plain) == 1) & F.get(plain, 0).isNotNull(), F.get(plain, 0))
                .when(as_list.isNotNull(), as_list)
                .when(is_json, empty)
                .otherwise(_comma_split(t)))

    # Most texts are a list and nothing else: read once, as the only element of a
    # list around it. The lambda over one element keeps that to one reading a row.
    plain = F.from_json(F.concat(F.lit("["), t, F.lit("]")), T.ArrayType(T.ArrayType(T.StringType())))
    return F.get(F.transform(F.array(plain), read), 0)


def parse_name_list_loose(text) -> Column:
    """F3 (serving-side parser) with D19 applied: empty -> []; JSON list -> the
    list; else strip ``[ ] " '``, comma split; always cleaned with F2."""
    t = _c(text)
    as_list, _ = _json_list(t)
    raw = (F.when(t.isNull() | (F.trim(t) == ""), F.array().cast("array<string>"))
           .when(as_list.isNotNull(), as_list)
           .otherwise(_comma_split(t, r"[\[\]\"']")))
    return clean_name_array(raw)


def parse_prereqs(raw) -> Column:
    """strip ``[ ] "``, upper-case, comma split, trim; null -> [];
    '' and the text 'NULL' are dropped (D20)."""
    r = _c(raw).cast("string")
    body = F.upper(F.regexp_replace(r, r"[\[\]\"]", ""))
    parts = F.transform(F.split(body, ","), lambda x: F.trim(F.regexp_replace(x, _WS, " ")))
    kept = F.filter(parts, lambda x: ~x.isin(*EMPTY_MARKERS))
    return F.when(r.isNull(), F.array().cast("array<string>")).otherwise(kept)


def prereqs_any_form(df: DataFrame, col: str) -> Column:
    """the prerequisite column may arrive as null, array<string> or text.
    Branch on the schema once (not per row) and normalise to array<string>."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.ArrayType):
        return clean_name_array(F.coalesce(F.col(col), F.array().cast("array<string>")))
    if isinstance(dtype, T.NullType):
        return F.array().cast("array<string>")
    return parse_prereqs(F.col(col))


def normalize_course_schema(df: DataFrame) -> DataFrame:
    """Rename nombre/semestre and take the first present prerequisite
    column (prerrequisito, prerequisitos, prerrequisitos), else null.
    Columns starting with ``_`` pass through."""
    cols = set(df.columns)
    name = F.col("nombre") if "nombre" in cols else F.col("materia_nombre")
    sem = F.col("semestre") if "semestre" in cols else F.col("semestre_materia")
    raw = F.lit(None).cast("string")
    for cand in ("prerrequisito", "prerequisitos", "prerrequisitos"):
        if cand in cols:
            raw = F.col(cand).cast("string")
            break
    extra = [c for c in df.columns if c.startswith("_")]
    return df.select(name.alias("materia_nombre"), sem.alias("semestre_materia"),
                     raw.alias("prerequisitos_raw"), *extra)


_SCHEDULE_ENTRY = T.StructType([
    T.StructField("dia", T.StringType()),
    T.StructField("inicio", T.IntegerType()),
    T.StructField("fin", T.IntegerType()),
])
SCHEDULE_TYPE = T.ArrayType(_SCHEDULE_ENTRY)


def parse_schedule(text) -> Column:
    """``{"Lunes": "7-9", ...}`` -> array<struct<dia, inicio, fin>>.

    Day names are upper-cased; a range that is not exactly ``a-b`` of two
    integers gives null hours; bad or non-object JSON gives []. Key order is
    the document's order.
    """
    m = F.from_json(_c(text), T.MapType(T.StringType(), T.StringType()))

    # Step by step: within a lambda an expression is worked out wherever it stands.
    def split(e):
        return F.struct(e["key"].alias("key"), F.split(e["value"], "-").alias("parts"))

    def ends(e):
        return F.struct(e["key"].alias("key"), F.size(e["parts"]).alias("n"),
                        F.trim(F.get(e["parts"], 0)).try_cast("int").alias("ini"),
                        F.trim(F.get(e["parts"], 1)).try_cast("int").alias("fin"))

    def entry(e):
        # Both ends must parse, else both are null (one bad end spoils the range).
        ok = (e["n"] == 2) & e["ini"].isNotNull() & e["fin"].isNotNull()
        return F.struct(F.upper(e["key"]).alias("dia"),
                        F.when(ok, e["ini"]).alias("inicio"),
                        F.when(ok, e["fin"]).alias("fin"))

    parsed = F.transform(F.transform(F.transform(F.map_entries(m), split), ends), entry)
    return F.coalesce(parsed, F.array().cast(SCHEDULE_TYPE)).cast(SCHEDULE_TYPE)


def first_start_hour(horario, default: int = 7) -> Column:
    """``horario[0].inicio`` with null/empty -> default. ``get`` returns
    null past the end instead of raising under ANSI."""
    return F.coalesce(F.get(_c(horario), 0)["inicio"], F.lit(default))


def mean_start_hour(horario) -> Column:
    """mean of the start hours of a schedule array (null when empty)."""
    starts = F.filter(F.transform(_c(horario), lambda e: e["inicio"]), lambda x: x.isNotNull())
    total = F.aggregate(starts, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when(F.size(starts) > 0, total / F.size(starts))

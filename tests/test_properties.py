"""Property tests: the native parsers agree with plain-Python statements of
the rules on generated lists of course names."""

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semestra.functions import text as X

NAME = st.text(alphabet="abcdefghijklmnopqrstuvwxyzÁÉÍÓÚáéíóúñ ", min_size=0, max_size=12)
NAMES = st.lists(NAME, min_size=0, max_size=5)


def as_text(names, style):
    if style == "json":
        return json.dumps(names, ensure_ascii=False)
    if style == "csv":
        return ", ".join(names)
    return None


def ref_name_list(x):
    if x is None:
        return []
    try:
        d = json.loads(x)
        return d if isinstance(d, list) else []
    except ValueError:
        return [y.strip(" ") for y in x.split(",") if y.strip(" ")]


def ref_clean(names):
    out = [re.sub(r"\s+", " ", n).strip(" ").upper() for n in names]
    return [n for n in out if n]


def ref_prereqs(x):
    if x is None:
        return []
    body = re.sub(r'[\[\]"]', "", x).upper()
    parts = [re.sub(r"\s+", " ", p).strip(" ") for p in body.split(",")]
    return [p for p in parts if p not in ("", "NULL")]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(NAMES, st.sampled_from(["json", "csv", "null"])), min_size=1, max_size=30))
def test_name_lists_match_reference_rules(spark, cases):
    texts = [as_text(n, s) for n, s in cases]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select(X.parse_name_list("s").alias("a"),
                    X.clean_name_array(X.parse_name_list("s")).alias("b"),
                    X.parse_prereqs("s").alias("c")).collect()
    for t, r in zip(texts, got):
        assert r.a == ref_name_list(t), t
        assert r.b == ref_clean(ref_name_list(t)), t
        assert r.c == ref_prereqs(t), t


def test_name_lists_read_in_one_pass_are_the_lists(spark):
    texts = [None, "", " ", "[]", " [ ] ", '["a"]', '["a", "B c"]', '[null]', '["a", null]', '[1, "x"]', '[{"k": 1}, ["y"]]', '["a"], ["b"]',
             '["a"] x', '["a"', "null", "5", '"a"', '{"k": ["a"]}', "a, b", "],[", "[],[]", '["a",]', "['a', 'b']", '[["a", "b"]]', '["\\u00e1"]']
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    as_list, is_json = X._json_list(F.col("s"))
    plain = (F.when(F.col("s").isNull(), F.array().cast("array<string>")).when(as_list.isNotNull(), as_list)
             .when(is_json, F.array().cast("array<string>")).otherwise(X._comma_split(F.col("s"))))
    for r in df.select("s", X.parse_name_list("s").alias("got"), plain.alias("want")).collect():
        assert r.got == r.want, r.s

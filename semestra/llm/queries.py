"""Registered queries of the package: one per operator, and the pipeline.

Each applies its operator to its whole table with production parameters.
``ORACLES`` has the SQL of those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from semestra.llm import (bpe, cover_tree, decontaminate, lang_id, minhash_dedup, periodic_runs, sentencepieces,
                          sharding, spelling_variants, substring_dedup, tool_calls, toxicity, url_filter)
from semestra.llm.shipping import ship


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).drop("text")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs).withColumn("n_removed", F.size("removed"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.calls_of_conversations(_read(spark, sf_dir, "conversations"))
    return tool_calls.link_calls(calls, results, tool_calls.SCHEMAS)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(_read(spark, sf_dir, "documents"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_regions(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(_read(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity.fit_on(docs, _read(spark, sf_dir, "labels")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.repeated_urls(pages))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = lang_id.predict_languages(docs, lang_id.fit_on(docs))
    return found.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_periodic_tails(_read(spark, sf_dir, "documents"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = periodic_runs.longest(F.col("runs"))
    found = periodic_runs.periodic_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        "runs_sha256", "collapsed_sha256")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode_pieces(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"),
                          F.element_at("ends", -1).cast("long").alias("n_bytes"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.with_lost_letters(spelling_variants.words_of(_read(spark, sf_dir, "documents")))
    return spelling_variants.group_variants(spelling_variants.count_words(words))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash_dedup, op2_sharding, op3_substring_dedup, op4_tool_calls, op5_bpe,
                            op6_decontamination, op7_embedding_dedup, op8_toxicity, op9_url_filter, op10_language_id,
                            op11_periodic_runs, op12_sentencepiece, op13_spelling_variants)
} | {"pipeline": corpus_pipeline.run}

_COMPONENTS = """
adj AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM adj UNION SELECT r.a, l.b FROM reach r JOIN adj l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)"""

#: crc32 of a list ``bytes`` by the table ``t`` of CTE ``crc_table``.
_CRC_TABLE = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i]::BIGINT[] || range(8),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
)"""
_CRC = """xor(list_reduce([4294967295]::BIGINT[] || bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

ORACLES = {
    "op1_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(
           range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS items
  FROM w
),
e AS (SELECT doc_id, unnest(items) AS item FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM e x JOIN e y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.items) + len(y.items) - n)
),""" + _COMPONENTS + """
SELECT doc_id, CAST(len(items) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(c, doc_id)) AS kept
FROM s LEFT JOIN comp ON a = doc_id""",
    "op2_sharding": f"""
WITH r AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
         coalesce(strlen(text), 0) + {sharding.ROW_BYTES} AS row_bytes
  FROM documents
),
p AS (SELECT r.*, d, h >> ({sharding.BITS} - d) AS prefix FROM r, range(0, {sharding.BITS} + 1) t(d)),
f AS (
  SELECT d, prefix, sum(row_bytes) AS shard_bytes FROM p GROUP BY ALL
  HAVING sum(row_bytes) <= {sharding.LIMIT_BYTES} OR count(*) = 1
),
b AS (
  SELECT doc_id, h, row_bytes, min(d) AS d FROM p SEMI JOIN f ON p.d = f.d AND p.prefix = f.prefix
  GROUP BY ALL
)
SELECT b.doc_id, CASE WHEN b.d = 0 THEN 'all' ELSE right(lpad(bin(f.prefix), 64, '0'), CAST(b.d AS INTEGER)) END AS shard,
       CAST(b.d AS INTEGER) AS depth, CAST(row_bytes AS BIGINT) AS row_bytes,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes > {sharding.LIMIT_BYTES} AS oversize
FROM b JOIN f ON b.d = f.d AND f.prefix = b.h >> ({sharding.BITS} - b.d)""",
    "op7_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95
),""" + _COMPONENTS + """,
n AS (SELECT a, count(*) AS n FROM adj GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op9_url_filter": r"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
),
p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '') AS query
  FROM r
),
q AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'),
              lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept
  FROM p
),
c AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '')
           || regexp_replace(path, '/+$', '')
           || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM q
),
listed AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) >= 2),
j AS (
  SELECT c.*, l.canonical IS NOT NULL AS listed,
         CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM c LEFT JOIN listed l ON l.canonical = c.canonical
)
SELECT page_id, host, path, rule, listed,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
                 WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict
FROM j""",
    "op11_periodic_runs": r"""
WITH""" + _CRC_TABLE + r""",
b AS (
  SELECT doc_id, text, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1),
                                      lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)) AS bytes
  FROM documents
),
h AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, """ + _CRC + r""" AS h
  FROM b, crc_table
),
a AS (
  SELECT doc_id, ws, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 AS g
  FROM h
),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (
  SELECT doc_id, n, unnest(range(n)) AS i,
         unnest(CASE WHEN a IS NULL THEN ws
                ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END) AS w
  FROM p
),
m AS (
  SELECT x.doc_id, x.i - y.i AS lag, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w
   AND y.i < x.i AND 4 * (x.i - y.i) <= x.n
),
d AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM m),
s AS (
  SELECT doc_id, min(i) - lag AS start, count(*) + lag AS length, lag FROM d GROUP BY doc_id, lag, island
  HAVING count(*) + lag >= greatest(6, 4 * lag)
),
r AS (SELECT doc_id, start, length, min(lag) AS period FROM s GROUP BY ALL),
agg AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM r GROUP BY doc_id
),
best AS (
  SELECT doc_id, start, length, period FROM r
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1
),
k AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= start + period AND w.i < start + length)
  GROUP BY doc_id
)
SELECT p.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start,
       CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN agg USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op13_spelling_variants": r"""
WITH RECURSIVE""" + _CRC_TABLE + r""",
o AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS found FROM documents
),
w AS (
  SELECT doc_id, translate(found, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM o GROUP BY ALL
),
x AS (SELECT w, n, hex(encode(doc_id || ':' || w)) AS code FROM w),
b AS (
  SELECT w, n, list_transform(range(1, len(code), 2), lambda i: CAST('0x' || substr(code, i, 2) AS BIGINT)) AS bytes FROM x
),
h AS (SELECT w, n, """ + _CRC + r""" AS h FROM b, crc_table),
c AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h
),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || '~' || substr(word, i + 2) AS gap,
               substr(word, 1, i) || substr(word, i + 2) AS less
        FROM v, range(0, length(word)) t(i)),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.gap = y.gap AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM cut x JOIN v y ON x.less = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM cut x JOIN v y ON x.less = y.word
),
best AS (
  SELECT word, n, count(*) AS n_near, max(other_n) AS m, arg_min(other, {'a': -other_n, 'b': encode(other)}) AS other
  FROM near GROUP BY word, n
),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form,
         CASE WHEN m >= 2 * v.n THEN m END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word
),
chain(word, here) AS (
  SELECT word, word FROM f UNION ALL
  SELECT chain.word, f.form FROM chain JOIN f ON f.word = here WHERE f.form IS NOT NULL
),
root AS (SELECT chain.word, here AS root FROM chain JOIN f ON f.word = here WHERE f.form IS NULL)
SELECT f.word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM f JOIN root USING (word)""",
}

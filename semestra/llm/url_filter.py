"""URL filtering by a blocked Bloom filter with an exact check, and path rules.

Listed canonical URLs set eight bits each inside one 512-bit block. A URL whose
block has all its bits is a possible hit and goes on to an exact hash join with
the list, which removes the false positives; the others are never shuffled. The
filter has at most ``MAX_BLOCKS`` blocks whatever the list's length (beyond it
more URLs are possible hits, and the exact join still decides), so it may be
broadcast.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule, has no canonical form and is never listed. Repeated rows each get
their verdict. Other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semestra.session import materialize

#: Fixed values: (host, path prefix, verdict); a rule fits the host and its subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Parameters that say how a page was reached, not which page it is.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 18  # 512 bits each: a broadcast of 21 MB with its keys


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without www., path without trailing slashes, and the sorted query
    parameters that aren't tracking; scheme and fragment go. Null without host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    host = host_of(url)
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""),
                                       F.regexp_replace(path_of(url), "/+$", ""), tail))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _positions(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and one bit in each of the block's eight words."""
    bits = F.xxhash64(key, F.lit("bits"))
    words = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * j).bitwiseAND(63).cast("int")) for j in range(8)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), words


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w7: the filter over the column ``canonical`` of ``listed``."""
    block, words = _positions(F.col("canonical"), blocks)
    made = listed.select(block.alias("block"), *(w.alias(f"w{j}") for j, w in enumerate(words)))
    return made.groupBy("block").agg(*(F.bit_or(f"w{j}").alias(f"w{j}") for j in range(8)))


def listed_urls(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """``pages`` (with a column ``canonical``) and ``listed`` boolean; ``listed``
    has distinct non-null URLs in its column ``canonical``."""
    blocks = max(1, min(MAX_BLOCKS, -(-listed.count() * BITS_PER_URL // 512)))
    block, words = _positions(F.col("canonical"), blocks)
    probed = pages.withColumn("block", block).join(F.broadcast(bloom_blocks(listed, blocks)), "block", "left")
    hit = F.lit(True)
    for j, w in enumerate(words):
        hit = hit & (F.col(f"w{j}").bitwiseAND(w) != 0)
    maybe = F.coalesce(F.col("canonical").isNotNull() & hit, F.lit(False))
    probed = materialize(probed.select(*pages.columns, maybe.alias("maybe")), "probed")
    exact = (probed.where("maybe").join(listed.select("canonical", F.lit(True).alias("hit")), "canonical", "left")
             .select(*pages.columns, F.coalesce("hit", F.lit(False)).alias("listed")))
    return probed.where("NOT maybe").select(*pages.columns, F.lit(False).alias("listed")).union(exact)


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed: the longest rule decides,
    else a listed URL is blocked and any other allowed."""
    url = F.col("url").cast("string")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                         canonical_url(url).alias("canonical"))
    judged = listed_urls(parts, listed).withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                         F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
                         "listed")


def repeated_urls(pages: DataFrame, times: int = 2) -> DataFrame:
    """Canonical URLs under which ``times`` pages or more were fetched: a list
    of addresses that were crawled again under another spelling."""
    found = pages.select(canonical_url(F.col("url").cast("string")).alias("canonical")).where("canonical IS NOT NULL")
    return materialize(found.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
                       .where(F.col("n") >= times).select("canonical"), "listed")

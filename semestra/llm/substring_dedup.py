"""Substring dedup: passages that stand in several places are kept once.

Texts are cut into units: lines, and in a line sentences; a unit also begins at
a capitalised word, so that a passage set into a running line starts a unit of
its own. Units are normalised (A-Z lower-cased, white space as one blank) and
grouped by a 128-bit digest over all documents. The occurrence in the least
doc_id, there the earliest, is kept. Of the others are cut out

- runs of neighbouring units with MIN_RUN words or more in units of MIN_UNIT
  words or more (chance repeats of short units add nothing to a run),
- windows of neighbouring units, as few as have MIN_RUN words, that stand in
  several places as a whole, however short their units are,
- whole lines of MIN_LINE words or more that stand in several places.

Only neighbours that are all repeated units can form such a window or line, so
these are looked for among the repeated units alone. An occurrence is cut only
where the same units stand earlier, so a unit's earliest place is never lost.

Digests are counted with map-side sums; only repeated digests meet the units
again, and only a document's own units are ever gathered.

Defined results: null text stays null, text without words stays as it is.
Repeated rows (same doc_id and text) are one document and get one result; texts
that share a doc_id are ranked alike, so none loses a unit to another. Rows
without doc_id rank last and lose nothing to each other. Extra columns are
carried along; those named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semestra.llm.hashing import _powers, mix, seeds, text_chunks, word_hashes_at
from semestra.llm.workers import sliced, tidy
from semestra.session import materialize

MIN_RUN = 16
MIN_UNIT = 4
MIN_LINE = 5
LAST = (1 << 63) - 1
_K1, _K2 = (seeds(4096, s) | np.uint64(1) for s in (41, 42))
_SALT = seeds(4, 43)
_AT_ONCE = 1 << 19  # units whose windows are formed at a time
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def units(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per unit: row, h1, h2, no (in its row), start, end (characters), words,
    edge (1 if it begins a line, 2 if it ends one, 3 if both)."""
    hashes, rows, starts, ends = word_hashes_at(raw, offsets)
    names = ("row", "h1", "h2", "no", "start", "end", "words", "edge")
    if not len(hashes):
        return {n: np.zeros(0, np.int64) for n in names}
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    a, b, c = (padded[starts + j] for j in range(3))
    latin = (a == 0xC3) & (b >= 0x80) & (b <= 0x9E)
    follow = np.where(latin, c, b)
    capital, shout = ((_UPPER[a] | latin) & (_UPPER[follow] == x) for x in (False, True))
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    head = np.ones(len(starts) + 1, bool)
    head[1:-1] = (rows[1:] != rows[:-1]) | (lines[starts[1:]] != lines[ends[:-1]])
    new = head[:-1].copy()
    new[1:] |= ((_STOP[raw[ends[:-1] - 1]] & ~shout[1:]) | capital[1:])
    first = np.flatnonzero(new)
    words = np.diff(np.append(first, len(starts)))
    place = np.arange(len(starts)) - np.repeat(first, words)
    h1 = mix(np.add.reduceat(hashes * _K1[place % 4096] + place.astype(np.uint64) // np.uint64(4096), first))
    h2 = mix(np.add.reduceat(mix(hashes) * _K2[place % 4096], first))
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    row = rows[first]
    base = chars[offsets[row]]
    begin = np.searchsorted(row, np.arange(len(offsets)))
    last = np.append(first[1:], len(starts)) - 1
    return dict(zip(names, (row, h1.view(np.int64), h2.view(np.int64), np.arange(len(first)) - begin[row],
                            chars[starts[first]] - base, chars[ends[last]] - base, words,
                            head[first] + 2 * head[last + 1])))


def document_units(docs: DataFrame) -> DataFrame:
    """rank, rid, h1, h2, no, start, end, words, edge of every unit; (rank, rid)
    stand for the document."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, raw, offsets in text_chunks(batch.column(2)):
                u = units(raw, offsets)
                at = pa.array(u["row"] + top)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(u["h1"]), pa.array(u["h2"]),
                     *(pa.array(u[n].astype(np.int32)) for n in ("no", "start", "end", "words", "edge"))],
                    names=["rank", "rid", "h1", "h2", "no", "start", "end", "words", "edge"])

    return docs.select(*_identity(), F.col("text").cast("string")).mapInArrow(
        run, "rank long, rid long, h1 long, h2 long, no int, start int, end int, words int, edge int")


def _identity():
    return (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"),
            F.xxhash64("doc_id", F.col("text").cast("string")).alias("rid"))


def windows(no: np.ndarray, words: np.ndarray, h1: np.ndarray, h2: np.ndarray, edge: np.ndarray,
            doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last index, and 128-bit digest, of the windows and lines that
    neighbours among the given units form; units are in order of (doc, no)."""
    n = len(no)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = np.arange(n)
    breaks = np.flatnonzero((doc[1:] != doc[:-1]) | (no[1:] != no[:-1] + 1)) + 1
    run_end = np.append(breaks, n)[np.searchsorted(breaks, at, side="right")]
    total, short = (np.concatenate([[0], np.cumsum(x)]) for x in (words.astype(np.int64), words < MIN_UNIT))
    stop = np.searchsorted(total, total[:-1] + MIN_RUN)  # one past the last unit
    ok = stop <= run_end
    ok[ok] = short[stop[ok]] > short[at[ok]]
    ends = np.flatnonzero(edge & 2)
    close = np.append(ends, n)[np.searchsorted(ends, at)] + 1
    line = ((edge & 1) > 0) & (close <= run_end)
    line[line] = total[close[line]] - total[at[line]] >= MIN_LINE
    first = np.concatenate([at[ok], at[line]])
    last = np.concatenate([stop[ok], close[line]])
    kind = np.repeat([0, 2], [ok.sum(), line.sum()])
    up, down = _powers(n + 1)
    digests = []
    for k, h in enumerate((h1, h2)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h.view(np.uint64)) * up[:n], dtype=np.uint64)])
        digests.append(mix((sums[last] - sums[first]) * down[first] ^ _SALT[kind + k]).view(np.int64))
    return first, last - 1, *digests


def repeated_windows(gathered: DataFrame) -> DataFrame:
    """rank, rid, no, till, w1, w2 of the windows and lines that a document's
    repeated units form; ``gathered``: rank, rid, found (in order)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2)
            offsets = found.offsets.to_numpy().astype(np.int64)
            row = 0
            while row < len(found):
                end = int(np.searchsorted(offsets, offsets[row] + _AT_ONCE, side="right")) - 1
                end = min(max(end, row + 1), len(found))
                units_ = found.values.slice(offsets[row], offsets[end] - offsets[row])
                no, words, h1, h2, edge = (units_.field(f).to_numpy() for f in ("no", "words", "h1", "h2", "edge"))
                doc = np.repeat(np.arange(row, end), np.diff(offsets[row:end + 1]))
                first, last, w1, w2 = windows(no, words, h1, h2, edge, doc)
                at = pa.array(doc[first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(no[first]), pa.array(no[last]),
                     pa.array(w1), pa.array(w2)], names=["rank", "rid", "no", "till", "w1", "w2"])
                row = end

    return gathered.select("rank", "rid", "found").mapInArrow(
        run, "rank long, rid long, no int, till int, w1 long, w2 long")


def cut_spans(rank: int, found: list[tuple], wide: list[tuple] = ()) -> list[tuple[int, int]]:
    """Spans to remove from a document, given its repeated units (no, start,
    end, words, h1, h2, first, edge) and its repeated windows and lines (no,
    till, w1, w2, first), where ``first`` is the least rank with it."""
    cut: set[int] = set()
    seen: set[tuple[int, int]] = set()
    run: list[int] = []
    weight = 0
    found = sorted(found)
    for no, _, _, words, h1, h2, first, _ in found:
        kept = first == rank and (h1, h2) not in seen
        seen.add((h1, h2))
        if kept or run and no != run[-1] + 1:
            cut.update(run if weight >= MIN_RUN else ())
            run, weight = [], 0
        if not kept:
            run.append(no)
            weight += words if words >= MIN_UNIT else 0
    cut.update(run if weight >= MIN_RUN else ())
    there: dict[tuple[int, int], int] = {}
    for no, till, w1, w2, first in sorted(wide):
        if first != rank:
            cut.update(range(no, till + 1))
        elif (w1, w2) in there:  # what the first one covers stays
            cut.update(range(max(no, there[w1, w2] + 1), till + 1))
        else:
            there[w1, w2] = till
    out: list[tuple[int, int]] = []
    before = -2
    for no, start, end, *_ in found:
        if no in cut:
            out.append((out.pop()[0] if no == before + 1 else start, end))
            before = no
    return out


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
        while at < len(text) and text[at] in " \t":
            at += 1
    return "".join([*out, text[at:]])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` with text rid of repeated passages, and ``removed``: the spans
    (start, end) cut out, as characters of the original text."""
    again = (document_units(docs).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
             .where("n > 1").drop("n"))
    # Written, so that both sides of the join are dealt anew and a unit that
    # stands in many documents can be split.
    again = materialize(again, "repeated")
    found = document_units(docs).join(again, ["h1", "h2"])
    gathered = found.groupBy("rank", "rid").agg(
        F.array_sort(F.collect_set(F.struct("no", "start", "end", "words", "h1", "h2", "first", "edge"))).alias("found"))
    gathered = materialize(gathered, "gathered")
    wide = materialize(repeated_windows(gathered), "windows")
    twice = wide.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")).where("n > 1").drop("n")
    wide = wide.join(materialize(twice, "twice"), ["w1", "w2"]).groupBy("rank", "rid").agg(
        F.collect_list(F.struct("no", "till", "w1", "w2", "first")).alias("wide"))
    names = [c for c in docs.columns if c != "removed"]
    inner = [f"c{i}" for i in range(len(names))]
    at = names.index("text")
    # The document's columns travel under plain names, so none clashes.
    plain = docs.select(*_identity(), *(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)))
    joined = (plain.join(gathered, ["rank", "rid"], "left").join(wide, ["rank", "rid"], "left")
              .select("rank", "found", "wide", *inner))
    fields = [f.simpleString().split(":", 1)[1] for f in docs.select(*(f"`{c}`" for c in names)).schema]
    fields[at] = "string"
    schema = ", ".join(f"`{i}` {t}" for i, t in zip(inner, fields)) + ", removed array<struct<start:int,end:int>>"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in sliced(batches):
            texts = batch.column(3 + at).cast(pa.string()).to_pylist()
            removed: list[list[dict[str, int]]] = [[] for _ in texts]
            hit = batch.column(1)
            for r in np.flatnonzero(hit.is_valid().to_numpy(zero_copy_only=False)):
                spans = cut_spans(batch.column(0)[r].as_py(), [tuple(x.values()) for x in hit[r].as_py()],
                                  [tuple(x.values()) for x in batch.column(2)[r].as_py() or ()])
                if spans:
                    texts[r] = remove(texts[r], spans)
                    removed[r] = [{"start": a, "end": b} for a, b in spans]
            columns = list(batch.columns[3:])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, kind)], names=[*inner, "removed"])

    out = joined.mapInArrow(run, schema)
    return out.select(*(F.col(i).alias(c) for c, i in zip(names, inner)), "removed")

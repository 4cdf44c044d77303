"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are a text's words and word beginnings of 4 to 6 letters, weighed by
1 + log(count). One weight vector is shared by all thresholds: grade > k has
probability sigmoid(w.x - t_k) with t_0 < t_1 < ...; the outputs are these, the
expected severity (their sum) and a rejection at P(grade > 0) >= REJECT.

Grades of the labelled documents: 0 if not toxic; toxic ones 1 to GRADES - 1 by
the quantiles, among toxic documents, of how many distinct toxic markers they
hold (features seen in at least MIN_DOCS toxic documents and practically never
in others). The fit uses a bounded sample, at most SAMPLE labelled documents of
each class, the least by a hash of their id; it runs in numpy on the driver.

Defined results: null or empty text has severity by the thresholds alone and is
not rejected. Labels that are null, or whose document is missing, are ignored;
a doc_id labelled both ways counts as toxic. Without labels of both classes
nothing is rejected. Rows are judged by their text alone, so repeated rows and
null ids get equal results. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semestra.llm.workers import sliced, tidy

SAMPLE = 2000  # labelled documents of each class at most
GRADES = 4
MIN_DOCS = 3
MIN_SHARE = 0.01  # of a class's documents; rarer features are chance or copies
MAX_FEATURES = 50_000
Z = 4.0  # standard errors by which the classes must differ in a feature
REJECT = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """A word and its beginnings, which are marked by '*'."""
    return [word] + [word[:n] + "*" for n in (4, 5, 6) if len(word) >= n]


def text_features(text: str) -> dict[str, float]:
    counts: Counter[str] = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for f in word_features(word):
            counts[f] += n
    return {f: 1 + math.log(n) for f, n in counts.items()}


def copy_key(text: str) -> int:
    """Least hash of the five-word runs: near copies mostly share it."""
    words = text.split()
    return min(zlib.crc32(" ".join(words[i:i + 5]).encode()) for i in range(max(1, len(words) - 4)))


@dataclass
class OrdinalModel:
    """Shared weights of the features that have one, and ordered thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def score(self, text: str) -> float:
        get, total, counts = self.weights.get, 0.0, {}
        for word, n in Counter(_WORD.findall(text.lower())).items():
            for f in word_features(word):
                if get(f):
                    counts[f] = counts.get(f, 0) + n
        for f, n in counts.items():
            total += self.weights[f] * (1 + math.log(n))
        return total

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score and threshold."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(scores)[:, None] - self.thresholds, -50, 50)))


def marked_features(texts: list[str], toxic: np.ndarray) -> tuple[list[str], set[str]]:
    """The features worth a weight, and those of them that mark toxic texts.
    Only counts of documents are held, text after text."""
    seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for text, y in zip(texts, toxic):
        seen[y].update({f for w in set(_WORD.findall(text.lower())) for f in word_features(w)})
    n0, n1 = max(1, int((toxic == 0).sum())), max(1, int(toxic.sum()))
    z = {}
    for f in seen[0].keys() | seen[1].keys():
        a, b = seen[1][f], seen[0][f]
        if a + b >= MIN_DOCS and max(a / n1, b / n0) >= MIN_SHARE:
            p, q, m = a / n1, b / n0, (a + b) / (n0 + n1)
            score = (p - q) / math.sqrt(m * (1 - m) * (1 / n0 + 1 / n1) + 1e-12)
            if abs(score) >= Z:
                z[f] = score
    chosen = sorted(z, key=lambda f: (-abs(z[f]), f))[:MAX_FEATURES]
    markers = {f for f in chosen if z[f] > 0 and seen[1][f] >= MIN_DOCS and seen[0][f] / n0 <= 0.01 * seen[1][f] / n1}
    return chosen, markers


def grades(held: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grade of every labelled document from the number of markers it holds."""
    cuts = np.quantile(held[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic == 1, 1 + (held[:, None] > cuts).sum(axis=1), 0)


def fit(texts: list[str], toxic: list[int], rounds: int = 400, l2: float = 1e-4) -> OrdinalModel:
    """Gradient descent with Adam on the cumulative-link likelihood; the classes
    weigh the same. Thresholds are a base and positive steps, so stay ordered."""
    y = np.array(toxic, np.int64)
    empty = OrdinalModel({}, np.full(GRADES - 1, 50.0))
    if not len(y) or y.min() == y.max():
        return empty
    # Near copies count once, so that their words don't pass for markers.
    seen: dict[int, int] = {}
    first = [r for r, k in enumerate(map(copy_key, texts)) if seen.setdefault(k, r) == r]
    texts, y = [texts[r] for r in first], y[first]
    names, markers = marked_features(texts, y)
    at = {f: i for i, f in enumerate(names)}
    held, cells = np.zeros(len(y)), []
    for r, text in enumerate(texts):
        found = {f: v for f, v in text_features(text).items() if f in at}
        held[r] = len(markers & found.keys())
        cells += [(r, at[f], v) for f, v in found.items()]
    if not cells or y.min() == y.max():
        return empty
    grade = grades(held, y)
    rows, cols, vals = (np.array(c) for c in zip(*cells))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    params = np.zeros(len(names) + GRADES - 1)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, base, gaps = params[:len(names)], params[len(names)], np.exp(params[len(names) + 1:])
        cuts = base + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, vals * w[cols], len(y))
        # Likelihood of the grade: sigmoid(s - t_{g-1}) - sigmoid(s - t_g).
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -50, 50)))
        edge = np.concatenate([np.ones((len(y), 1)), p, np.zeros((len(y), 1))], axis=1)
        r = np.arange(len(y))
        high, low = edge[r, grade], edge[r, grade + 1]
        mass = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high) / mass, low * (1 - low) / mass
        g_score = -weight * (slope_high - slope_low)
        g_cut = np.zeros(GRADES + 1)
        np.add.at(g_cut, grade, weight * slope_high)
        np.add.at(g_cut, grade + 1, -weight * slope_low)
        g_cut = g_cut[1:-1]
        g = np.concatenate([np.bincount(cols, vals * g_score[rows], len(names)) + l2 * w,
                            [g_cut.sum()], np.cumsum(g_cut[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    w = params[:len(names)]
    cuts = params[len(names)] + np.concatenate([[0.0], np.cumsum(np.exp(params[len(names) + 1:]))])
    return OrdinalModel({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, cuts)


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of at most ``sample`` labelled documents of each class."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    by_class = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    ids = by_class[0].union(by_class[1])
    # At most 2 * sample rows, so the broadcast is bounded.
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    rows = sorted((r.text or "", r.toxic) for r in training_sample(docs, labels, sample).toLocalIterator())
    return fit([t for t, _ in rows], [y for _, y in rows])


def grade_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (likeliest) and
    rejected for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in sliced(batches):
            above = made.above(np.array([made.score(t.as_py() or "") for t in batch.column(1)]))
            mass = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]),
                 pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array(_rejected(above, batch.column(1)))],
                names=["doc_id", "severity", "p_toxic", "grade", "rejected"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, severity double, p_toxic double, grade int, rejected boolean")


def _rejected(above: np.ndarray, texts: pa.Array) -> np.ndarray:
    return (above[:, 0] >= REJECT) & np.array([bool(t.as_py()) for t in texts], bool)


def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` without the rejected rows, filtered where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in sliced(batches):
            texts = batch.column(at)
            above = made.above(np.array([made.score(t.as_py() or "") for t in texts]))
            yield batch.filter(pa.array(~_rejected(above, texts)))

    return docs.mapInArrow(run, docs.schema)

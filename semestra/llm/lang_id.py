"""Language identification by averaged hashed subword embeddings.

Every run of 3 and of 4 bytes of the lower-cased text is hashed to one of
BUCKETS embeddings; a text is their average, and a linear softmax over it gives
the languages. Embeddings and softmax are trained by stochastic gradient
descent in numpy, on a bounded sample of at most SAMPLE labelled rows (the
least by a hash of their id). A fifth of it is set aside: on it a temperature
is fitted to the scores, and the score below which a prediction is rejected
(REJECT_RATE of its right predictions are).

Defined results: null text, or text without a letter, is 'und' with score 0.
Without any labelled row every text is 'und'. Rows are judged by their text
alone; null or repeated doc_ids get a row each. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semestra.llm.hashing import text_chunks

SAMPLE = 3000
BUCKETS = 1 << 14
DIM = 16
GRAMS = (3, 4)
EPOCHS = 4
RATE = 2.0
REJECT_RATE = 0.01
UNKNOWN = "und"
CHUNK_BYTES = 2 << 20  # bytes scored at a time; sums run over all of them
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.random.default_rng(77).integers(1, 1 << 62, (max(GRAMS), 256), dtype=np.int64).astype(np.uint64)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def gram_buckets(raw: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes from every position on."""
    m = len(raw) - n + 1
    if m <= 0:
        return np.zeros(0, np.int32)
    low = _LOWER[raw]
    acc = _CODE[0][low[:m]]
    for j in range(1, n):
        acc = acc + _CODE[j][low[j:j + m]]
    acc *= np.uint64(0x9E3779B97F4A7C15)
    return (acc >> np.uint64(64 - 14)).astype(np.int32) % BUCKETS


def text_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    raw = np.frombuffer(text.encode(), np.uint8)
    count = np.bincount(np.concatenate([gram_buckets(raw, n) for n in GRAMS]), minlength=1)
    at = np.flatnonzero(count)
    return at, count[at] / max(1, count.sum())


@dataclass
class LanguageModel:
    """Per bucket the logits it adds (embedding times softmax weights)."""

    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Logits of every text of a batch, summed position by position."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        size = np.zeros(len(offsets) - 1)
        for n in GRAMS:
            buckets = gram_buckets(raw, n)
            # A text's grams start at its bytes but the last n - 1.
            begin, end = offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1])
            size += end - begin
            for k in range(len(self.languages)):
                sums = np.concatenate([[0.0], np.cumsum(self.table[:, k][buckets], dtype=np.float64)])
                total[:, k] += sums[np.minimum(end, len(buckets))] - sums[np.minimum(begin, len(buckets))]
        return total / np.maximum(size, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str]) -> LanguageModel:
    """Train on four fifths of the rows, calibrate on the rest."""
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs], np.int64)
    part = np.array([zlib.crc32(t.encode()) % 5 for t in texts], np.int64)
    train = np.flatnonzero(part != 0) if (part != 0).any() else np.arange(len(y))
    rng = np.random.default_rng(5)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    counts = {int(r): text_counts(texts[r]) for r in train}
    weight = len(train) / (len(languages) * np.maximum(1, np.bincount(y[train], minlength=len(languages))))
    for epoch in range(EPOCHS):
        for r in rng.permutation(train):
            at, share = counts[int(r)]
            if not len(at):
                continue
            mean = share @ emb[at]
            err = softmax(mean @ out + bias)
            err[y[r]] -= 1
            step = RATE / (1 + epoch) * min(3.0, weight[y[r]])
            back = out @ err
            out -= 0.1 * step * np.outer(mean, err)
            bias -= 0.01 * step * err
            emb[at] -= step * share[:, None] * back * min(50.0, len(at))
    model = LanguageModel(languages, emb @ out, bias)
    held = np.flatnonzero(part == 0)
    held = held if len(held) else train
    if len(held):
        logits = np.array([_one(model, texts[r]) for r in held])
        grid = np.geomspace(0.3, 20, 60)
        loss = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = model.probabilities(logits)
        right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
        model.reject_below = float(np.quantile(right, REJECT_RATE)) if len(right) else 1.0
    return model


def _one(model: LanguageModel, text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return model.logits(raw, np.array([0, len(raw)]))[0]


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and lang of at most ``sample`` rows that may be learned from; their
    ids are drawn first, so only their texts are read further."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & ~held_out(F.col("doc_id")))
    ids = (known.select("doc_id").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # At most ``sample`` rows, so the broadcast is bounded.
    found = known.select("doc_id", F.col("text").cast("string").alias("text"), "lang").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("r.text", "r.lang")


def fit_on(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    rows = sorted((r.text, r.lang) for r in training_sample(docs, sample).toLocalIterator())
    return fit([t for t, _ in rows], [x for _, x in rows]) if rows else None


_ANY_LETTER = re.compile(r"[^\W\d_]")


def predict_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected (score below the calibrated
    limit) for every row of ``docs``, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in batches:
            for row, raw, offsets in text_chunks(batch.column(1), CHUNK_BYTES):
                n = len(offsets) - 1
                seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw])])
                known = seen[offsets[1:]] > seen[offsets[:-1]]
                for r in np.flatnonzero(~known & (offsets[1:] > offsets[:-1])):
                    known[r] = _ANY_LETTER.search(raw[offsets[r]:offsets[r + 1]].tobytes().decode()) is not None
                lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if made is not None:
                    p = made.probabilities(made.logits(raw, offsets))
                    lang[known] = np.array(made.languages, object)[p.argmax(axis=1)][known]
                    score[known] = p.max(axis=1)[known]
                low = score < (made.reject_below if made is not None else 1.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(lang, pa.string()), pa.array(score), pa.array(low | ~known)],
                    names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")

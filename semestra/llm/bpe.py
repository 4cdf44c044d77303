"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over
tokens that accepts exactly the token sequences BPE produces. Each merge
(u, v) adds one gadget: the arc v leaves the state reached by u; an arc for the
new token leads, wherever u was possible, to a copy of the state that v reached
at that time. States are kept as versions (whose copy, at which merge) instead
of copied rows, so the automaton has one state and one arc per token; the
transitions met are filled into a table.

Every prefix of a word has one accepted path, so a word is encoded from left to
right by extending the one path that reaches each position. Words come from the
tokenizer file's own normalizer and splitter; decoding writes the arcs' labels.
Results equal those of the ``tokenizers`` library.

Defined results: null and empty text have no tokens and decode to ''. Rows with
null or repeated doc_id are encoded like any other. Other columns are ignored.
A text without blanks is one word, encoded in time linear in its length.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from semestra.llm.workers import tidy

CACHE = 300_000  # words, and transitions, a task remembers; beyond it the memory starts anew
_BLANK = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: ASCII and Latin letters: composed as they are, each lower-cased by itself.
_PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+\Z")
#: Fixed value: the split pattern of the tokenizer file, for lower-case text of _PLAIN.
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u017f]+|[0-9]|[^a-z0-9\u00df-\u017f]+")
#: Byte alphabet: visible Latin-1 bytes stand for themselves, the others for 256, 257, ...
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + n for n, b in enumerate(x for x in range(256) if x not in _SHOWN)}
_LOADED: dict[str, "Encoder"] = {}


class Automaton:
    """Token automaton of a BPE vocabulary and its ordered merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        size = max(vocab.values()) + 1
        self.size, self.end = size, end
        self.reach: dict[str, int] = {}  # first four symbols -> length of the longest label
        for label in vocab:
            word = label.removesuffix(end)
            if self.reach.get(word[:4], 3) < len(word):
                self.reach[word[:4]] = len(word)
        self.born = [-1] * size      # merge that made the token's arc
        self.gate = [-1] * size      # the arc exists where this one did then
        self.copied = [-1] * size    # the state is that of this token then
        self.cut: dict[int, int] = {}  # state * size + arc -> merge that removed it
        self.table: dict[int, bool] = {}
        self.dead: set[int] = set()  # tokens that no text reaches
        made: set[int] = set()
        for n, (left, right) in enumerate(merges):
            self._gadget(n, vocab[left], vocab[right], vocab[left + right], made)
        self.ids = {t: i for t, i in vocab.items() if i not in self.dead}

    def _gadget(self, n: int, u: int, v: int, uv: int, made: set[int]) -> None:
        if uv in made or uv in (u, v) or self.born[u] >= n or self.born[v] >= n:
            raise ValueError("merges must make new tokens of known ones")
        made.add(uv)
        if u in self.dead or v in self.dead or not self._resolve(u, v):  # earlier merges keep u and v apart: no such arc
            self.dead.add(uv)
            return
        self.cut[u * self.size + v] = n
        self.born[uv], self.gate[uv], self.copied[uv] = n, u, v

    def _resolve(self, state: int, arc: int) -> bool:
        """Whether ``arc`` leaves the state that token ``state`` reaches."""
        born, cut, size = self.born, self.cut, self.size
        now = 1 << 60
        while True:
            if cut.get(state * size + arc, now) < now:
                return False
            at, there = born[state], born[arc]
            if there > at:  # the arc came later: it is here if its gate was
                if self.gate[arc] == state == self.copied[arc]:
                    return False
                now, arc = there, self.gate[arc]
            elif at > there:  # the state is a copy that had the arc or not
                now, state = at, self.copied[state]
            elif at < 0:
                return True
            else:
                now, state, arc = at, self.copied[state], self.gate[arc]

    def encode(self, word: str) -> list[int]:
        """Ids of a word; the end suffix marks its last symbol.

        Follows the longest arc first. A position has one accepted path at
        most, so one that no path leaves is marked and never entered again."""
        get, size, table, n, end, reach = self.ids.get, self.size, self.table, len(word), self.end, self.reach.get
        got = get(word + end)
        if got is not None:
            return [got]
        path, ends, dead = [], [0], set()
        while ends[-1] < n:
            i = ends[-1]
            j = min(n, i + reach(word[i:i + 4], 3))
            tail = word[i:] + end if j == n else ""  # no longer than the longest label
            while j > i:
                arc = get(tail if j == n else word[i:j])
                if arc is not None and j not in dead:
                    if not i:
                        break
                    key = path[-1] * size + arc
                    ok = table.get(key)
                    if ok is None:
                        if len(table) >= CACHE:
                            table.clear()
                        ok = table[key] = self._resolve(path[-1], arc)
                    if ok:
                        break
                j -= 1
            if j > i:
                path.append(arc)
                ends.append(j)
            elif i:
                dead.add(i)
                path.pop()
                ends.pop()
            else:
                raise ValueError(f"no path for {word!r}")
        return path


class Encoder:
    """A tokenizer file's normalizer and splitter around the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.automaton = Automaton(vocab, merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels = {i: t for t, i in (vocab | self.special).items()}
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            got = self.words[word] = self.automaton.encode(word)
        return got

    def _plain(self, chunk: str) -> list[int]:
        if _PLAIN.match(chunk):
            words = _PLAIN_WORDS.findall(chunk.lower())
            if not chunk.isascii():
                words = [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in words]
        else:
            words = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]
        if len(words) == 1:
            return self._word(words[0])  # both memories hold the same list
        return [i for w in words for i in self._word(w)]

    def _chunk(self, chunk: str) -> list[int]:
        if self.splits is not None and "<|" in chunk:
            return [i for part in self.splits.split(chunk) if part
                    for i in ([self.special[part]] if part in self.special else self._plain(part))]
        return self._plain(chunk)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, piece by piece between ASCII blanks."""
        out: list[int] = []
        chunks = self.chunks
        for chunk in _BLANK.split(text):
            if chunk:
                got = chunks.get(chunk)
                if got is None:
                    if len(chunks) >= CACHE:
                        chunks.clear()
                    got = self._chunk(chunk)
                    if len(chunk) < 200:
                        chunks[chunk] = got
                out += got
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))

    def forget(self) -> None:
        """Keep the automaton only. Transitions go with the words: they lie
        among them, and a block of memory is given back only when empty."""
        self.words.clear()
        self.chunks.clear()
        self.automaton.table.clear()


def encoder(path: str) -> Encoder:
    """The encoder of a file, compiled once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encode_column(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ids array<int> and decoded string of every row's text; the
    file at ``path`` is read by every executor. Columns of these names go."""
    path = path or vocabulary_path()
    names = [c for c in docs.columns if c not in ("ids", "decoded")]
    at = names.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, usual = encoder(path), gc.get_threshold()
        gc.set_threshold(1_000_000)  # the remembered words hold no cycles
        try:
            for batch in batches:
                for row in range(0, len(batch), 64):
                    part = batch.slice(row, 64)
                    ids = [made.encode(t.as_py() or "") for t in part.column(at)]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([made.decode(i) for i in ids], pa.string())],
                        names=[*names, "ids", "decoded"])
        finally:  # a worker goes on to other stages
            made.forget()
            gc.set_threshold(*usual)

    plain = docs.select(*(F.col(f"`{c}`") for c in names))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, ids array<int>, decoded string")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded for every row of ``docs``."""
    return encode_column(docs.select("doc_id", F.col("text").cast("string").alias("text")), path)

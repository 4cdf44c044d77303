"""SentencePiece encoding and decoding with spans of the original bytes.

A text is normalised by the model's compiled character map: at each place the
longest prefix that the map's trie holds is replaced, any other character stands
for itself. For every byte of the result the place in the original text it came
from is recorded, so that each piece, cut from the normalised text, is projected
back to the span of original bytes it stands for. The map is the double-array
trie of the model file; places where no entry can begin are passed over at once.

Pieces come from BPE over the normalised text: of all neighbours that make a
piece, the one of the best score is merged, the leftmost first. Where two
characters stand side by side in no piece, no merge can reach across, so the text
is cut before blanks and between words and signs, and each part is encoded by
itself; the parts a task has met are remembered. A character without a piece
becomes its bytes' pieces. Decoding writes the pieces' labels, blanks for their
marks, and bytes that make no character as U+FFFD each, as the ``sentencepiece``
library does.

Supported are BPE models with byte pieces, blanks escaped and no user-defined
pieces; any other model is refused.

Defined results: null and empty texts have no piece but the end id and decode to
''. Rows with a null or repeated doc_id are encoded like any other; an empty
table gives an empty result. Other columns named like the results are replaced.
"""

from __future__ import annotations

import array
import codecs
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for a blank
CACHE = 700_000  # parts a task remembers, 200 bytes each; beyond it the memory starts anew
_LONG = 64       # parts beyond so many characters are merged by a heap and not remembered
_NEVER = 1 << 60
_PART_BYTES = 1 << 20
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # fixed values: kinds of pieces in a model file
_LOADED: dict[str, "Model"] = {}

codecs.register_error("semestra_each", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = data[i:i + size], i + size
        yield tag >> 3, value


class CharacterMap:
    """Compiled character map: the size of a double-array trie, its units, and
    the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], np.uint32).tolist() if blob else []
        self.texts = blob[4 + size:] if blob else b""
        # Bytes an entry can begin with; as text starts with whole characters,
        # all characters of such a first byte may begin one.
        firsts = [b for b in range(256) if self._step(self._root(), b) is not None] if self.units else []
        self._first = bytes(firsts)
        starts = [c for c in firsts if c < 0x80]
        wide = [(self._span(b)) for b in firsts if b >= 0xC2]
        kinds = "".join(re.escape(chr(c)) for c in starts) + "".join(f"{chr(a)}-{chr(b)}" for a, b in wide)
        self.maybe = re.compile(f"[{kinds}]") if kinds else None

    @staticmethod
    def _span(first: int) -> tuple[int, int]:
        """Characters whose UTF-8 form begins with a byte."""
        if first < 0xE0:
            return (first & 31) << 6, (first & 31) << 6 | 63
        if first < 0xF0:
            return max((first & 15) << 12, 0x800), (first & 15) << 12 | 0xFFF
        return max((first & 7) << 18, 0x10000), min((first & 7) << 18 | 0x3FFFF, 0x10FFFF)

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _root(self) -> int:
        return self._children(self.units[0])

    def _step(self, node: int, byte: int) -> int | None:
        """Unit reached from a node's children by a byte."""
        at = node ^ byte
        if at < len(self.units) and self.units[at] & 0x800000FF == byte:
            return at
        return None

    def longest(self, data: bytes, i: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that stands at ``i``, and its replacement."""
        best, node = None, self._root()
        for j in range(i, len(data)):
            at = self._step(node, data[j])
            if at is None:
                break
            unit = self.units[at]
            node = at ^ self._children(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                best = j + 1 - i, self.texts[start:self.texts.index(b"\0", start)]
        return best


class Normalizer:
    """A model's normalisation: character map, blanks and their marks."""

    def __init__(self, chars: CharacterMap, dummy_prefix: bool, remove_extra: bool):
        self.chars, self.dummy_prefix, self.remove_extra = chars, dummy_prefix, remove_extra

    def _units(self, text: str) -> tuple[bytes, np.ndarray]:
        """Mapped bytes, and for each the original byte its unit begins at;
        blanks are still blanks."""
        data = text.encode()
        out: list[bytes] = []
        source: list[np.ndarray] = []
        done = i = 0
        maybe = self.chars.maybe

        def plain(a: int, b: int) -> None:
            piece = data[a:b]
            out.append(piece)
            if piece.isascii():
                source.append(np.arange(a, b))
            else:  # all bytes of a character stand where it begins
                lead = (np.frombuffer(piece, np.uint8) & 0xC0) != 0x80
                source.append(np.flatnonzero(lead)[np.cumsum(lead) - 1] + a)

        if maybe is not None and maybe.search(text):
            starts = set(self.chars._first)
            while i < len(data):
                got = self.chars.longest(data, i) if data[i] in starts else None
                if got is None:
                    i += 1
                    continue
                if i > done:
                    plain(done, i)
                out.append(got[1])
                source.append(np.full(len(got[1]), i))
                i += got[0]
                done = i
        if done < len(data):
            plain(done, len(data))
        return b"".join(out), np.concatenate(source).astype(np.int64) if source else np.zeros(0, np.int64)

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text with marks for blanks, and for each of its bytes
        and its end the byte of ``text`` it stands at."""
        end = len(text.encode())
        raw, source = self._units(text)
        if not raw:
            return "", np.zeros(1, np.int64)
        mapped = np.frombuffer(raw, np.uint8)
        blank = mapped == 0x20
        if self.remove_extra:
            inner = np.flatnonzero(~blank)
            if not len(inner):
                return "", np.zeros(1, np.int64)
            keep = ~blank
            keep[1:] |= ~blank[:-1]  # the first blank of several
            keep[:inner[0]] = False
            mapped, source, blank = mapped[keep], source[keep], blank[keep]
        times = np.where(blank, 3, 1)  # a mark has three bytes
        source = np.repeat(source, times)
        text = mapped.tobytes().decode().replace(" ", MARK)
        if self.dummy_prefix:
            text, source = MARK + text, np.concatenate([[source[0]] * 3, source])
        if self.remove_extra:
            bare = text.rstrip(MARK)
            if len(bare) < len(text):  # the last piece ends where the blanks begin
                text, end = bare, int(source[len(bare.encode())])
                source = source[:len(bare.encode())]
        return text, np.append(source, end).astype(np.int64)


class Model:
    """A model file: its normalisation, pieces and decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        trainer, normal = ({k: v for n, m in message if n == kind for k, v in _fields(m)} for kind in (2, 3))
        pieces = [dict(_fields(v)) for n, v in message if n == 1]
        kinds = [p.get(3, _NORMAL) for p in pieces]
        labels = [p[1].decode() for p in pieces]
        if trainer.get(3) != 2 or not trainer.get(35) or set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} \
                or not normal.get(5, 1) or any(re.search(f"[^{MARK}]{MARK}", t) for t in labels):
            raise ValueError("supported are BPE models with byte pieces, escaped blanks and no user-defined pieces")
        self.normalizer = Normalizer(CharacterMap(normal.get(2, b"")), bool(normal.get(3, 1)), bool(normal.get(4, 1)))
        self.end = trainer.get(42, 2)
        score = [struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in pieces]
        best = {s: n for n, s in enumerate(sorted({s for s, k in zip(score, kinds) if k == _NORMAL}, reverse=True))}
        #: piece -> place in the order of scores, and id
        self.rank = {t: best[s] for t, s, k in zip(labels, score, kinds) if k == _NORMAL}
        self.ids = {t: i for i, (t, k) in enumerate(zip(labels, kinds)) if k == _NORMAL}
        self.bytes = [0] * 256
        for i, (t, k) in enumerate(zip(labels, kinds)):
            if k == _BYTE:
                self.bytes[int(t[3:5], 16)] = i
        self.label = [t.replace(MARK, " ").encode() if k == _NORMAL else b"" for t, k in zip(labels, kinds)]
        self.label[trainer.get(40, 0)] = trainer.get(44, " ⁇ ".encode())
        for b, i in enumerate(self.bytes):
            self.label[i] = bytes([b])
        #: bytes of the normalised text that a piece covers
        self.width = np.array([len(t.encode()) if k == _NORMAL else int(k == _BYTE) for t, k in zip(labels, kinds)], np.int64)
        self.marked = {i for t, i in self.ids.items() if t.startswith(MARK)}
        self.controls = {i for i, k in enumerate(kinds) if k == _CONTROL}
        self.cuts = self._cuts({t[i:i + 2] for t in self.rank for i in range(len(t) - 1)})
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def _cuts(pairs: set[str]) -> re.Pattern:
        """Parts of a text that no piece reaches out of: blanks with the signs
        or the other characters after them. Signs are those ASCII characters but
        letters and digits that stand in no piece beside anything but signs."""
        signs = {chr(c) for c in range(128) if not chr(c).isalnum()}
        while True:
            mixed = {c for a, b in pairs for c in (a, b) if c in signs and not {a, b} <= signs | {MARK}}
            if not mixed:
                break
            signs -= mixed
        if not signs:
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        kinds = re.escape("".join(sorted(signs)))
        return re.compile(f"{MARK}*[^{MARK}{kinds}]+|{MARK}*[{kinds}]+|{MARK}+")

    def _scan(self, part: str) -> list[str]:
        """Merged symbols of a short part: the best pair, leftmost first."""
        rank, symbol = self.rank.get, list(part)
        ranks = [rank(part[i:i + 2], _NEVER) for i in range(len(part) - 1)]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            symbol[i] += symbol.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(symbol[i - 1] + symbol[i], _NEVER)
            if i < len(ranks):
                ranks[i] = rank(symbol[i] + symbol[i + 1], _NEVER)
        return symbol

    def _merge(self, part: str) -> list[str]:
        """Merged symbols of a long part, in the same order by a heap."""
        rank = self.rank.get
        symbol: list[str] = list(part)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            got = rank(symbol[i] + symbol[i + 1])
            if got is not None:
                heap.append((got, i, 2))
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not symbol[i] or j >= n or len(symbol[i]) + len(symbol[j]) != size:
                continue  # one of the two has been merged since
            symbol[i] += symbol[j]
            symbol[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                got = rank(symbol[i] + symbol[k])
                if got is not None:
                    heapq.heappush(heap, (got, i, size + len(symbol[k])))
            k = before[i]
            if k >= 0:
                got = rank(symbol[k] + symbol[i])
                if got is not None:
                    heapq.heappush(heap, (got, k, size + len(symbol[k])))
        return [s for s in symbol if s]

    def _part(self, part: str) -> bytes:
        """Ids of a part of the normalised text as int32 bytes."""
        out = array.array("i")
        short = len(part) <= _LONG
        for s in self._scan(part) if short else self._merge(part):
            got = self.ids.get(s)
            if got is None:
                out.extend([self.bytes[b] for b in s.encode()])
            else:
                out.append(got)
        packed = out.tobytes()
        if short:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            self.parts[part] = packed
        return packed

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a whole text with the end id, and first byte and byte after
        each one's span of the text."""
        norm, source = self.normalizer.normalize(text)
        known = self.parts.get
        ids = np.frombuffer(b"".join([known(p) or self._part(p) for p in self.cuts.findall(norm)]), np.int32)
        ends = np.cumsum(self.width[ids])
        begins = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        last = len(text.encode())
        return np.append(ids, np.int32(self.end)), np.append(source[begins], last), np.append(source[ends], last)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the prefix blank goes."""
        if ids and ids[-1] in self.controls:
            ids = ids[:-1]
        runs = [ids]
        if not self.controls.isdisjoint(ids):  # bytes make a character only side by side
            runs = [list(run) for control, run in itertools.groupby(ids, self.controls.__contains__) if not control]
        out = "".join([b"".join(map(self.label.__getitem__, run)).decode("utf-8", "semestra_each") for run in runs])
        if not runs or not runs[0] or runs[0][0] not in self.marked:
            return out
        return out.lstrip(" ") if self.normalizer.remove_extra else out[1:] if self.normalizer.dummy_prefix else out

    def forget(self) -> None:
        """Give the remembered parts back."""
        self.parts.clear()
        pa.default_memory_pool().release_unused()


def model(path: str) -> Model:
    """The model of a file, read once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = Model(path)
    return _LOADED[path]


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about _PART_BYTES characters."""
    row, texts, size = 0, [], 0
    for n, value in enumerate(column):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= _PART_BYTES or n + 1 == len(column):
            yield row, texts
            row, texts, size = n + 1, [], 0


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows).astype(np.int32), pa.int32()))


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with, for every row's whole text, ids array<int> (the end id
    last), begins and ends array<int> (the span of original UTF-8 bytes of each)
    and decoded string; the file at ``path`` is read by every executor."""
    path = path or vocabulary_path()
    made = ("ids", "begins", "ends", "decoded")
    names = [c for c in docs.columns if c not in made]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model(path)
        try:
            for batch in batches:
                for row, texts in _groups(batch.column(at)):
                    coded = [found.encode(t) for t in texts]
                    decoded = [found.decode(ids.tolist()) for ids, _, _ in coded]
                    part = batch.slice(row, len(texts))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, *(_lists(list(c)) for c in zip(*coded)), pa.array(decoded, pa.string())],
                        names=[*names, *made])
        finally:  # a worker goes on to other stages
            found.forget()

    plain = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in names))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, ids array<int>, begins array<int>, ends array<int>, decoded string")

"""Periodic runs, pieces and spelling variants against brute force and the library."""

import collections
import hashlib
import random
import re
import zlib

import pytest
import sentencepiece

from semestra.llm import periodic_runs, sentencepieces, spelling_variants
from semestra.llm.queries import QUERIES
from semestra.session import materialize

WORDS = r"[^\x20\x09-\x0D]+"


def brute_runs(words, min_length=6, min_exponent=4):
    """Every lag walked from end to end; a run counts for its smallest period."""
    out = []
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(min_length, min_exponent * q) and i > s and not any(
                    all(words[k] == words[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def repetitive(rng, n):
    out = []
    while len(out) < n:
        part = [rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(1, 7))]
        out += (part * rng.randint(1, 8))[:rng.randint(1, 40)]
    return out[:n]


@pytest.mark.parametrize("exponent", [3, 4])
def test_runs_equal_brute_force(spark, exponent):
    rng = random.Random(exponent)
    texts = [rng.choice([" ", "\n", "\t \x0b"]).join(repetitive(rng, rng.randint(0, 110))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in periodic_runs.periodic_runs(docs, min_exponent=exponent).collect()}
    some = 0
    for i, t in enumerate(texts):
        words = re.findall(WORDS, t)
        want = brute_runs(words, 6, exponent)
        some += len(want)
        assert [tuple(r) for r in rows[i].runs] == want and rows[i].collapsed == brute_collapse(words, want)
    assert some > 300
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, min_exponent=2)


def test_runs_of_long_texts(spark):
    rng = random.Random(5)
    noise = [str(rng.randrange(10 ** 6)) for _ in range(50_000)]
    texts = ["x " * 400_000, "a b c " * 100_000, " ".join(noise * 4), " ".join(noise * 3), " ".join(noise)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(docs).collect()}
    assert got == {0: [(0, 400_000, 1)], 1: [(0, 300_000, 3)], 2: [(0, 200_000, 50_000)], 3: [], 4: []}


def test_runs_odd_rows(spark, odd_docs, no_docs):
    odd = odd_docs.withColumn("runs", odd_docs.source).withColumn("collapsed", odd_docs.source)
    out = periodic_runs.periodic_runs(odd)
    rows = out.collect()
    assert len(rows) == 12 and set(out.columns) == set(odd.columns)
    for r in rows:
        words = re.findall(WORDS, r.text or "")
        want = brute_runs(words[:200]) if r.doc_id != 7 else [(0, 60_000, 1)]
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == ("word" if r.doc_id == 7 else " ".join(words))
    assert periodic_runs.periodic_runs(no_docs).count() == 0


def planted(doc_id, words):
    """The contract's periodic tails, word by word."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_op11_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    texts = {i: " ".join(repetitive(rng, rng.randint(0, 120)) if i % 3 else [str(k) for k in range(rng.randint(0, 90))])
             for i in range(-5, 400)} | {400: None, 401: " \n", None: "a a a a a a a"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        words = re.findall(WORDS, t or "")
        if i is not None:
            words = planted(i, words)
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        r = rows[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapse(words, runs).encode()).hexdigest()


# ---------------------------------------------------------------- pieces

POOL = ["a", "b", "the", "hello", "  ", " ", "\t", "\n", "é", "ß", "ﬁ", "́", "😀", "▁", "漢字", "\x00", "　", "<s>",
        "</s>", "<0x41>", "ing", " World", "1234", "'s", "<unk>", "�", "\U0010ffff", ".,;", "$$$", "</", "://"]


def random_texts(rng, n):
    for _ in range(n):
        yield "".join(rng.choice(POOL) for _ in range(rng.randint(0, 14)))
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x800), rng.randrange(0x800, 0xd800),
                                      rng.randrange(0xe000, 0x110000)])) for _ in range(rng.randint(0, 20)))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.vocabulary_path())


def test_pieces_equal_the_library(spark, library):
    rng = random.Random(12)
    texts = list(random_texts(rng, 1500)) + ["ab" * 400, "x" * 3000, "漢" * 500, "  " * 300, "é" * 100 + "́" * 70]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentencepieces.encode_pieces(docs).collect():
        assert r.ids == library.encode(r.text, add_eos=True) and r.decoded == library.decode(r.ids)
        spans = [(p.begin, p.end) for p in library.encode(r.text, return_type="proto").pieces]
        assert list(zip(r.begins, r.ends)) == [*spans, (len(r.text.encode()),) * 2]


def test_scan_and_heap_merge_alike():
    found = sentencepieces.model(sentencepieces.vocabulary_path())
    rng = random.Random(4)
    for _ in range(2000):
        part = "".join(rng.choice("thelisnaou▁é") for _ in range(rng.randint(1, 40)))
        assert found._scan(part) == found._merge(part)


def test_any_ids_decode_like_the_library(library):
    found = sentencepieces.model(sentencepieces.vocabulary_path())
    rng = random.Random(3)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(4), 259]) for _ in range(rng.randint(0, 9))]
        assert found.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("extra", [True, False])
@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
def test_character_maps_equal_the_library(rule, extra):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=extra,
                                                   escape_whitespaces=True)
    chars = sentencepieces.CharacterMap(dict(sentencepieces._fields(theirs.serialized_normalizer_spec()))[2])
    ours = sentencepieces.Normalizer(chars, True, extra)
    rng = random.Random(7)
    pool = ["a", " ", "  ", "ﬁ", "Ａ", "①", "　", "¨", "é", "가", "각", "​", "\t", "Å", "½", "ｶﾞ", "㌀", "İ", "▁", "̀",
            "̈́", "ẛ̣"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) if rng.random() < .8 else chr(rng.randrange(0x80, 0xd800)) for _ in range(rng.randint(0, 10)))
        want, offsets = theirs.normalize(text, with_offsets=True)
        got, source = ours.normalize(text)
        place = {len(text[:i].encode()): i for i in range(len(text) + 1)}
        assert got == want
        assert [place[int(source[len(got[:i].encode())])] for i in range(len(got) + 1)] == offsets


def test_unbroken_text_is_not_quadratic():
    import time
    found = sentencepieces.model(sentencepieces.vocabulary_path())
    took = []
    for n in (50_000, 200_000):
        t = time.process_time()
        assert found.decode(found.encode("ab" * n)[0].tolist()) == "ab" * n
        took.append(time.process_time() - t)
    assert took[1] < 10 * took[0]


def test_pieces_odd_rows(spark, odd_docs, no_docs, library):
    odd = odd_docs.withColumn("begins", odd_docs.source)
    rows = sentencepieces.encode_pieces(odd).collect()
    assert len(rows) == 12
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_eos=True) and r.decoded == (r.text or "")
        assert r.ends[-1] == len((r.text or "").encode())
    assert sentencepieces.encode_pieces(no_docs).count() == 0


def test_op12_digests(spark, tmp_path, library):
    texts = ["hello world", "", None, " a  b ", "▁x 漢字 \U0001f600", "tab\tline\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op12_sentencepiece"](spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# ---------------------------------------------------------------- variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(n, ratio=2):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def groups(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(13)
    words = {}
    for _ in range(40):
        w = "".join(rng.choice("abcdeñéz") for _ in range(rng.randint(3, 9)))
        for _ in range(20):
            words[w] = rng.choice([1, 2, 3, 5, 8, 16, 40, 80])
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcdeñéz") + w[i:], w[:i] + rng.choice("abñ") + w[i + 1:]]) or "a"
    vocabulary = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = groups(spelling_variants.group_variants(vocabulary))
    assert got == brute_groups(words) and sum(v[0] is not None for v in got.values()) > 100


def test_neighbourhoods_are_whole():
    import numpy as np
    import pyarrow as pa
    words = ["abcab", "aaaa", "zebra", "x"]
    points, offsets = spelling_variants._letters(pa.array(words))
    got = [set() for _ in words]
    total = 0
    for row, key in spelling_variants._Sums(points, offsets).neighbours():
        total += len(row)
        for r, k in zip(row.tolist(), key.tolist()):
            got[r].add(k)
    assert total == sum(map(len, got))  # no repeats

    def key(symbols):
        sums = spelling_variants._Sums.__new__(spelling_variants._Sums)
        power = np.cumprod(np.array([1] + [spelling_variants._BASE] * (len(symbols) or 1), np.uint64), dtype=np.uint64)
        sums.total = np.array([(np.array(symbols, np.uint64) * power[:len(symbols)]).sum(dtype=np.uint64)], np.uint64)
        sums.size = np.array([len(symbols)], np.uint64)
        return int(sums.keys()[0])

    for w, found in zip(words, got):
        s = spelling_variants.reduced(np.array([ord(c) for c in w])).tolist()
        letters = range(1, spelling_variants.SYMBOLS + 1)
        want = {key(s)} | {key(s[:i] + s[i + 1:]) for i in range(len(s))}
        want |= {key(s[:i] + [c] + s[i + 1:]) for i in range(len(s)) for c in letters}
        want |= {key(s[:i] + [c] + s[i:]) for i in range(len(s) + 1) for c in letters}
        assert found == want


def test_chains_of_forms_and_long_words(spark):
    chain = {"a" * 5 + "b" * k: 3 * 2 ** k for k in range(12)}
    long = {"q" * 20_000: 5, "q" * 20_001: 50, "q" * 9_999 + "r" + "q" * 10_000: 7}
    rows = [*(chain | long).items(), (None, 4), ("zzzzz", None), ("twice", 2), ("twice", 3), ("twicx", 11)]
    got = groups(spelling_variants.group_variants(spark.createDataFrame(rows, "word string, n long")))
    want = brute_groups(chain | {"twice": 5, "twicx": 11})
    assert {w: v for w, v in got.items() if len(w) < 100} == want
    assert want["aaaaa"][1] == "a" * 5 + "b" * 11
    assert got["q" * 20_000] == ("q" * 20_001, "q" * 20_001, 5, 2, 50)
    odd = "q" * 9_999 + "r" + "q" * 10_000  # one edit from the 20,000, two from the 20,001
    assert got[odd] == (None, odd, 7, 1, None)


def test_op13_equals_brute_force(spark, tmp_path, odd_docs):
    rng = random.Random(14)
    base = ["".join(rng.choice("aeioulnrstñÉ") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    texts = {i: " ".join(rng.choice(base).title() + rng.choice(["", ",", "2", "÷"]) for _ in range(200)) for i in range(60)}
    rows = [*texts.items(), (3, "Twice twice TWICE"), (None, "twice zebras zebras zebras"), (99, None), (98, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n = collections.Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lost = 0
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(upper)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 97 == 0:
                w, lost = w[:h % len(w)] + w[h % len(w) + 1:], lost + 1
            n[w] += 1
    want = brute_groups({w: c for w, c in n.items() if len(w) >= 5 and c >= 3})
    got = groups(QUERIES["op13_spelling_variants"](spark, str(tmp_path)))
    assert got == want and lost > 20 and "zebras" in got


def test_variants_odd_rows(spark, odd_docs, no_docs):
    words = spelling_variants.words_of(odd_docs)
    assert words.columns == ["doc_id", "word"]
    got = groups(spelling_variants.group_variants(spelling_variants.count_words(words, 3, 2)))
    assert got["word"][2] == 60_000 and got["the"][2] == 12 and "x" * 100_000 not in got
    for empty in (no_docs, odd_docs.where("doc_id = 3")):
        assert groups(spelling_variants.group_variants(spelling_variants.count_words(spelling_variants.words_of(empty)))) == {}


def test_variants_are_never_broadcast(spark, monkeypatch):
    """Spark sizes the neighbours by the vocabulary's file, far too low: no join of words may go through the driver."""
    plans = []

    def plan_of(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    def watched(df, *rest):
        plan_of(df)
        return materialize(df, *rest)

    monkeypatch.setattr(spelling_variants, "materialize", watched)
    words = {"a" * 5 + "b" * k: 3 * 2 ** k for k in range(12)}
    result = spelling_variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    plan_of(result)
    assert groups(result) == brute_groups(words)
    assert len([p for p in plans if "SortMergeJoin" in p]) >= 4  # near words, forms, steps of roots, result
    assert not [p for p in plans if "Broadcast" in p]

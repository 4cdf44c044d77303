"""Operators on documents against brute force, on odd rows and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from semestra.llm import bpe, decontaminate, lang_id, minhash_dedup, sharding, substring_dedup, toxicity
from tests.llm.conftest import DOCS

WORDS = "ba be bi bo bu da de di do du ga ge gi go gu ka ke ki ko ku la le li lo lu ma me mi mo mu".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n))


def frame(spark, texts, lang=None):
    rows = [(i, t, lang[i] if lang else "en", "s", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts, percent):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_equals_brute_force(spark, percent):
    rng = random.Random(percent)
    base, texts = prose(rng, 120).split(), []
    for n in range(60):  # a group of near copies, some of them chained
        w = list(base)
        for _ in range(n % 6):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    texts += [prose(rng, rng.randint(1, 60)) for _ in range(40)] + ["", "same", "SAME", "a b", "a  B"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(frame(spark, texts), percent).collect()}
    assert got == brute_components(dict(enumerate(texts)), percent)


def test_minhash_odd_rows(spark, odd_docs, no_docs):
    out = minhash_dedup.near_duplicates(odd_docs)
    rows = out.collect()
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and len(rows) == 12
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by[1] == {(13, 1, True)} and by[2] == {(13, 1, False)} and by[None] == {(13, None, True), (0, None, True)}
    assert all(by[i] == {(0, i, True)} for i in (3, 4, 5)) and by[7] == {(1, 7, True)}
    assert minhash_dedup.near_duplicates(no_docs).count() == 0
    assert minhash_dedup.drop_near_duplicates(odd_docs).columns == odd_docs.columns


def test_minhash_links_any_text_of_a_doc_id(spark):
    rng = random.Random(8)

    def altered(text):
        w = text.split()
        w[rng.randrange(5, len(w) - 5)] = "changed"
        return " ".join(w)

    x = [prose(rng, 90) for _ in range(8)]
    rows = [(7, x[0]), (7, prose(rng, 300)), (9, altered(x[0])),  # near copy of one of two texts
            (3, x[1]), (20, x[1]), (20, x[2]), (21, altered(x[2])),  # 3 and 21 meet in the texts of 20
            (40, prose(rng, 200)), (50, x[7])] + [(30, t) for t in x[3:7]] + [(31 + i, altered(t)) for i, t in enumerate(x[3:7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in minhash_dedup.near_duplicates(docs, 80).collect():
        got[r.doc_id].add((r.component_id, r.kept))
    part = {7: 7, 9: 7, 3: 3, 20: 3, 21: 3, 40: 40, 50: 50} | {i: 30 for i in range(30, 35)}
    assert got == {i: {(c, i == c)} for i, c in part.items()}
    assert {r.doc_id for r in minhash_dedup.drop_near_duplicates(docs).collect()} == {7, 3, 40, 50, 30}


def test_sharding_equals_directory(spark, odd_docs, no_docs):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(300)] + ["z" * 9000]
    limit = 4000
    rows = sharding.shard(frame(spark, texts), limit=limit).collect()
    bits = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b") for i in range(len(texts))}
    size = {i: len(t.encode()) + sharding.ROW_BYTES for i, t in enumerate(texts)}
    for r in rows:
        for d in range(61):
            inside = [j for j in bits if bits[j][:d] == bits[r.doc_id][:d]]
            if sum(size[j] for j in inside) <= limit or len(inside) == 1:
                break
        want = bits[r.doc_id][:d] or "all"
        assert (r.shard, r.depth, r.shard_bytes) == (want, d, sum(size[j] for j in inside))
        assert r.oversize == (r.shard_bytes > limit)
    # One key with most rows is split by row numbers, and every shard fits.
    many = spark.createDataFrame([(7, "t" * 100)] * 400 + [(8, None)], "doc_id long, text string")
    rows = sharding.shard(many, limit=1000).collect()
    assert len(rows) == 401 and max(collections.Counter(r.shard for r in rows).values()) <= 1000 // 116
    assert sharding.shard(odd_docs).count() == 12 and sharding.shard(no_docs).count() == 0


def test_shards_are_written_and_read(spark, tmp_path):
    df = frame(spark, [f"text {i}" for i in range(50)])
    sharding.write_shards(df, str(tmp_path / "s"), limit=300)
    assert spark.read.parquet(str(tmp_path / "s")).select(df.columns).exceptAll(df).count() == 0


def test_substring_dedup_cuts_planted_passages(spark, odd_docs, no_docs):
    rng = random.Random(5)
    passage = ". ".join(prose(rng, 9).capitalize() for _ in range(7)) + "."
    line = prose(rng, 20)
    texts = [f"{prose(rng, 20)}\n{line}\n{prose(rng, 9)}" for _ in range(4)]
    texts += [f"{prose(rng, 15)} {passage} {prose(rng, 15)}" for _ in range(4)]
    texts += [f"Start {passage} {passage} end", "Short. Short. Ba be.", "Short. Short. Ba be."]
    rows = sorted(substring_dedup.dedup_substrings(frame(spark, texts)).collect())
    assert [r.doc_id for r in rows if line in r.text] == [0]
    assert [r.doc_id for r in rows if passage in r.text] == [4]
    for r in rows:
        old = texts[r.doc_id]
        assert substring_dedup.remove(old, [tuple(x) for x in r.removed]) == r.text
        cut = " ".join(old[a:b] for a, b in r.removed)
        assert cut == {0: "", 4: ""}.get(r.doc_id, line if r.doc_id < 4 else passage if r.doc_id < 8 else
                                         f"{passage} {passage}" if r.doc_id == 8 else "")
    rows = substring_dedup.dedup_substrings(odd_docs).collect()
    texts = collections.Counter((r.doc_id, r.text) for r in rows)
    base = odd_docs.where("doc_id = 1").first().text
    assert texts[1, base] == 2 and texts[2, ""] == 1 and texts[None, ""] == 1 and texts[3, None] == 1 and len(rows) == 12
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_substring_dedup_cuts_short_units_and_whole_lines(spark):
    rng = random.Random(6)
    fruit = "Fresh Green Apples Ripe Red Cherries Sweet Plums Sour Limes Small Figs".split()
    block = "\n".join(" ".join(rng.choices(fruit, k=3)) for _ in range(21))  # 63 words, each a unit of its own
    line = prose(rng, 9)
    chorus = "go home"
    texts = [f"{prose(rng, 12)}\n{block}\n{prose(rng, 12)}" for _ in range(3)]
    texts += [f"{prose(rng, 12)}\n{line}\n{prose(rng, 12)}" for _ in range(3)]
    texts += [f"{prose(rng, 12)}\n" + f"{chorus}\n" * 40 + prose(rng, 12)]
    texts += [" ".join(rng.choices(fruit, k=40)) for _ in range(2)]  # repeated units in an order of their own
    rows = sorted(substring_dedup.dedup_substrings(frame(spark, texts)).collect())
    cut = [[texts[r.doc_id][a:b] for a, b in r.removed] for r in rows]
    assert cut[:6] == [[], [block], [block], [], [line], [line]]
    assert rows[6].text.count(chorus) == 8 and cut[7:] == [[], []]


def test_bpe_equals_library(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(7)
    signs = "abetion THé'ß1!?<|🙂ñÁΣİ½\x1c\u00a0\u3000́"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 50))) for _ in range(1500)]
    texts += [prose(rng, 50), "a<|endoftext|>b <|startoftext|><|EndOfText|>", "aaaa" * 99, "don't we'LL 's", "日本語 é"]
    for r in bpe.encode_documents(frame(spark, texts)).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    rows = bpe.encode_documents(odd_docs).collect()
    assert len(rows) == 12 and all((r.ids, r.decoded) == ([], "") for r in rows if r.doc_id in (3, 4, 5))
    assert bpe.encode_documents(no_docs).count() == 0


def test_automaton_is_exact_on_small_merges():
    import itertools
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "b"), ("ba", "ba"), ("ab", "ab"), ("b", "b")]
    vocab = {t: i for i, t in enumerate(dict.fromkeys(["a", "b", *(u + v for u, v in merges)]))}
    made = bpe.Automaton(vocab, merges, "")

    def plain(word):
        word = list(word)
        for u, v in merges:
            i = 0
            while i < len(word) - 1:
                if (word[i], word[i + 1]) == (u, v):
                    word[i:i + 2] = [u + v]
                i += 1
        return [vocab[t] for t in word]

    for n in range(1, 12):
        for w in itertools.product("ab", repeat=n):
            assert made.encode("".join(w)) == plain(w), w


def edits(a, b):
    """Least edits of ``a`` within some region of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_finds_planted_items(spark, odd_docs, no_docs):
    rng = random.Random(9)
    items = [prose(rng, 25).capitalize() + "." for _ in range(6)] + ["", None, "too short"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts, want = [], set()
    for n in range(40):
        body = prose(rng, 40)
        if n < 6:
            body = f"{body} {items[n].upper()} {prose(rng, 30)}"
        elif n < 18:  # a letter changed, dropped or added here and there
            t = list(items[n % 6])
            for at in range(20, len(t), 45):
                t[at] = rng.choice(["", "q", t[at] + "w"])
            body = f"{body}\n{''.join(t)} {prose(rng, 30)}"
        if n < 18:
            want.add((n, n % 6))
        texts.append(body)
    rows = decontaminate.leaked_regions(frame(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    squeeze = lambda t: re.sub(r"[^a-z0-9]", "", t.lower())
    for r in rows:
        region, item = squeeze(texts[r.doc_id][r.start:r.end]), squeeze(items[r.item_id])
        assert edits(region, item) <= 2 * 3 and abs(len(region) - decontaminate.WINDOW) <= 3
    kept = decontaminate.drop_leaked(frame(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(18, 40))
    assert decontaminate.leaked_regions(odd_docs, bench).count() == 0
    assert decontaminate.drop_leaked(odd_docs, bench).count() == 12
    assert decontaminate.leaked_regions(no_docs, bench).count() == 0
    assert decontaminate.leaked_regions(odd_docs, bench.limit(0)).count() == 0


def test_banded_alignment_equals_plain():
    import numpy as np
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(2))
        cost, start, end = decontaminate.banded(np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8))
        assert cost == edits(a, b) and 0 <= start <= end <= len(b)


def test_toxicity_on_held_out_documents(spark, odd_docs, no_docs):
    rng = random.Random(11)
    bad = ["zorg", "zorgle", "vraxi", "vraxon", "quelp"]
    texts, toxic = [], []
    for n in range(400):
        words = prose(rng, rng.randint(20, 300)).split()
        if n % 4 == 0:
            for _ in range(rng.randint(1, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        toxic.append(int(n % 4 == 0))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic) if i < 300] + [(None, 1), (9999, 0), (5, None)],
                                   "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = toxicity.grade_documents(docs, model).collect()
    held = [r for r in rows if r.doc_id >= 300]
    assert all(r.rejected == bool(toxic[r.doc_id]) for r in held)
    assert all(0 <= r.severity <= toxicity.GRADES - 1 for r in rows)
    assert sorted(r.doc_id for r in toxicity.drop_toxic(docs, model).collect() if r.doc_id >= 300) == \
        [i for i in range(300, 400) if not toxic[i]]
    rows = toxicity.grade_documents(odd_docs, model).collect()
    assert len(rows) == 12 and not any(r.rejected for r in rows)
    nothing = toxicity.fit_on(docs, labels.limit(0))
    assert not any(r.rejected for r in toxicity.grade_documents(docs, nothing).collect())
    assert toxicity.grade_documents(no_docs, model).count() == 0


def test_language_of_held_out_documents(spark, odd_docs, no_docs):
    rng = random.Random(13)
    sound = {"aa": WORDS[:12], "bb": WORDS[12:24], "cc": WORDS[24:]}
    langs = [rng.choice(list(sound)) for _ in range(300)]
    texts = [" ".join("".join(rng.choices(sound[x], k=2)) for _ in range(40)) for x in langs]
    docs = frame(spark, texts, langs)
    model = lang_id.fit_on(docs, sample=150)
    rows = lang_id.predict_languages(docs, model).withColumn("held_out", lang_id.held_out(docs.doc_id)).collect() \
        if False else lang_id.predict_languages(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r.lang_pred for r in lang_id.predict_languages(odd_docs, model).collect()}
    assert len(odd) == 10 and all(odd[i] == "und" for i in (3, 4, 5, 8)) and odd[7] in sound and odd[9] in sound
    assert lang_id.predict_languages(no_docs, model).count() == 0 and lang_id.fit_on(no_docs) is None
    assert {r.lang_pred for r in lang_id.predict_languages(docs, None).collect()} == {"und"}
    assert docs.select(lang_id.held_out(docs.doc_id).alias("h")).where("h").count() == len(held)

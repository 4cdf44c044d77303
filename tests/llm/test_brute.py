"""Substring dedup, toxicity and language scores against plain code."""

import collections
import math
import random
import re

import numpy as np

from semestra.llm import decontaminate, lang_id, substring_dedup, toxicity
from tests.llm.test_documents import frame, prose

# ---------------------------------------------------------------- passages

UPPER = re.compile("[A-ZÀ-Þ]")


def plain_units(text):
    """(start, end, words, begins a line, ends a line) of every unit, by characters."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out = []
    for i, (a, b, w) in enumerate(words):
        head = i == 0 or "\n" in text[words[i - 1][1]:a]
        after = text[a + 1:a + 2]
        upper, follow = bool(UPPER.match(w)), bool(re.match("[A-Z]", after))
        stop = i > 0 and words[i - 1][2][-1] in ".!?"
        if head or (upper and not follow) or (stop and not (upper and follow)):
            out.append([a, b, [], head, False])
        out[-1][1] = b
        out[-1][2].append(w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        last = i + 1 == len(words) or "\n" in text[b:words[i + 1][0]]
        out[-1][4] = last
    return [(a, b, tuple(w), h, e) for a, b, w, h, e in out]


def plain_spans(texts):
    """The spans cut from every text, each looked for in all others."""
    docs = [plain_units(t) for t in texts]
    times, first = collections.Counter(), {}
    for d, us in enumerate(docs):
        for u in us:
            times[u[2]] += 1
            first.setdefault(u[2], d)
    wide_of, wide_times, wide_first = [], collections.Counter(), {}
    for d, us in enumerate(docs):
        again = [times[u[2]] > 1 for u in us]
        found = []
        for i in range(len(us)):
            size, j = 0, i
            while j < len(us) and again[j] and size < substring_dedup.MIN_RUN:
                size += len(us[j][2])
                j += 1
            if size >= substring_dedup.MIN_RUN and any(len(u[2]) < substring_dedup.MIN_UNIT for u in us[i:j]):
                found.append((i, j, ("window", *(u[2] for u in us[i:j]))))
            if us[i][3]:
                j = i
                while not us[j][4]:
                    j += 1
                if all(again[i:j + 1]) and sum(len(u[2]) for u in us[i:j + 1]) >= substring_dedup.MIN_LINE:
                    found.append((i, j + 1, ("line", *(u[2] for u in us[i:j + 1]))))
        wide_of.append(found)
        for _, _, what in found:
            wide_times[what] += 1
            wide_first.setdefault(what, d)
    out = []
    for d, us in enumerate(docs):
        cut, seen, run = set(), set(), []

        def settle():
            if sum(len(us[i][2]) for i in run if len(us[i][2]) >= substring_dedup.MIN_UNIT) >= substring_dedup.MIN_RUN:
                cut.update(run)
            run.clear()

        for i, u in enumerate(us):
            if times[u[2]] < 2 or (first[u[2]] == d and u[2] not in seen):
                settle()
            else:
                run.append(i)
            seen.add(u[2])
        settle()
        there = {}
        for i, j, what in wide_of[d]:
            if wide_times[what] > 1:
                if wide_first[what] != d:
                    cut.update(range(i, j))
                elif what in there:
                    cut.update(range(max(i, there[what]), j))
                else:
                    there[what] = j
        spans = []
        for i in sorted(cut):
            if i - 1 in cut:
                spans[-1][1] = us[i][1]
            else:
                spans.append([us[i][0], us[i][1]])
        out.append([tuple(s) for s in spans])
    return out


def test_substring_dedup_equals_plain_search(spark):
    rng = random.Random(30)

    def sentence(n):
        return prose(rng, n).capitalize() + rng.choice([".", "!", "", "?"])

    shared = [sentence(rng.randint(1, 12)) for _ in range(25)]
    lines = [prose(rng, rng.randint(1, 9)) for _ in range(8)]
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(0, 14)):
            parts.append(rng.choice([rng.choice(shared), rng.choice(shared), sentence(rng.randint(1, 10)), rng.choice(lines)]))
            parts.append(rng.choice([" ", " ", "\n", "  ", " ÉTÉ ", " OK Is ÀB "]))
        texts.append("".join(parts))
    texts += ["".join(rng.choice(shared) + " " for _ in range(30)), (lines[0] + "\n") * 12, " ".join(shared[:6] * 4)]
    want = plain_spans(texts)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame(spark, texts)).collect()}
    for i, spans in enumerate(want):
        assert [(x.start, x.end) for x in got[i].removed] == spans, texts[i]
        assert got[i].text == substring_dedup.remove(texts[i], spans)
    assert sum(map(len, want)) > 25


# ---------------------------------------------------------------- toxicity


def test_toxicity_scores_equal_the_plain_formula(spark):
    rng = random.Random(31)
    bad = ["vile", "awful", "hateful", "stupid"]
    texts, toxic = [], []
    for i in range(200):
        words = prose(rng, 30).split()
        if i % 3 == 0:
            for w in rng.sample(bad, rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), w)
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    model = toxicity.fit(texts, toxic)
    assert model.weights and list(model.thresholds) == sorted(model.thresholds)
    rows = {r.doc_id: r for r in toxicity.grade_documents(frame(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        found = toxicity.text_features(text)
        score = sum(model.weights.get(f, 0.0) * v for f, v in found.items())
        above = [1 / (1 + math.exp(-max(-50, min(50, score - t)))) for t in model.thresholds]
        mass = [a - b for a, b in zip([1, *above], [*above, 0])]
        assert math.isclose(rows[i].severity, sum(g * p for g, p in enumerate(mass)), rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(rows[i].p_toxic, above[0], rel_tol=1e-6, abs_tol=1e-9)
        assert rows[i].grade == max(range(len(mass)), key=lambda g: mass[g])
        assert rows[i].rejected == bool(toxic[i])

    def loss(weights, cuts):
        """Cumulative-link likelihood of 'toxic or not', classes weighed alike."""
        out = 0.0
        for text, y in zip(texts, toxic):
            s = sum(weights.get(f, 0.0) * v for f, v in toxicity.text_features(text).items())
            p = 1 / (1 + math.exp(-max(-50, min(50, s - cuts[0]))))
            out -= math.log(max(1e-12, p if y else 1 - p)) / (toxic.count(1) if y else toxic.count(0))
        return out

    fitted = loss(model.weights, model.thresholds)
    assert fitted < 0.2
    for _ in range(20):
        worse = {f: w * rng.choice([0, 0.3, -1]) for f, w in model.weights.items()}
        assert loss(worse, model.thresholds) > fitted


# ---------------------------------------------------------------- language


def test_language_scores_equal_a_plain_forward_pass(spark):
    rng = random.Random(32)
    alphabets = {"aa": "abcdeé ", "bb": "vwxyzñ ", "cc": "klmnop "}
    texts = ["".join(rng.choice(alphabets[x]) for _ in range(rng.randint(20, 200))) for x in alphabets for _ in range(60)]
    langs = [x for x in alphabets for _ in range(60)]
    model = lang_id.fit(texts, langs)
    probes = texts[::7] + ["", "a", "ab", "Abé", "123 !!", "wx" * 4000, "漢字"]
    rows = {r.doc_id: r for r in lang_id.predict_languages(frame(spark, probes), model).collect()}
    for i, text in enumerate(probes):
        raw = text.encode()
        buckets = [int(lang_id.gram_buckets(np.frombuffer(raw[j:j + n], np.uint8), n)[0])
                   for n in lang_id.GRAMS for j in range(len(raw) - n + 1)]
        logits = [sum(float(model.table[b, k]) for b in buckets) / max(1, len(buckets)) + float(model.bias[k])
                  for k in range(len(model.languages))]
        e = [math.exp(x / model.temperature) for x in logits]
        p = [x / sum(e) for x in e]
        if any(c.isalpha() for c in text):
            assert rows[i].lang_pred == model.languages[p.index(max(p))] and math.isclose(rows[i].score, max(p), rel_tol=1e-6)
        else:
            assert (rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True)
    right = [rows[i].lang_pred == x for i, x in enumerate(langs[::7])]
    assert sum(right) >= 0.95 * len(right)


# ---------------------------------------------------------------- benchmark


def test_index_holds_its_memory_and_finds_what_a_plain_search_finds():
    rng = random.Random(33)
    items = [(i, prose(rng, rng.randint(8, 60))) for i in range(120)]
    index = decontaminate.Index(items)
    assert index.sieve.nbytes <= 1 << (decontaminate.SIEVE_BITS - 3) and index.pos.itemsize == index.item.itemsize == 4
    for _ in range(60):
        text = prose(rng, rng.randint(0, 80))
        item = rng.choice(items)[1]
        if rng.random() < 0.7:
            text += " " + item + " " + prose(rng, 20)
        data = np.frombuffer(text.encode(), np.uint8)
        squeezed, _ = decontaminate.squeeze(data)
        there = collections.defaultdict(list)
        for j in range(len(squeezed) - decontaminate.Q + 1):
            there[bytes(squeezed[j:j + decontaminate.Q])].append(j)
        want = sorted((j, i, p) for i, t in enumerate(index.texts) for p in range(len(t) - decontaminate.Q + 1)
                      for j in there.get(bytes(t[p:p + decontaminate.Q]), ()))
        at, it, pos = index.hits(squeezed)
        assert sorted(zip(at.tolist(), it.tolist(), pos.tolist())) == want

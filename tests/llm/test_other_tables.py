"""Embeddings, pages and conversations against brute force, on odd rows too."""

import json
import random
import re
from collections import Counter

import numpy as np

from semestra.llm import cover_tree, tool_calls, url_filter
from semestra.llm.components import connected_components


def brute_links(rows, limit):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: [j for j in ok if i != j and len(ok[i]) == len(ok[j])
                 and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= limit] for i in ok}
    comp = {i: i for i, _ in rows}
    for _ in rows:
        for i in links:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    return {i: (len(links.get(i, [])), comp[i], comp[i] == i) for i, _ in rows}


def test_cover_tree_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 60)  # several cells and blocks, and real subtrees
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.5])).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(30)]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [None] + [1.0] * 7), (504, [float("nan")] + [1.0] * 7),
             (505, [float("inf")] + [1.0] * 7), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (508, [-1.0, 2.0])]
    got = {r.vec_id: tuple(r)[1:] for r in cover_tree.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_links(rows, 0.95)


def test_subtrees_cover_and_halve():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(3000, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    stack = [cover_tree.subtree(u, np.arange(len(u)))]
    assert stack[0].children
    while stack:
        node = stack.pop()
        assert cover_tree.distances(u[node.rows], node.centre[None]).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            assert all(c.radius <= node.radius / 2 + 1e-9 for c in node.children)
        stack += node.children


def test_vectors_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], None)]
    got = sorted(map(tuple, cover_tree.near_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True)]
    assert cover_tree.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (70, 71), (71, 70)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1300), 1000), 70: 70, 71: 70}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_urls(spark):
    urls = {1: "http://A.Example.NET/en/x?utm_source=f", 2: "https://a.example.net/en/x/", 3: "http://b.example.com/de/1",
            4: "http://b.example.com/fr/1#t", 5: "https://x.org/fr/", 6: "http://net/q", 7: "http://net", 8: None, 9: "nohost",
            10: "", 11: "http://x.org/p?b=2&a=1&ref=z", 12: "http://www.x.org/p/?a=1&b=2#f", 13: "x://h.biz?a://b/c", 14: "http://planet/",
            15: "http://notexample.net/en/"}
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in urls.items()], "page_id long, url string, host string, block int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in
           url_filter.judge_urls(pages, url_filter.repeated_urls(pages)).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("a.example.net", "/en/x/", "example.net/en/", "allow"),
        3: ("b.example.com", "/de/1", "example.com/de/", "block"), 4: ("b.example.com", "/fr/1", None, "allow"),
        5: ("x.org", "/fr/", "org/fr/", "allow"), 6: ("net", "/q", "net/", "block"), 7: ("net", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"),
        11: ("x.org", "/p", None, "block"), 12: ("www.x.org", "/p/", None, "block"), 13: ("h.biz", "", None, "allow"),
        14: ("planet", "/", None, "allow"), 15: ("notexample.net", "/en/", "net/", "block")}
    none = pages.limit(0)
    assert url_filter.judge_urls(none, url_filter.repeated_urls(none)).count() == 0


def test_bloom_has_no_false_negative_and_few_positives(spark):
    url = lambda i: f"h{i}.biz/p"
    listed = spark.createDataFrame([(url(i),) for i in range(500)], "canonical string")
    pages = spark.createDataFrame([(i, url(i)) for i in range(2000)] + [(9999, None)], "page_id long, canonical string")
    got = {r.page_id: r.listed for r in url_filter.listed_urls(pages, listed).collect()}
    assert got == {**{i: i < 500 for i in range(2000)}, 9999: False}


def test_tool_calls_link_order_and_validate(spark):
    args = lambda **x: json.dumps(x)
    schemas = {"add": {"type": "object", "required": ["x"], "additionalProperties": False,
                       "properties": {"x": {"type": "integer", "minimum": 0}, "u": {"type": "string", "enum": ["a", "b"]}}}}
    calls = spark.createDataFrame([
        (1, 3, "c", "add", args(x=1, u="a"), ["b"]), (1, 1, "a", "add", args(u="b", x=2), []), (1, 2, "b", "add", args(x=-1), ["a"]),
        (1, 2, "b", "add", args(x=-1), ["a"]), (1, 4, "p", "add", args(x=1), ["q"]), (1, 5, "q", "add", args(x=1), ["p"]),
        (2, 1, "a", "sub", args(x=1), None), (2, 2, "z", "add", "no json", ["missing"]), (None, 1, "n", "add", args(x=1), []),
        (2, 3, None, "add", args(x="1", w=1), [])], "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, 9, "a", "ra"), (1, 9, "a", "ra"), (1, 9, "c", None), (2, 9, "lost", "r")],
                                    "conv_id long, turn long, call_id string, content string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert len(got) == 10
    level = lambda *k: (got[k].level, got[k].status, got[k].valid, got[k].copies)
    assert level(1, "a") == (0, "linked", True, 1) and level(1, "b") == (1, "pending", False, 2)
    assert level(1, "c") == (2, "linked", True, 1) and level(1, "p")[0] is None and level(1, "q")[0] is None
    assert got[1, "a"].record == '{"arguments":{"u":"b","x":2},"id":"a","name":"add","result":"ra"}'
    assert got[1, "b"].errors == ["$.x: minimum"] and got[1, "p"].errors == ["$: unsettled dependency"]
    assert got[2, "a"].errors == ["$: unknown tool"] and got[2, "z"].errors == ["$: type object", "$: unknown dependency"]
    assert got[2, "lost"].status == "orphan" and got[2, "lost"].record == '{"id":"lost","result":"r"}'
    assert got[None, "n"].errors[0] == "$: no identifier"
    assert got[2, None].errors == ["$: no identifier", "$.w: unknown", "$.x: type integer"]
    assert tool_calls.link_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_conversations_become_calls(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"say {c} {t}", "x") for c in range(3) for t in range(2, 8)]
    rows += [(9, 2, "assistant", None, "x"), (None, 4, "assistant", "q", None), (9, 3, None, "q", None), *rows[:3]]
    random.Random(0).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, level string")
    out = {(r.conv_id, r.call_id): r for r in tool_calls.link_calls(*tool_calls.calls_of_conversations(turns), tool_calls.SCHEMAS).collect()}
    assert [(out[1, f"call_{t}"].level, out[1, f"call_{t}"].status, out[1, f"call_{t}"].valid) for t in (2, 4, 6)] == \
        [(0, "linked", True), (1, "linked", True), (2, "linked", True)]
    assert json.loads(out[1, "call_4"].record)["result"] == "say 1 5"
    assert out[9, "call_2"].errors == ["$.text: minLength"] and out[9, "call_2"].status == "pending"


def test_levels_are_dependency_depths(spark):
    rng = random.Random(11)
    after = {(1, f"c{i:02}"): [f"c{i - 1:02}"] if i else [] for i in range(40)}  # a chain, in turn order
    after |= {(2, f"c{i:02}"): [f"c{i + 1:02}"] if i < 20 else [] for i in range(21)}  # against it
    after |= {(3, f"c{i:02}"): [f"c{j:02}" for j in rng.sample(range(i), min(i, rng.randint(0, 3)))] for i in range(40)}
    after |= {(4, "a"): ["b"], (4, "b"): ["c"], (4, "c"): ["a"], (4, "d"): ["c"], (4, "e"): ["d", "f"], (4, "f"): [],
              (4, "g"): ["g"], (4, "h"): ["f", "lost"], (4, "i"): ["h"], (4, "j"): ["i", "f"], (4, "k"): ["e"]}

    def depth(conv, cid, above=()):
        if cid in above:
            return None
        below = [depth(conv, d, (*above, cid)) for d in after[conv, cid] if (conv, d) in after]
        return None if None in below else max(below, default=-1) + 1

    rows = [(conv, int(re.sub(r"\D", "", cid) or 0), cid, "t", "{}", deps) for (conv, cid), deps in after.items()]
    rng.shuffle(rows)
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    got = {(r.conv_id, r.call_id): r.level for r in tool_calls.link_calls(calls, results, {"t": {}}).collect()}
    assert got == {k: depth(*k) for k in after}


def test_levels_of_conversations(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"say {t}") for t in range(2, 40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = tool_calls.link_calls(*tool_calls.calls_of_conversations(turns), tool_calls.SCHEMAS)
    assert {r.turn: r.level for r in out.collect()} == {t: t // 2 - 1 for t in range(2, 40, 2)}


def test_rows_without_identifier_are_all_returned(spark):
    calls = spark.createDataFrame([(1, t, None, "t", json.dumps({"x": t % 3}), []) for t in range(5)] +
                                  [(None, t, "a", "t", json.dumps({"x": t}), []) for t in range(4)] + [(1, 9, "a", "t", "{}", [])],
                                  "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, t, None, f"r{t}") for t in range(3)] + [(None, 1, "a", "s"), (None, 1, "a", "s"), (1, 10, "a", "ra")],
                                    "conv_id long, turn long, call_id string, content string")
    rows = tool_calls.link_calls(calls, results, {"t": {}}).collect()
    assert len(rows) == 15 and {r.copies for r in rows} == {1}
    bad = [r for r in rows if r.conv_id is None or r.call_id is None]
    assert len(bad) == 14 and all(r.errors == ["$: no identifier"] and not r.valid and r.level is None for r in bad)
    said = Counter((r.status, r.turn, json.loads(r.record).get("arguments", {}).get("x"), json.loads(r.record)["result"] or "") for r in bad)
    assert said == Counter([("pending", t, t % 3, "") for t in range(5)] + [("pending", t, t, "") for t in range(4)]
                          + [("orphan", t, None, f"r{t}") for t in range(3)] + [("orphan", 1, None, "s")] * 2)


def test_odd_arguments_are_errors_not_crashes(spark):
    schemas = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}}}
    deep = '{"x":' * 200_000 + "1" + "}" * 200_000
    texts = [deep, "[" * 200_000, '{"x":"\\ud800"}', '{"x":NaN}', '{"x":1e400}', '{"x":-Infinity}', '{"x":1.0}', '{"x":1.5}',
             '{"x":"\\ud83d\\ude00"}', '{"y":"' + "long " * 200_000 + '"}', "", None, "7", '{"x":' + "9" * 5000 + "}"]
    calls = spark.createDataFrame([(1, 5, f"c{i:02}", "f", t, []) for i, t in enumerate(texts)],
                                  "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, 5, f"c{i:02}", "�") for i in range(len(texts))],
                                    "conv_id long, turn long, call_id string, content string")
    got = {int(r.call_id[1:]): r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert [got[i].errors for i in range(6)] == [["$: too deep"]] * 2 + [["$: lone surrogate"]] + [["$: not finite"]] * 3
    assert [got[i].valid for i in (6, 7, 8, 9)] == [True, False, False, True]
    assert got[7].errors == got[8].errors == ["$.x: type integer"]
    assert all(got[i].errors == ["$: type object"] for i in (10, 11, 12, 13))
    for r in got.values():
        json.loads(r.record)  # the record is JSON in any case


def test_linking_equals_plain_code(spark):
    rng = random.Random(21)
    schemas = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}}}
    calls, results = [], []
    for conv in range(12):
        for i in range(rng.randint(1, 9)):
            named = [f"c{rng.randrange(9)}" for _ in range(rng.randint(0, 2))]
            for _ in range(rng.choice([1, 1, 2])):
                calls.append((conv, rng.randint(0, 3), f"c{i}", rng.choice(["f", "g"]), json.dumps({"x": rng.choice([1, -1, "a"])}), named))
        for _ in range(6):
            results.append((conv, rng.randint(0, 3), f"c{rng.randrange(11)}", rng.choice(["p", "q", None])))
    out = {(r.conv_id, r.call_id): r for r in tool_calls.link_calls(
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), schemas).collect()}
    first, said = {}, {}
    for c in calls:
        k = (c[0], c[2])
        first[k] = min([c, first[k]], key=lambda r: (r[1], r[3], r[4], r[5])) if k in first else c
    for r in results:
        k, rank = (r[0], r[2]), (r[1], r[3] is not None, r[3] or "")  # null first
        said[k] = min(rank, said.get(k, rank))

    def depth(k, above=()):
        if k in above:
            return None
        below = [depth((k[0], n), (*above, k)) for n in first[k][5] if (k[0], n) in first]
        return None if None in below else max((d + 1 for d in below), default=0)

    assert set(out) == set(first) | set(said)
    for k, r in out.items():
        assert r.status == ("orphan" if k not in first else "linked" if k in said else "pending")
        if k in first:
            _, turn, _, name, text, named = first[k]
            assert (r.turn, r.name, r.level) == (turn, name, depth(k))
            assert r.copies == sum((c[0], c[2]) == k for c in calls)
            x = json.loads(text)["x"]
            good = name == "f" and x == 1 and depth(k) is not None and all((k[0], n) in first for n in named)
            assert r.valid == good
            assert json.loads(r.record) == {"id": k[1], "result": said[k][2] if k in said and said[k][1] else None,
                                            "arguments": {"x": x}, "name": name}

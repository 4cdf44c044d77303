"""A Python worker goes on to other tasks: what one held is given back."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from semestra.llm import hashing, workers

ROOT = Path(__file__).resolve().parents[2]
GROWTH = """
import random, re, sys
import pyarrow as pa
from semestra.llm import decontaminate, minhash_dedup, substring_dedup

class Table:  # stands for a DataFrame: the function of its tasks is what counts
    columns, schema = ["doc_id", "text"], None
    def select(self, *columns): return self
    def mapInArrow(self, run, schema): return run

class Shared:
    value = decontaminate.Index([(1, "an item that no document holds, of some length")])

def held():
    return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

minhash_dedup.F = substring_dedup.F = type("F", (), {"__getattr__": lambda s, n: lambda *a: s})()
substring_dedup._identity = lambda: ()
rng = random.Random(5)
words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
texts = [" ".join(rng.choices(words, k=300)) for _ in range(6000)]
ids = pa.array(range(len(texts)))
two = pa.RecordBatch.from_arrays([ids, pa.array(texts)], names=["doc_id", "text"])
three = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["rank", "rid", "text"])
before = held()
for run, batch in ((minhash_dedup.sketches(Table()), two), (minhash_dedup.shingle_sets(Table()), two),
                   (substring_dedup.document_units(Table()), three), (decontaminate._filter(Table(), Shared, 1), two)):
    for out in run(iter([batch])):
        pass
    del out
    print(held() - before)
"""


def test_tasks_leave_no_memory_behind():
    got = subprocess.run([sys.executable, "-c", GROWTH], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr
    grown = [float(x) for x in got.stdout.split()]
    assert len(grown) == 4 and max(grown) < 20, grown


def test_tidy_runs_whole_and_forgets_at_the_end_also_of_a_broken_task():
    def run(batches):
        hashing._powers(10)
        for batch in batches:
            yield batch
            if batch.num_rows == 1:
                raise ValueError("broken")

    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["a"]) for n in (5, 0, 3)]
    assert [len(b) for b in workers.tidy(run)(iter(batches))] == [5, 0, 3]
    assert [len(p) for p in hashing._POWERS] == [1, 1]
    try:
        list(workers.tidy(run)(iter([batches[0].slice(0, 1)])))
    except ValueError:
        assert [len(p) for p in hashing._POWERS] == [1, 1]
    else:
        raise AssertionError("the error was lost")


def test_slices_hold_every_row_in_order():
    n = 2 * workers.SLICE_ROWS + 7
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b))], names=["a"]) for a, b in ((0, 0), (0, n), (n, n + 1))]
    got = [b.column(0).to_numpy() for b in workers.sliced(iter(batches))]
    assert np.concatenate(got).tolist() == list(range(n + 1)) and max(map(len, got)) <= workers.SLICE_ROWS


def test_hashes_do_not_depend_on_the_chunk(monkeypatch):
    column = pa.array(["one two three four five six", None, "", "ümlaut wörter hier stehen jetzt da", "x " * 400])
    sets = []
    for size in (7, 1 << 19, 2 << 20):
        monkeypatch.setattr(hashing, "CHUNK_BYTES", size)
        sets.append([s.tolist() for _, raw, offsets in hashing.text_chunks(column) for s in hashing.shingles(raw, offsets, 5)])
    assert sets[0] == sets[1] == sets[2] and [len(s) for s in sets[0]] == [2, 0, 0, 2, 1]

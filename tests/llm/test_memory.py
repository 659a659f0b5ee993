"""Memory of a Python worker in the pipeline's stages, in a process of its own."""

import subprocess
import sys
from pathlib import Path

import pytest

START = """
import re, tempfile, tracemalloc
import numpy as np
import pyarrow as pa
from sigloom.llm import decontaminate, pii, simhash

class Value:
    def __init__(self, value):
        self.value = value

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10

def batches(rows):
    names = [f"w{k:05d}" for k in range(20_000)]
    for at in range(0, rows, 6_000):
        n = min(rows - at, 6_000)
        picks = np.random.default_rng(at).integers(0, len(names), (n, 600))
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(range(at, at + n)), "text": [" ".join(names[k] for k in p) for p in picks]})

def sent(rows):
    file = tempfile.TemporaryFile()
    with pa.ipc.new_stream(file, pa.schema([("doc_id", pa.int64()), ("text", pa.string())])) as out:
        for b in batches(rows):
            out.write_batch(b)
    return file

def read(file):
    file.seek(0)
    return pa.ipc.open_stream(file)  # a Python file, as in a worker

item = pa.RecordBatch.from_pydict({"item_id": ["a"], "text": [" ".join(f"w{k:05d}" for k in range(20))]})
windows = next(iter(decontaminate._item_windows([item]))).to_pandas()
block = decontaminate._arrays(windows.rename(columns={"item": "items"}).assign(shingle=[s[0] for s in windows["shingles"]], at=0))
screen = Value(pii.Screen(np.ones(1 << 10)))
tasks = {
    "fingerprints": lambda: simhash._with_fingerprint(["doc_id"], "fp"),
    "scan": lambda: decontaminate._scan([Value(block)], drop=True),
    "counts": lambda: pii._counted(pii._known_terms(screen), "term"),
}
"""


def run(code: str) -> int:
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", START + code], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return int(done.stdout)


@pytest.mark.parametrize("task", ["fingerprints", "scan", "counts"])
def test_a_finished_task_holds_no_batch(task):
    code = f"""
small, large = sent(50), sent(6_000)
list(tasks["{task}"]()(read(small)))
before = held()
for _ in range(2):
    for _ in tasks["{task}"]()(read(large)):
        pass
    del _
print(held() - before)
"""
    assert run(code) < 30


def test_one_block_is_matched_piece_by_piece():
    code = """
rows = list(batches(6_000))
tracemalloc.start()
assert sum(b.num_rows for b in tasks["scan"]()(rows)) == 6_000
print(tracemalloc.get_traced_memory()[1] >> 20)
"""
    assert run(code) < 70

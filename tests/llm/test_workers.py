"""Queries with Python workers in a process whose workers cannot import the package."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
RUN = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as contract
from tidewrack.session import local_session
spark = local_session(4, 4)

def alone(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("tidewrack") is None])], names=["alone"])

assert all(r.alone for r in spark.range(4).mapInArrow(alone, "alone boolean").collect())
for name in {names!r}:
    rows = contract.queries()[name](spark, {folder!r}).collect()
    print(name, len(rows), flush=True)
"""


@pytest.mark.parametrize(
    "names",
    [
        ("op9_quality_scores", "op10_masked_likelihood", "op2_warc_chunks", "op4_nearest_neighbours"),
        ("op11_near_vectors", "op12_whitened_vectors", "op13_ranked_documents", "op6_repeated_passages"),
        ("pipeline", "r4_roster_counts"),
    ],
)
def test_workers_need_no_copy_of_the_package(tmp_path, small, names):
    code = RUN.format(root=str(ROOT), names=names, folder=small)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.split()[:1] and line.split()[0] in names] == list(names)

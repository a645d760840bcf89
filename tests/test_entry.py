"""The driver contract holds with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in e.queries()))"


def probe(folder):
    return subprocess.run([sys.executable, "-c", PROBE], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(folder)})


@pytest.mark.parametrize("absent", [("carelake/llm", "tests/llm"), ("carelake/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_optional_parts(tmp_path, absent):
    left_out = {os.path.join(TOP, a) for a in absent} | {os.path.join(TOP, ".git")}
    copy = tmp_path / "copy"
    shutil.copytree(TOP, copy, ignore=lambda folder, names: [n for n in names if os.path.join(folder, n) in left_out or n == "__pycache__"])
    out = probe(copy)
    assert out.returncode == 0, out.stderr
    n, oracles, optional = map(int, out.stdout.split())
    assert n >= 72 and oracles >= 72 and optional == 0


def test_a_fault_inside_a_part_is_seen(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(TOP, copy, ignore=lambda folder, names: [n for n in names if n in ("__pycache__", ".git", "llm")])
    part = copy / "carelake" / "llm"
    part.mkdir()
    (part / "__init__.py").write_text("")
    (part / "queries.py").write_text("import no_such_module\n")
    out = probe(copy)
    assert out.returncode != 0 and "no_such_module" in out.stderr

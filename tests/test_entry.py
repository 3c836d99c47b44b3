"""The driver's entry module, also where the corpus operators cannot be imported."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.strip()


def test_other_queries_survive_without_the_corpus_operators():
    names = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    without = run("import sys; sys.modules['xxhash'] = None\n" + names).split()
    assert int(without[0]) > 150 and int(without[1]) > 140 and without[2] == "False"


def test_every_sql_has_its_query():
    assert run("import __spark_entry__ as e; print(sorted(set(e.oracle_sql()) - set(e.queries())))") == "[]"

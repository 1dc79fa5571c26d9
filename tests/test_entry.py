"""The driver's entry with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_imports_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(REPO / "canopy", tmp_path / "canopy", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and 'pipeline' not in q and o.keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys()

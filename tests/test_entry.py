import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 3
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_registry_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q); print([n for n in q if n.startswith('op') or n == 'pipeline'])"
    for extra in (False, True):
        if extra:
            (tmp_path / "copy" / "corpus_pipeline.py").unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True)
        assert done.returncode == 0 and done.stdout.strip() == "[]", done.stderr

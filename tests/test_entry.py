"""The rest of the library stands without the operators for training text."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TEXT_OPERATORS = (os.path.join("clicklens", "llm"), os.path.join("tests", "llm"))
LOOK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def copy_without(target, *left_out):
    def ignored(folder, names):
        inside = os.path.relpath(folder, ROOT)
        return [n for n in names if n in (".git", "__pycache__") or os.path.normpath(os.path.join(inside, n)) in left_out]

    shutil.copytree(ROOT, target, ignore=ignored)
    out = subprocess.run([sys.executable, "-c", LOOK], cwd=target, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_imports_without_the_text_operators(tmp_path):
    rest = copy_without(tmp_path / "a", *TEXT_OPERATORS)
    assert rest[2] == "False" and int(rest[0]) >= 80
    assert copy_without(tmp_path / "b", *TEXT_OPERATORS, "corpus_pipeline.py") == rest

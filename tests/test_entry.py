"""The entry with and without the optional corpus folders, each in a process of its own."""
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), 'budget_overview' in e.queries())"


def copied(folder, without=()):
    """A copy of the package and the entry, without some paths."""
    def left_out(path, names):
        return [n for n in names if n == "__pycache__" or os.path.relpath(os.path.join(path, n), ROOT) in without]
    shutil.copytree(os.path.join(ROOT, "fintally"), os.path.join(folder, "fintally"), ignore=left_out)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), folder)
    return folder


def asked(folder):
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})


def ledger_keys():
    from fintally.plans.registry import QUERIES, load_all
    load_all()
    return len(QUERIES)


@pytest.mark.parametrize("without", [("fintally/llm",), ("fintally/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_folders(tmpdir_path, without):
    out = asked(copied(tmpdir_path, without))
    assert out.returncode == 0, out.stderr
    n, _, pipeline, ledger = out.stdout.split()
    assert int(n) == ledger_keys() and pipeline == "False" and ledger == "True"


@pytest.mark.skipif(not os.path.isdir(os.path.join(ROOT, "fintally", "llm")), reason="no corpus folders here")
def test_import_errors_inside_the_corpus_operators_are_raised(tmpdir_path):
    folder = copied(tmpdir_path)
    with open(os.path.join(folder, "fintally", "llm", "common.py"), "a") as f:
        f.write("\nimport no_such_module_anywhere\n")
    out = asked(folder)
    assert out.returncode != 0 and "no_such_module_anywhere" in out.stderr

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print('NAMES', *q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root})
    assert out.returncode == 0, out.stderr
    return out.stdout.rpartition("NAMES")[2].split()


def test_entry_works_without_the_llm_folder(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    left = names(str(root))
    assert "dwell_events" in left and not any(n.startswith("op") or n == "pipeline" for n in left)
    (root / "tidemark" / "llm").mkdir()  # an emptied folder
    assert names(str(root)) == left


def test_nothing_outside_imports_the_llm_folder():
    for d, _, files in os.walk(os.path.join(ROOT, "tidemark")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in d:
                assert "tidemark.llm" not in open(os.path.join(d, f)).read(), f

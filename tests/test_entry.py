"""The entry module works with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"


def run(folder):
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": folder})


def test_import_without_the_subpackage(tmp_path):
    home = str(tmp_path / "repo")
    shutil.copytree(HOME, home, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    shutil.rmtree(f"{home}/vectide/llm", ignore_errors=True)
    if os.path.exists(f"{home}/corpus_pipeline.py"):
        os.remove(f"{home}/corpus_pipeline.py")
    out = run(home)
    assert out.returncode == 0 and out.stdout.split()[-1] == "False", out.stderr


def test_nothing_else_imports_the_subpackage():
    for top, _, names in os.walk(f"{HOME}/vectide"):
        if os.sep + "llm" not in top[len(HOME) :]:
            for n in names:
                if n.endswith(".py"):
                    with open(f"{top}/{n}") as f:
                        assert "vectide.llm" not in f.read(), n

"""The entry module works where the text operators, or the pipeline over them, were taken away."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as e
from shelfcast.session import build_session
assert not [k for k in e.queries() if k.startswith("op") and k[2].isdigit()] and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
spark = build_session("local[2]", 2)
print("rows", e.queries()["dim_stores"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_text_operators(tmp_path, with_pipeline):
    shutil.copytree(os.path.join(ROOT, "shelfcast"), tmp_path / "shelfcast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * with_pipeline:
        shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "rows " in out.stdout, out.stderr[-2000:]


def test_entry_does_not_hide_errors_inside_text_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "shelfcast"), tmp_path / "shelfcast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "shelfcast" / "llm").mkdir()
    (tmp_path / "shelfcast" / "llm" / "__init__.py").touch()
    (tmp_path / "shelfcast" / "llm" / "queries.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode != 0 and "no_such_module" in out.stderr

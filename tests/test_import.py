"""Registering queries needs no session, and nothing outside the llm folders needs them."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_entry_imports_without_llm(tmp_path):
    (tmp_path / "passagelens").mkdir()
    for p in (ROOT / "passagelens").iterdir():
        if p.name != "llm":
            (tmp_path / "passagelens" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    (tmp_path / "run.py").write_text("import __spark_entry__ as e\nq = e.queries()\nassert len(q) > 50 and 'pipeline' not in q and not any(n.startswith('op1') for n in q), list(q)\n")
    said = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr

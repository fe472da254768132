"""The rest of the repository without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def _copy(to: Path, *removed: str) -> Path:
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in removed:
        path = to / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    return to


def _names(folder: Path) -> subprocess.CompletedProcess:
    code = "import __spark_entry__ as e; q = e.queries(); print('NAMES', *q); assert set(e.oracle_sql()) <= set(q)"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True)


@pytest.mark.parametrize("removed", [("millrace/llm", "tests/llm", "corpus_pipeline.py"), ("millrace/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_entry_imports_without_what_may_be_removed(tmp_path, removed):
    said = _names(_copy(tmp_path / "copy", *removed))
    assert said.returncode == 0, said.stderr
    names = said.stdout.split()
    assert "r15_hybrid_recall" in names and "pipeline" not in names
    if "millrace/llm" in removed:
        assert not [n for n in names if n.startswith("op")]


def test_a_missing_module_inside_is_raised(tmp_path):
    folder = _copy(tmp_path / "copy", "millrace/llm")
    (folder / "millrace/llm").mkdir()
    (folder / "millrace/llm/__init__.py").write_text("")
    (folder / "millrace/llm/queries.py").write_text("import millrace.llm.no_such_module\n")
    (folder / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert _names(folder).returncode != 0


def test_nothing_else_names_the_subpackage():
    rest = [p for p in (ROOT / "millrace").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert rest and not [p for p in rest if "millrace.llm" in p.read_text() or "from .llm" in p.read_text() or "from ..llm" in p.read_text()]

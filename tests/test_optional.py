"""The rest works without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("motifloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "triangle_count" in e.queries() and "pipeline" not in e.queries() and set(e.oracle_sql()) == set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_says_what_the_operators_lack():
    code = """
import sys
sys.modules["xxhash"] = None
try:
    import __spark_entry__ as entry
except ImportError as e:
    assert e.name == "xxhash"
else:
    assert entry.llm is None
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for f in (ROOT / "motifloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert "motifloom.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text()

import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", ["corpus_pipeline", "tessera.llm", "zstandard", "ahocorasick"])
def test_entry_imports_without_the_optional_parts(gone):
    code = f"gone = {gone!r}" + """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == gone or name.startswith(gone + "."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_the_rest_does_not_import_the_optional_parts():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tessera.llm" not in p.read_text(), p

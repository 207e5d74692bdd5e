"""The training-data subpackage stands apart: nothing else in the library names it."""

from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_nothing_else_imports_the_subpackage():
    files = [p for p in (ROOT / "loomtext").rglob("*.py") if (ROOT / "loomtext/llm") not in p.parents]
    assert files and not [p for p in files if "loomtext.llm" in p.read_text() or "import llm" in p.read_text()]

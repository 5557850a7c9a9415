"""What the sources may and may not name."""

from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_the_library_stands_alone():
    """Nothing outside the subpackage imports it, but for the guarded entry."""
    for path in (ROOT / "kinloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "kinloom").parts:
            text = path.read_text()
            assert "kinloom.llm" not in text and ".llm" not in text and "corpus_pipeline" not in text, path


def test_decisions_never_read_the_truth():
    """Only evaluation knows which pairs are true; operators that decide don't."""
    for path in (ROOT / "kinloom" / "operators").glob("*.py"):
        if path.stem not in ("evaluate", "cascade"):
            assert "truth" not in path.read_text(), path


def test_no_local_checkpoints():
    for path in ROOT.rglob("*.py"):
        assert "localCheckpoint(" not in path.read_text() or path == Path(__file__), path

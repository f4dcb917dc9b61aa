"""The text subpackage stays apart from the rest."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_imports_llm():
    for path in (ROOT / "tidegrain").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+tidegrain\.llm", path.read_text(), re.M), path


def test_no_local_checkpoint_and_no_cross_join():
    for path in (ROOT / "tidegrain").rglob("*.py"):
        assert not re.search(r"localCheckpoint\(|crossJoin\(", path.read_text()), path

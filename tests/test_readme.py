"""README's inventory names only what is there."""

from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parents[1]


def test_inventory_names_registered_queries_and_files():
    text = (ROOT / "README.md").read_text(encoding="utf-8")
    rows = [x for x in text[text.index("## Inventory"):].split("\n## ")[0].splitlines() if x.startswith("|")]
    known = set(__spark_entry__.queries())
    letter = {x for row in rows for x in re.findall(r"`([a-k]\d+_[a-z0-9_]+)`", row)}
    assert letter and letter <= known, letter - known
    paths = {x for row in rows for x in re.findall(r"`((?:operators|plans|sources|functions|llm|streaming)/\w+\.py)", row)}
    assert paths and all((ROOT / "quarry" / x).exists() for x in paths)

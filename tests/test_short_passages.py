"""Short passages are looked for together, in one pass over the texts."""

from __future__ import annotations

import pyarrow as pa
import pytest

from quarry.operators import evaluate as EV


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_short_passages_are_found_in_one_pass(monkeypatch, size):
    monkeypatch.setattr(EV, "SHORT_BYTES", size)
    rows = [(" ".join(["The cat", "über x", "Zug The cat a_1", "cat a", "the"][i % j] for j in range(1, 5))).encode() for i in range(120)] + [b"", None, b"the cat"]
    passages = [b"the cat", b"cat", b"a", "über x".encode(), b"Zug The cat a_1", b"the cat", b"the ca", b"absent one"]
    doc, which = EV._finder(passages)(pa.array(rows, pa.binary()))
    assert sorted(zip(doc.tolist(), which.tolist())) == [(i, j) for i, t in enumerate(rows) for j, p in enumerate(passages) if t and p in t]

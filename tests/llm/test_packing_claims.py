"""What README says of the packing's default capacities."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from quarry.llm import packing as P


def test_only_tokens_bind_by_default_as_the_readme_says():
    rng = random.Random(4)
    histogram = {n: rng.randint(1, 9) for n in [1, 2, 3, 2047, 2048, *rng.sample(range(4, 2047), 60)]}
    histogram[1] = 5000
    usual, free = P.plan(histogram), P.plan(histogram, P.Capacity(documents=1 << 30, attention=1 << 40))
    assert all(np.array_equal(usual[k], free[k]) for k in usual)
    row = next(x for x in (Path(__file__).parents[2] / "README.md").read_text(encoding="utf-8").splitlines() if x.startswith("| 6 |"))
    assert "only the token capacity can bind" in row

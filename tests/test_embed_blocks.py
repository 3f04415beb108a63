"""Texts are embedded a bounded block at a time, whatever a batch holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarry.operators.semantic import EMBED_BYTES, embed_texts


class Careful:
    name, dimension = "careful", 2

    def embed(self, some):
        if len(some) > 1 and sum(len(t or "") for t in some) > EMBED_BYTES:
            raise ValueError("more text at once than a worker should hold")
        return np.array([[len(t or ""), 1.0] for t in some], dtype=np.float32)


def test_texts_are_embedded_in_blocks(spark):
    df = spark.range(1500).select(F.col("id").alias("i"), F.when(F.col("id") > 0, F.repeat(F.lit("ab "), F.when(F.col("id") == 7, 700_000).otherwise(500))).alias("t"))
    got = embed_texts(df.coalesce(1).cache(), Careful(), "i", "t").select("id", F.element_at("embedding", 1).alias("n")).collect()
    assert {r["id"]: r["n"] for r in got} == {i: 0 if i == 0 else 2_100_000 if i == 7 else 1500 for i in range(1500)}

"""Embedding store by content: what is embedded, and what a refresh returns."""

import os

import numpy as np
import pytest

from quarry.operators import embed_store as E
from quarry.operators.semantic import HashingEmbedder
from quarry.session import scratch_path


class Counting(HashingEmbedder):
    """Notes every text that it is given in a file of its own."""

    def __init__(self, folder, dimension=8):
        super().__init__(dimension)
        self.folder = str(folder)

    def embed(self, texts):
        import uuid
        if len(texts):
            with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as out:
                out.write("\0".join(texts))
        return super().embed(texts)

    def taken(self):
        names = sorted(os.listdir(self.folder))
        out = sorted(t for n in names for t in open(os.path.join(self.folder, n)).read().split("\0"))
        for n in names:
            os.rename(os.path.join(self.folder, n), os.path.join(os.path.dirname(self.folder), n))
        return out


def frame(spark, docs, dated=True):
    rows = [(p, t, m, len(t)) for p, (t, m) in docs.items()]
    df = spark.createDataFrame(rows, "path string, text string, mtime_ns long, size long")
    return df if dated else df.select("path", "text")


def check(got, docs):
    want = {p: HashingEmbedder(8).embed([t])[0] for p, (t, _) in docs.items()}
    rows = {r["id"]: np.array(r["embedding"], dtype=np.float32) for r in got.collect()}
    assert rows.keys() == want.keys() and all((rows[p] == want[p]).all() for p in want)


@pytest.mark.parametrize("dated", [True, False])
def test_only_new_contents_are_embedded(spark, tmp_path, dated):
    (tmp_path / "seen").mkdir()
    one, base = Counting(tmp_path / "seen"), scratch_path(spark, "store")
    docs = {"a": ("one two", 1), "b": ("one two", 1), "c": ("three", 1), "d": ("", 1)}
    check(E.refresh(spark, base, frame(spark, docs, dated), one), docs)
    assert one.taken() == ["", "one two", "three"]
    docs = {"moved": ("three", 2), "a": ("one two", 1), "b": ("four", 2), "e": ("four", 2)}
    check(E.refresh(spark, base, frame(spark, docs, dated), one), docs)
    assert one.taken() == ["four"]
    docs["back"] = ("", 3)
    check(E.refresh(spark, base, frame(spark, docs, dated), one), docs)
    assert one.taken() == []
    check(E.stored_vectors(spark, base), docs)


def test_another_embedder_starts_anew(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    base, docs = scratch_path(spark, "store"), {"a": ("one", 1)}
    E.refresh(spark, base, frame(spark, docs), HashingEmbedder(4))
    one = Counting(tmp_path / "seen")
    check(E.refresh(spark, base, frame(spark, docs), one), docs)
    assert one.taken() == ["one"]
    assert E.refresh(spark, base, frame(spark, {"a": ("x", 9)}).limit(0), one).count() == 0
    with pytest.raises(FileNotFoundError):
        E.stored_vectors(spark, scratch_path(spark, "nothing"))

"""Trees listed by jobs: the same rows as the walk on one machine."""

import os

import pytest

from quarry.sources import files, listing


def make(tmp_path):
    root = tmp_path / "root"
    for d in ("a/b/c", "a/empty", ".hidden", "wide"):
        (root / d).mkdir(parents=True)
    (root / "top.txt").write_bytes(b"top\xff line")
    (root / "a" / "b" / "c" / "deep.py").write_text("x = 1\n")
    (root / ".hidden" / "h").write_bytes(b"")
    for i in range(200):
        (root / "wide" / f"f{i:03d} é.txt").write_text("w" * i)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "secret").write_text("s")
    os.symlink(tmp_path / "out", root / "link")
    os.symlink(root / "top.txt", root / "a" / "copy.txt")
    return root


def rows(df):
    return sorted((r["path"], r["type"], r["size"], r["mtime_ns"], bytes(r["content"]) if r["content"] is not None else None) for r in df.collect())


@pytest.mark.parametrize("as_uri", [False, True])
def test_equal_to_the_walk(spark, tmp_path, monkeypatch, as_uri):
    monkeypatch.setattr(listing, "FOLDERS_PER_TASK", 1)
    monkeypatch.setattr(listing, "BATCH", 7)
    root = make(tmp_path)
    name = f"file:{root}" if as_uri else str(root)
    assert rows(listing.read_folders(spark, name)) == rows(files.read_tree(spark, str(root)))
    assert rows(listing.read_folders(spark, name, content=False)) == rows(files.read_tree(spark, str(root), content=False))
    assert rows(listing.read_folders(spark, name, max_bytes=50)) == [r for r in rows(files.read_tree(spark, str(root))) if r[1] != "file" or r[2] <= 50]


def test_other_file_systems_are_listed_by_their_own_means(spark, tmp_path, monkeypatch):
    """A root that isn't a local path goes through its URI's file system."""
    root = make(tmp_path)
    plain = [r for r in rows(files.read_tree(spark, str(root)))]
    monkeypatch.setattr(listing, "_local", lambda r: None)
    assert listing.is_folder(f"file://{root}")
    got = sorted(listing._entries(f"file://{root}", "wide"))
    assert [g[:3] for g in got] == [r[:3] for r in plain if r[0].startswith("wide/")]
    assert [g[0] for g in listing._entries(f"file://{root}", "a/b")] == ["a/b/c"]


def test_missing_root_and_empty_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="root-missing"):
        listing.list_folders(spark, str(tmp_path / "nope"))
    (tmp_path / "bare").mkdir()
    assert listing.read_folders(spark, str(tmp_path / "bare")).count() == 0

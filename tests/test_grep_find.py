import os

import pytest

from conftest import corpus_df
from quarry.operators import grep as G
from quarry.operators import paths as P
from quarry.sources import files as FS


def test_grep_hit_and_status(spark):
    c = corpus_df(spark, {"sample.txt": "TODO: write more tests"})
    hits = G.grep(c, "TODO").collect()
    assert [(h.path, h.line, h.text) for h in hits] == [("sample.txt", 1, "TODO: write more tests")]
    s = G.grep_summary(c, patterns={1: "TODO", 2: "nothing here", 3: "(bad"}).orderBy("pid").collect()
    assert [(r.pid, r.matches, r.exit_code) for r in s] == [(1, 1, 0), (2, 0, 1), (3, 0, 2)]


def test_grep_lines_numbered_from_one_and_one_row_per_line(spark):
    c = corpus_df(spark, {"a.txt": "x foo foo\nbar\nfoo\n", "b.txt": ""})
    hits = sorted((h.path, h.line) for h in G.grep(c, "foo").collect())
    assert hits == [("a.txt", 1), ("a.txt", 3)]


def test_pattern_lines_are_alternatives(spark):
    c = corpus_df(spark, {"a.txt": "alpha\nbeta\ngamma"})
    hits = sorted(h.line for h in G.grep(c, "alpha\ngamma").collect())
    assert hits == [1, 3]


def test_line_modes(spark):
    c = corpus_df(spark, {"a.txt": "one\r\ntwo three\n"})
    nl = [(h.line, h.text) for h in G.grep(c, "t", line_mode="newline").orderBy("line").collect()]
    assert nl == [(2, "two three")]
    uni = [(h.line, h.text) for h in G.grep(c, "t", line_mode="universal").orderBy("line").collect()]
    assert uni == [(2, "two"), (3, "three")]
    cr = [h.text for h in G.grep(c, "one", line_mode="newline").collect()]
    assert cr == ["one\r"]


def test_every_line_is_tried_by_itself(spark):
    c = corpus_df(spark, {"a.txt": "foo\rbar\r", "b.txt": "xx\nq", "c.txt": "xa\nab\nb"})
    assert [h.text for h in G.grep(c, "foo$", line_mode="universal").collect()] == ["foo"]
    assert [h.text for h in G.grep(c, "^[^q]++$").orderBy("text").collect()] == ["ab", "b", "foo\rbar\r", "xa", "xx"]
    assert sorted(h.line for h in G.grep(c, r"b\Z").collect() if h.path == "c.txt") == [2, 3]


def test_many_patterns_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_PATTERNS", 2)
    c = corpus_df(spark, {"a.txt": "p0\np1 p2\np3\np4"})
    table = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "pid long, pattern string")
    assert sorted((h.pid, h.line) for h in G.grep(c, patterns=table).collect()) == [(0, 1), (1, 2), (2, 2), (3, 3), (4, 4)]
    assert G.grep(c, patterns=table.limit(0)).count() == 0


def test_grep_unicode_word_class(spark):
    c = corpus_df(spark, {"a.txt": "café\nplain"})
    assert sorted(h.line for h in G.grep(c, r"caf\w$").collect()) == [1]


def test_invalid_pattern(spark):
    c = corpus_df(spark, {"a.txt": "x"})
    with pytest.raises(ValueError, match="invalid-pattern"):
        G.grep(c, "(")


def _tree(tmp_path):
    root = tmp_path / "root"
    (root / "nested").mkdir(parents=True)
    (root / "nested" / "keep_match.txt").write_text("TODO here\n")
    (root / "nested" / "ignore.log").write_text("nothing\n")
    (root / ".hid").mkdir()
    (root / ".hid" / "secret.txt").write_text("TODO hidden\n")
    (root / "pkg").mkdir()
    (root / "pkg" / "__init__.py").write_text("def foo():\n    pass\n")
    (root / "big.txt").write_bytes(b"x" * 2000)
    (root / "bad.txt").write_bytes(b"ok\xff\xfe\n")
    outside = tmp_path / "outside.txt"
    outside.write_text("TODO outside\n")
    os.symlink(outside, root / "link.txt")
    os.symlink(tmp_path, root / "linkdir")
    return root


def test_tree_source_lists_everything_but_links(spark, tmp_path):
    root = _tree(tmp_path)
    df = FS.read_tree(spark, str(root))
    rows = {(r.path, r.type) for r in df.collect()}
    assert ("pkg/__init__.py", "file") in rows and (".hid/secret.txt", "file") in rows
    assert ("nested", "directory") in rows
    assert not any(p.startswith("link") for p, _ in rows)


def test_tree_source_size_pushdown_and_decode(spark, tmp_path):
    root = _tree(tmp_path)
    df = FS.with_text(FS.read_tree(spark, str(root)).filter("size <= 1000"))
    paths = {r.path for r in df.collect()}
    assert "big.txt" not in paths and "nested" not in paths
    bad = [r.text for r in df.filter("path = 'bad.txt'").collect()]
    assert bad == ["ok\n"]


def test_tree_source_pushed_filters_intersect(spark, tmp_path):
    root = _tree(tmp_path)
    for cond in ("type = 'directory' AND size <= 100", "size <= 100 AND type = 'directory'"):
        assert FS.read_tree(spark, str(root)).filter(cond).count() == 0
    got = FS.read_tree(spark, str(root)).filter("type = 'file' AND size <= 1000 AND size < 900")
    assert {r.path for r in got.collect()} >= {"bad.txt"} and "big.txt" not in {r.path for r in got.collect()}


def test_missing_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="root-missing"):
        FS.read_tree(spark, str(tmp_path / "nope"))
    st = FS.root_status(spark, [str(tmp_path), str(tmp_path / "nope")]).orderBy("ok").collect()
    assert [(r.ok, r.error) for r in st] == [(False, "root-missing"), (True, None)]


def test_find_regex_type_and_errors(spark, tmp_path):
    root = _tree(tmp_path)
    ents = FS.read_tree(spark, str(root), content=False)
    assert [r.path for r in P.find_paths(ents, r"match\.txt$").collect()] == ["nested/keep_match.txt"]
    files = [r.path for r in P.find_paths(ents, "nested", "file").collect()]
    assert files == ["nested/ignore.log", "nested/keep_match.txt"]
    dirs = [r.path for r in P.find_paths(ents, None, "directory").collect()]
    assert dirs == [".hid", "nested", "pkg"]
    with pytest.raises(ValueError, match="invalid-type"):
        P.find_paths(ents, None, "symlink")
    with pytest.raises(ValueError, match="invalid-pattern"):
        P.find_paths(ents, "*.py")


def test_grep_over_tree_skips_link_outside(spark, tmp_path):
    root = _tree(tmp_path)
    c = FS.with_text(FS.read_tree(spark, str(root)).filter("type = 'file'"))
    assert sorted(h.path for h in G.grep(c, "TODO").collect()) == ["nested/keep_match.txt"]
    every = G.grep(c, "TODO", include_hidden=True, skip_binary=False)
    assert sorted(h.path for h in every.collect()) == [".hid/secret.txt", "nested/keep_match.txt"]


def test_grep_skips_binary_by_default(spark):
    c = corpus_df(spark, {"bin.dat": "TODO\x00x", "a.txt": "TODO"})
    assert [h.path for h in G.grep(c, "TODO").collect()] == ["a.txt"]
    assert sorted(h.path for h in G.grep(c, "TODO", skip_binary=False).collect()) == ["a.txt", "bin.dat"]


def test_table_entries_directories(spark):
    c = corpus_df(spark, {"a/b/c.txt": "x", "a/d.txt": "y", "e.txt": "z"})
    ents = sorted((r.path, r.type) for r in P.path_entries(c).collect())
    assert ents == [("a", "directory"), ("a/b", "directory"), ("a/b/c.txt", "file"),
                    ("a/d.txt", "file"), ("e.txt", "file")]


def test_language_files(spark):
    c = corpus_df(spark, {"a.py": "x", "b.txt": "y"})
    got = sorted((r.language, r.path) for r in P.select_language_files(c, ["python", "cobol"]).collect())
    assert got == [("cobol", "a.py"), ("cobol", "b.txt"), ("python", "a.py")]


def test_root_id_is_sha1_of_resolved_root(tmp_path):
    import hashlib
    assert FS.root_id(str(tmp_path)) == hashlib.sha1(os.path.realpath(tmp_path).encode()).hexdigest()

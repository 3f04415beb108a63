import pytest

from conftest import corpus_df
from quarry.operators import symbols as S

SOURCE = """def foo():
    return 1


def bar():
    foo()
    x = 2
    y = 3
    return foo() + x + y
"""


def test_defs_and_refs(spark):
    f, e = S.symbol_index(corpus_df(spark, {"mod.py": SOURCE, "notes.txt": "foo()"}))
    got = [(r.kind, r.path, r.line, r.text) for r in f.collect()]
    assert got == [("def", "mod.py", 1, "foo"), ("def", "mod.py", 5, "bar"),
                   ("ref", "mod.py", 6, "foo"), ("ref", "mod.py", 9, "foo")]
    assert e.count() == 0


def test_symbol_filter_scope_and_errors(spark):
    docs = {"a/mod.py": SOURCE, "b/mod.py": SOURCE, "b/broken.py": "def (:\n"}
    f, e = S.symbol_index(corpus_df(spark, docs), symbol="bar", scope_globs=["a/*"])
    assert [(r.kind, r.path) for r in f.collect()] == [("def", "a/mod.py")]
    _, e = S.symbol_index(corpus_df(spark, docs))
    assert [r.path for r in e.collect()] == ["b/broken.py"]


def test_attribute_calls_and_decorators(spark):
    src = "import os\n\n@decorate\ndef f():\n    return os.path.join(\n        'a',\n    ).upper()\n"
    f, _ = S.symbol_index(corpus_df(spark, {"m.py": src}))
    got = [(r.kind, r.line, r.text) for r in f.collect()]
    assert ("def", 4, "f") in got and ("ref", 3, "decorate") not in got
    assert ("ref", 5, "join") in got and ("ref", 7, "upper") in got


def test_missing_language(spark):
    with pytest.raises(ValueError, match="language-unavailable"):
        S.symbol_index(corpus_df(spark, {"a.go": "x"}), ["go"])
    assert S.missing_languages(["python", "typescript", "go"]) == ["go", "typescript"]


def test_lookup_summary_unresolved(spark):
    f, _ = S.symbol_index(corpus_df(spark, {"mod.py": SOURCE + "\nprint(1)\n"}))
    assert [(r.kind, r.line) for r in S.symbol_lookup(f, "foo").collect()] == [("def", 1), ("ref", 6), ("ref", 9)]
    summ = {r.text: (r.defs, r.refs) for r in S.symbol_summary(f).collect()}
    assert summ == {"foo": (1, 2), "bar": (1, 0), "print": (0, 1)}
    assert [r.text for r in S.unresolved_references(f).collect()] == ["print"]


def test_rule_override_merge(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([({"def": "d0", "ref": "r0"}, {"ref": "r1", "note": "n1"})],
                               "d map<string,string>, o map<string,string>")
    got = df.select(S.merge_rule_overrides(F.col("d"), F.col("o")).alias("m")).first().m
    assert got == {"def": "d0", "ref": "r1", "note": "n1"}

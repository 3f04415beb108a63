"""Required literals, pattern tables and trigram searches against grep."""

import random
import re

import pytest
from conftest import corpus_df

from quarry.functions.literals import glob_leading, leading, required
from quarry.operators import grep as G
from quarry.operators import regex_index as R
from quarry.session import scratch_path


@pytest.mark.parametrize("pattern,clauses", [
    ("hello", [["hello"]]), ("foo.*barbaz", [["barbaz"], ["foo"]]), ("(abc|defg)x", [["abc", "defg"], ["x"]]), ("(abc|d*)x", [["x"]]), ("a?b+c{2}", [["b"], ["c"]]),
    ("(?i)hello", []), ("[ab]c", [["c"]]), ("x(yz)w", [["xyzw"]]), (r"\bfoo\b", [["foo"]]), ("(?:ab)+cd", [["ab"], ["cd"]]), ("(?=foo)bar", [["bar"]]),
    ("[[:alpha:]]x", []), (r"\p{L}abc", []), ("(?i:ab)cd", [["cd"]]), ("a|b", []), ("ab|cd", [["ab", "cd"]]), ("", []), ("(", []), ("é漢", [["é漢"]])])
def test_required_literals(pattern, clauses):
    assert sorted(required(pattern)) == sorted(clauses)


@pytest.mark.parametrize("seed", range(20))
def test_clauses_hold_in_every_match(seed):
    rnd = random.Random(seed)
    parts = ["a", "b", "ab", "(a|bc)", "(ab)?", "c+", "[abc]", ".", "(?:a|b|c*)", "b{2,3}", "(c(a|b)c)", "^", r"\b"]
    pattern = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))
    clauses = required(pattern)
    for _ in range(300):
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 8)))
        if re.search(pattern, text):
            assert all(any(x in text for x in c) for c in clauses), (pattern, text, clauses)


def rows(df):
    return sorted((r["pid"], r["path"], r["line"], r["text"]) for r in df.collect())


DOCS = {"a.txt": "alpha beta\nbeta gamma 12\n\nline four é漢x", "b.txt": "gamma\nalpha\nTODO fix", ".h.txt": "alpha", "c.bin": "alpha\x00", "d.txt": "", "e.txt": "fofoo alphabeta"}
PATTERNS = {1: "alpha", 2: "(beta|gamma) [0-9]+", 3: "^$", 4: "(?i)todo", 5: "foo", 6: "nothing here", 7: "alpha\ngamma", 8: "é漢", 9: "a.p", 10: "[ae]l"}


def test_table_equals_grep(spark, monkeypatch):
    corpus = corpus_df(spark, DOCS)
    table = spark.createDataFrame([*PATTERNS.items(), (11, "("), (12, None), (None, "x")], "pid int, pattern string")
    want = rows(G.grep(corpus, patterns=PATTERNS))
    assert rows(R.grep_table(corpus, table)) == want
    monkeypatch.setattr(R, "LITERALS_SENT", 3)
    assert rows(R.grep_table(corpus, table)) == want
    everything = dict(include_hidden=True, skip_binary=False, line_mode="universal")
    assert rows(R.grep_table(corpus, table, **everything)) == rows(G.grep(corpus, patterns=PATTERNS, **everything))
    assert {r["pid"] for r in R.compiled(table).where("java is null").collect()} == {11}
    assert R.grep_table(corpus, table.limit(0)).count() == 0


def test_twenty_thousand_patterns(spark):
    docs = {f"d{i}.txt": "\n".join(f"word{(i * 31 + j) % 30000} tail{j}" for j in range(40)) for i in range(50)}
    table = spark.range(20000).selectExpr("id AS pid", "concat('\\\\bword', id, ' t[a-z]+') AS pattern")
    got = R.grep_table(corpus_df(spark, docs), table)
    want = sorted((int(m[1]), p, n + 1, line) for p, t in docs.items() for n, line in enumerate(t.split("\n"))
                  if (m := re.match(r"word(\d+) ", line)) and int(m[1]) < 20000)
    assert rows(got) == want


def test_trigram_search_equals_grep(spark):
    corpus = corpus_df(spark, DOCS)
    index = R.build(corpus, scratch_path(spark, "trigrams"))
    for pattern in [*PATTERNS.values(), "zzz+", "alpha.*beta|TODO", "x"]:
        assert rows(R.search(index, pattern)) == rows(G.grep(corpus, pattern)), pattern
    with pytest.raises(ValueError, match="invalid-pattern"):
        R.search(index, "(")
    assert R.search(R.build(corpus.limit(0), scratch_path(spark, "trigrams")), "alpha").count() == 0


def test_a_selective_pattern_reads_few_documents(spark, monkeypatch):
    rnd = random.Random(4)
    docs = {f"d{i:04d}.txt": " ".join(rnd.choice(["apple", "pear", "plum", "fig"]) for _ in range(30)) + (" needle42" if i % 200 == 3 else "") for i in range(1000)}
    index = R.build(corpus_df(spark, docs), scratch_path(spark, "trigrams"))
    assert R.matching_documents(index, r"needle\d+").count() == 5
    assert R.matching_documents(index, r"(needle|nothing)\d+").count() == 5
    assert R.matching_documents(index, r"\d\d").count() == 1000
    monkeypatch.setattr(R, "PUSHED_DOCS", 2)
    assert R.search(index, r"needle\d+").count() == 5


@pytest.mark.parametrize("pattern,start", [
    ("^en/src1.*", "en/src1"), ("^(en/)x", "en/x"), ("^a|b", ""), ("^ab?", "a"), ("en/", ""), ("(?i)^en/", ""), ("(?m)^en", ""), ("^", ""), (r"\Aen/", "en/"),
    ("^[[:alpha:]]", ""), ("(^en|^de)", ""), ("^é/", "é/")])
def test_literal_start_of_anchored_patterns(pattern, start):
    assert leading(pattern) == start
    assert glob_leading("src/*.py") == "src/" and glob_leading("*.py") == "" and glob_leading("a[b]") == "a"


def test_prefix_ranges_skip_row_groups_of_a_stored_listing(spark):
    from pyspark.sql import functions as F

    from quarry.operators import paths as P
    entries = spark.range(200_000).select(F.format_string("%s/%06d.txt", F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]),
                                                                                      (F.col("id") % 4 + 1).cast("int")), "id").alias("path"), F.lit("file").alias("type"))
    stored = P.write_listing(entries, scratch_path(spark, "listing"), row_group_bytes=1 << 16)
    for how in (dict(pattern=r"^en/0000\d\d\.txt$"), dict(globs=["en/00001*.txt", "en/00002*"])):
        found = P.find_paths(stored, sort=False, **how)
        got = sorted(r["path"] for r in found.collect())
        assert got and got == sorted(r["path"] for r in P.find_paths(entries, sort=False, **how).collect())
        plan = found._jdf.queryExecution().executedPlan()
        assert "StringStartsWith(path,en/0000" in plan.toString()
        assert plan.collectLeaves().head().metrics().apply("numOutputRows").value() < 60_000

import fnmatch
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.functions.text import decode_utf8_ignore, glob_to_regex, java_regex, split_lines, tokenize
from quarry.functions.runs import sanitise_run_id

TEXT = st.text(alphabet=st.sampled_from(list("abcXYZ019_ .,-\n\r\t/") + ["K", "İ", "é", "ß", " "]),
               max_size=40)


def _one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_tokenize_matches_python(spark, texts):
    got = _one(spark, tokenize, texts)
    want = [[m.group(0).lower() for m in re.finditer(r"[A-Za-z0-9_]+", t)] for t in texts]
    assert got == want


def test_kelvin_sign_is_not_a_token(spark):
    assert _one(spark, tokenize, ["Kelvin K"]) == [["elvin", "k"]]


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_split_lines_model(spark, texts):
    got = _one(spark, split_lines, texts)

    def model(t):
        if t == "":
            return []
        if t.endswith("\n"):
            t = t[:-1]
        return t.split("\n")
    assert got == [model(t) for t in texts]


PATHS = st.text(alphabet=st.sampled_from(list("ab./_x")), min_size=0, max_size=10)
GLOBS = st.lists(st.sampled_from(list("ab./*?") + ["[ab]", "[!a]"]), max_size=6).map("".join)


@settings(max_examples=25, deadline=None)
@given(st.lists(PATHS, min_size=1, max_size=6), GLOBS)
def test_glob_matches_fnmatchcase(spark, paths, glob):
    got = _one(spark, lambda c: c.rlike(glob_to_regex(glob)), paths)
    assert got == [fnmatch.fnmatchcase(p, glob) for p in paths]


def test_glob_star_crosses_slash(spark):
    assert _one(spark, lambda c: c.rlike(glob_to_regex("a/*.py")), ["a/b/c.py", "b/c.py"]) == [True, False]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab .#_-/é")), max_size=10), min_size=1, max_size=6))
def test_sanitise_matches_python(spark, ids):
    got = _one(spark, sanitise_run_id, ids)
    assert got == [re.sub(r"[^A-Za-z0-9_.-]+", "_", i).strip("._") for i in ids]


def test_invalid_regex_is_reported():
    import pytest
    for bad in ["(unclosed", "*.py", r"\Qa\E", "[z-a]", "a\\", "[abc", r"(?P=x)", "(?U)a"]:
        with pytest.raises(ValueError, match="invalid-pattern"):
            java_regex(bad)


def test_java_regex_translation():
    assert java_regex(r"(?P<w>a)(?P=w)\Z").endswith(r"(?<w>a)\k<w>\z")


def test_line_search_syntax(spark):
    lines = ["A\u00c9x", "aa", "a&b", "x\\Z", "[", "a[b", "tab\tz", "\u00e9"]
    for pattern, want in [(r"\p{Lu}{2}", 1), (r"(?<n>a)\k<n>", 1), ("[a&&b]", 4), (r"\\Z", 1), ("a[[]b", 1), ("(?a)\\w\u00e9", 0),
                          ("[[:upper:]]", 2), (r"(?P<a_b>a)(?P=a_b)", 1), (r"[]\[]", 2), (r"\x{e9}", 1)]:
        got = _one(spark, lambda c, p=pattern: c.rlike(java_regex(p)), lines)
        assert sum(got) == want, (pattern, got)


ATOMS = st.sampled_from(["a", "b", r"\d", r"\w", r"\s", ".", "[ab]", "[^a]", "[a&&b]", "[[]", r"\.", "^", "$", "(?:ab)", "(a)", r"\b", "[]x]", r"\\Z", r"\Z", r"\A"])
PATTERNS = st.lists(st.tuples(ATOMS, st.sampled_from(["", "", "*", "+", "?", "{2}"])), min_size=1, max_size=5).map(
    lambda xs: "".join(a + (q if a not in ("^", "$", r"\b", r"\Z", r"\A") else "") for a, q in xs))
SUBJECTS = st.lists(st.text(alphabet=st.sampled_from(list("ab1 .&[]xZ\\\u00e9")), max_size=8), min_size=4, max_size=8)


@settings(max_examples=40, deadline=None)
@given(PATTERNS, SUBJECTS)
def test_patterns_match_as_in_python(spark, pattern, subjects):
    import warnings
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = [re.search(pattern, x) is not None for x in subjects]
    assert _one(spark, lambda c: c.rlike(java_regex(pattern)), subjects) == want


def test_decode_drops_invalid_bytes(spark):
    raw = [b"ok \xff\xfe text", "café".encode(), b"\xe2\x82"]
    got = _one(spark, decode_utf8_ignore, raw, "binary")
    assert got == [r.decode("utf-8", errors="ignore") for r in raw]

"""Symbol index: definitions and references per file, and lookup by symbol.

Python files are parsed with the standard ``ast`` module on executors
(``mapInArrow``, one parse per file). Rules, as for a grammar query:

* ``def``: names of functions (also async) and classes; the line is the
  line of the name (the ``def``/``class`` line, decorators not counted);
* ``ref``: calls of a plain name (the name) or of an attribute (the last
  attribute, on the line where the attribute ends).

Findings outside the file's lines are dropped; ``(kind, path, line, text)``
are unique across languages; output is sorted by (path, line, kind, text).
A file that does not parse yields no findings and one ``parse_errors`` row.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import any_glob_match
from quarry.operators.paths import DEFAULT_LANGUAGE_GLOBS
from quarry.plans.sizing import spread_small_input

# The finding kinds a rule may produce, and the languages with
# an extractor here.
VALID_KINDS = ("def", "ref", "call", "note")
AVAILABLE_LANGUAGES = ("python",)
_OUT = "kind string, path string, line int, text string, message string"


def python_findings(source: str) -> list[tuple[str, int, str]]:
    """(kind, line, identifier) for one Python source text; raises SyntaxError."""
    tree = ast.parse(source)
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append(("def", node.lineno, node.name))
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out.append(("ref", f.lineno, f.id))
            elif isinstance(f, ast.Attribute):
                out.append(("ref", f.end_lineno or f.lineno, f.attr))
    return out


def _extract(batches):
    for batch in batches:
        paths = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        kinds, ps, lines, idents, msgs = [], [], [], [], []
        for path, text in zip(paths, texts):
            text = text or ""
            n_lines = len(text.splitlines())
            try:
                found = python_findings(text)
            except (SyntaxError, ValueError, MemoryError, RecursionError) as exc:
                kinds.append("error"); ps.append(path); lines.append(None); idents.append(None)
                msgs.append(f"{type(exc).__name__}: {exc}")
                continue
            for kind, line, ident in found:
                if 1 <= line <= n_lines:
                    kinds.append(kind); ps.append(path); lines.append(line); idents.append(ident); msgs.append(None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(ps, pa.string()), pa.array(lines, pa.int32()),
             pa.array(idents, pa.string()), pa.array(msgs, pa.string())],
            names=["kind", "path", "line", "text", "message"])


def merge_rule_overrides(defaults, overrides):
    """Rule text per kind (MAP<STRING,STRING>) with overrides winning by key
    (G5), independent of the session's map-key dedup policy."""
    keep = F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(overrides), k))
    return F.map_concat(keep, overrides)


def missing_languages(languages: list[str]) -> list[str]:
    """Requested minus available languages, sorted."""
    return sorted(set(languages) - set(AVAILABLE_LANGUAGES))


def symbol_index(corpus: DataFrame, languages: list[str] | None = None,
                 scope_globs: list[str] | None = None, symbol: str | None = None,
                 language_globs: dict[str, list[str]] | None = None,
                 path_col: str = "path", text_col: str = "text", sort: bool = True
                 ) -> tuple[DataFrame, DataFrame]:
    """(findings(kind, path, line, text), parse_errors(path, message))."""
    languages = languages or ["python"]
    available = [lang for lang in languages if lang in AVAILABLE_LANGUAGES]
    if not available:
        raise ValueError(f"language-unavailable: {languages}")
    globs = dict(DEFAULT_LANGUAGE_GLOBS)
    globs.update(language_globs or {})
    files = corpus.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    if "type" in corpus.columns:
        files = corpus.filter(F.col("type") == "file").select(F.col(path_col).alias("path"),
                                                              F.col(text_col).alias("text"))
    # A file matched by several globs of a language is parsed once.
    sel = files.filter(any_glob_match("path", [g for lang in available for g in globs.get(lang, ["*"])]))
    if scope_globs:
        sel = sel.filter(any_glob_match("path", scope_globs))
    raw = spread_small_input(sel).mapInArrow(_extract, _OUT)
    findings = raw.filter(F.col("kind").isin(*VALID_KINDS))
    if symbol:   # exact, case-sensitive; empty or None = all
        findings = findings.filter(F.col("text") == symbol)
    findings = findings.select("kind", "path", "line", "text").dropDuplicates(["kind", "path", "line", "text"])
    if sort:
        findings = findings.orderBy("path", "line", "kind", "text")
    errors = raw.filter(F.col("kind") == "error").select("path", "message")
    return findings, errors


def symbol_lookup(findings: DataFrame, symbol: str) -> DataFrame:
    """Definitions and references of one name (C7): the findings of that
    name, definitions first. No def x ref pairs are formed."""
    return findings.filter(F.col("text") == symbol).orderBy(F.desc(F.col("kind") == "def"), "path", "line")


def symbol_summary(findings: DataFrame) -> DataFrame:
    """Per name: number of definitions and references (one aggregate)."""
    return findings.groupBy("text").agg(
        F.sum(F.when(F.col("kind") == "def", 1).otherwise(0)).alias("defs"),
        F.sum(F.when(F.col("kind") == "ref", 1).otherwise(0)).alias("refs"))


def unresolved_references(findings: DataFrame) -> DataFrame:
    """References whose name has no definition anywhere (left anti join)."""
    defs = findings.filter(F.col("kind") == "def").select("text").distinct()
    return findings.filter(F.col("kind") == "ref").join(defs, "text", "left_anti")

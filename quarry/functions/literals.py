"""Literal strings that a regular expression requires.

``required(pattern)`` gives clauses: every text that the pattern matches holds
at least one string of each clause. What may be absent (optional parts,
repeats from zero, look-arounds), any character class and anything that
ignores case requires nothing. The pattern is read by the parser of Python's
``re``; one that it doesn't take requires nothing either, so whoever uses the
clauses as a filter then reads everything.
"""

from __future__ import annotations

import re
import warnings

try:
    from re import _parser
except ImportError:   # other Python implementations: no clauses
    _parser = None


def required(pattern: str) -> list[list[str]]:
    """Clauses of alternatives, the most selective (longest) first."""
    if _parser is None or "[:" in pattern:   # a POSIX class, which ``re`` reads otherwise
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    if tree.state.flags & re.IGNORECASE:
        return []
    clauses = [sorted(set(c)) for c in _clauses(tree)]
    return sorted((c for c in clauses if c and all(c)), key=lambda c: (-min(map(len, c)), len(c)))


def leading(pattern: str) -> str:
    """What every text begins with that an anchored pattern is found in; empty
    if the pattern isn't anchored at the start or requires nothing there."""
    if _parser is None or "[:" in pattern:
        return ""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ""
    items = list(tree)
    if not items or tree.state.flags & (re.IGNORECASE | re.MULTILINE) or str(items[0][1]) not in ("AT_BEGINNING", "AT_BEGINNING_STRING"):
        return ""
    out = ""
    for op, arg in items[1:]:
        if str(op) == "LITERAL":
            out += chr(arg)
        elif str(op) == "SUBPATTERN" and not arg[1] and not arg[2] and all(str(o) == "LITERAL" for o, _ in arg[3]):
            out += "".join(chr(a) for _, a in arg[3])
        else:
            break
    return out


def glob_leading(glob: str) -> str:
    """What every path begins with that a glob matches."""
    return re.split(r"[*?\[]", glob, maxsplit=1)[0]


def _clauses(tree) -> list[list[str]]:
    """Clauses of a sequence: runs of literals, and what its parts require."""
    out, run = [], ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        inner: list[list[str]] = []
        if name == "SUBPATTERN" and not arg[1] & re.IGNORECASE:
            body = list(arg[3])
            if all(str(o) == "LITERAL" for o, _ in body):
                run += "".join(chr(a) for _, a in body)
                continue
            inner = _clauses(arg[3])
        elif name == "ATOMIC_GROUP":
            inner = _clauses(arg)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            inner = _clauses(arg[2])
        elif name == "BRANCH":
            inner = _branches(arg[1])
        elif name == "AT":
            continue   # a position between characters: the run goes on
        if run:
            out.append([run])
            run = ""
        out += inner
    return out + ([[run]] if run else [])


def _branches(branches) -> list[list[str]]:
    """One clause of the best literal of each branch, if each has one."""
    found = []
    for branch in branches:
        best = max((c for c in _clauses(branch) if c and all(c)), key=lambda c: min(map(len, c)), default=None)
        if best is None:
            return []
        found += best
    return [found]

"""Column functions for text: tokens, lines, paths, regexes and globs.

All of these return Spark Column expressions (JVM side, inside whole-stage
codegen); none of them runs Python per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
TOKEN_PATTERN = "[A-Za-z0-9_]+"          # tokens are runs of ASCII letters, digits, underscore
MAX_FILE_BYTES = 512_000                 # the usual size cap of file trees; table corpora have none
REGEX_FLAGS = "(?dU)"                    # Java: only \n ends a line; \w, \d, \s are Unicode


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """All ``[A-Za-z0-9_]+`` runs (or those of another pattern), then lower-cased
    (extract first, lower second)."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(pattern), 0), F.lower)


def is_hidden_path(path: Column | str) -> Column:
    """True when any part of a relative POSIX path starts with a dot."""
    return _col(path).rlike(r"(^|/)\.")


def strip_final_newline(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"\n\z", "")


def split_lines(text: Column | str) -> Column:
    """Lines of a text split at ``\\n``; no trailing empty line; empty text has none."""
    t = _col(text)
    return F.when((t.isNull()) | (t == ""), F.array().cast("array<string>")).otherwise(
        F.split(strip_final_newline(t), "\n"))


def decode_utf8_ignore(content: Column | str) -> Column:
    """Bytes to text dropping invalid UTF-8 sequences (``errors='ignore'``)."""
    raw = _col(content).cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.regexp_replace(F.make_valid_utf8(raw), "\uFFFD", ""))


def content_hash(content: Column | str) -> Column:
    """Hex sha1 of the raw bytes (text is hashed as its UTF-8 bytes)."""
    return F.sha1(_col(content).cast("binary"))


def has_nul(content: Column | str) -> Column:
    return F.instr(_col(content).cast("string"), "\u0000") > 0


# Letters that may follow a backslash in Python's or the line
# search program's patterns (anything else is an error there).
_ESCAPES = frozenset("AbBdDsSwWZzntrfvaxuUpPk")
_INLINE = re.compile(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])")


def _class_end(p: str, i: int) -> int:
    """Index after the bracket class that starts at ``i``."""
    j = i + 1
    if p[j:j + 1] == "^":
        j += 1
    if p[j:j + 1] == "]":
        j += 1
    while j < len(p) and p[j] != "]":
        if p.startswith("[:", j) and p.find(":]", j) > 0:
            j = p.find(":]", j) + 2
            continue
        j += 2 if p[j] == "\\" else 1
    if j >= len(p):
        raise ValueError("unterminated character class")
    return j + 1


def _escape_at(p: str, i: int, names: dict[str, str]) -> tuple[str, int]:
    """Java form of the escape at ``i`` and the index after it."""
    c = p[i + 1:i + 2]
    if not c:
        raise ValueError("pattern ends in a backslash")
    if c == "Z":
        return r"\z", i + 2
    if c == "v":
        return r"\x0B", i + 2
    if c == "u" and p[i + 2:i + 3] == "{":
        end = p.index("}", i)
        return r"\x{" + p[i + 3:end] + "}", end + 1
    if c == "U":
        return r"\x{" + p[i + 2:i + 10].lstrip("0").rjust(1, "0") + "}", i + 10
    if c.isascii() and c.isalpha() and c not in _ESCAPES:
        raise ValueError(f"unknown escape \\{c}")
    if c == "k" and p[i + 2:i + 3] == "<":
        end = p.index(">", i)
        return rf"\k<{names.get(p[i + 3:end], p[i + 3:end])}>", end + 1
    return p[i:i + 2], i + 2


def _class_at(p: str, i: int, names: dict[str, str]) -> tuple[str, int]:
    """A bracket class with what only Java treats specially escaped."""
    end = _class_end(p, i)
    j, out = i + 1, "["
    if p[j] == "^":
        out, j = out + "^", j + 1
    first = j
    while j < end - 1:
        if p.startswith("[:", j) and ":]" in p[j:end]:
            k = p.index(":]", j)
            name = p[j + 2:k]
            out += (rf"\P{{{name[1:].capitalize()}}}" if name[:1] == "^" else rf"\p{{{name.capitalize()}}}")
            j = k + 2
        elif p[j] == "\\":
            part, j = (r"\x08", j + 2) if p[j + 1:j + 2] == "b" else _escape_at(p, j, names)
            out += part
        else:
            out += "\\" + p[j] if p[j] in "[&" or (p[j] == "]" and j == first) or (p[j] == "^" and j != first) else p[j]
            j += 1
    return out + "]", end


def java_regex(pattern: str) -> str:
    """A pattern in Python's or the line search program's syntax as the Java
    pattern that ``rlike`` takes, read token by token (escapes, classes, group
    names, inline flags). What neither accepts raises ``invalid-pattern``, as
    does what Java refuses (tried on the driver where a JVM is at hand)."""
    try:
        names: dict[str, str] = {}
        out, i = [], 0
        while i < len(pattern):
            c = pattern[i]
            if c == "\\":
                part, i = _escape_at(pattern, i, names)
                out.append(part)
            elif c == "[":
                part, i = _class_at(pattern, i, names)
                out.append(part)
            elif m := re.compile(r"\(\?P?<([A-Za-z_]\w*)>").match(pattern, i):
                plain = re.fullmatch("[A-Za-z][A-Za-z0-9]*", m[1])
                names[m[1]] = m[1] if plain else f"g{len(names)}x" + re.sub("[^A-Za-z0-9]", "", m[1])
                out.append(f"(?<{names[m[1]]}>")
                i = m.end()
            elif m := re.compile(r"\(\?P=(\w+)\)").match(pattern, i):
                if m[1] not in names:
                    raise ValueError(f"unknown group {m[1]}")
                out.append(rf"\k<{names[m[1]]}>")
                i = m.end()
            elif (m := _INLINE.match(pattern, i)) and (m[1] or m[2]):
                on = "".join(f for f in m[1] if f in "imsx")
                off = (m[2] or "").lstrip("-")
                if set(m[1] + off) - set("aimsuxU") or "U" in m[1] + off:
                    raise ValueError("unsupported inline flag")
                minus = "".join(f for f in off if f in "imsx") + ("U" if "a" in m[1] or "u" in off else "")
                flags = on + (f"-{minus}" if minus else "")
                out.append(f"(?{flags}{m[3]}" if flags else ("(?:" if m[3] == ":" else ""))
                i = m.end()
            else:
                out.append(c)
                i += 1
    except ValueError as exc:
        raise ValueError(f"invalid-pattern: {pattern!r}: {exc}") from exc
    java = REGEX_FLAGS + "".join(out)
    problem = _java_problem(java)
    if problem:
        raise ValueError(f"invalid-pattern: {pattern!r}: {problem}")
    return java


def _java_problem(java: str) -> str | None:
    """Java's complaint about a pattern; Python's where no JVM is running."""
    from pyspark.sql import SparkSession
    session = SparkSession.getActiveSession()
    jvm = getattr(session, "_jvm", None) if session is not None else None
    if jvm is None:
        try:
            plain = java[len(REGEX_FLAGS):].replace(r"\z", r"\Z").replace("(?-U)", "").replace("(?-U:", "(?:")
            re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", plain))
        except re.error as exc:
            return None if r"\p" in java or r"\k" in java or r"\x{" in java else str(exc)
        return None
    try:
        jvm.java.util.regex.Pattern.compile(java)
    except Exception as exc:  # noqa: BLE001 - PatternSyntaxException by way of the gateway
        return str(getattr(exc, "java_exception", exc)).split("\n")[0]
    return None


def glob_to_regex(glob: str) -> str:
    """fnmatch-style glob to an anchored Java regex; ``*`` also crosses ``/``."""
    out = []
    i, n = 0, len(glob)
    while i < n:
        ch = glob[i]
        i += 1
        if ch == "*":
            while i < n and glob[i] == "*":
                i += 1
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i
            if j < n and glob[j] in "!^":
                j += 1
            if j < n and glob[j] == "]":
                j += 1
            while j < n and glob[j] != "]":
                j += 1
            if j >= n:
                out.append(r"\[")
                continue
            body = glob[i:j]
            i = j + 1
            negate = body[:1] in ("!", "^")
            if negate:
                body = body[1:]
            body = body.replace("\\", "\\\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append("[" + ("^" if negate else "") + body + "]")
        else:
            out.append(re.escape(ch))
    return "(?s)^" + "".join(out) + r"\z"


def glob_match(path: Column | str, glob: str) -> Column:
    return _col(path).rlike(glob_to_regex(glob))


def any_glob_match(path: Column | str, globs: list[str]) -> Column:
    """Keep a path when any glob matches the whole path (one rlike, literal pattern)."""
    if not globs:
        return F.lit(True)
    alternatives = "|".join(f"(?:{glob_to_regex(g)})" for g in globs)
    return _col(path).rlike(alternatives)


def relative_path(path: Column | str, root: str) -> Column:
    """Path relative to ``root`` (POSIX), computed once at scan time."""
    prefix = root.rstrip("/") + "/"
    p = _col(path)
    return F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 30)).otherwise(p)

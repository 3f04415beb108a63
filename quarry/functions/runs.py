"""Column functions for the run log: run ids, JSON decoding, metric coercion,
trace validation and display text. All built-in expressions (VARIANT/JSON)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the run-id rules.
SANITISE_PATTERN = "[^A-Za-z0-9_.-]+"
SANITISE_STRIP = "._"

# Why a run id is refused (callers compare these texts).
ID_EMPTY = "run_id must be a non-empty string"
ID_SEPARATOR = "run_id must not contain path separators"
ID_DOTS = "run_id must not contain '..'"
ID_NOTHING_LEFT = "run_id contains no valid characters after sanitisation"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once per row, however often the
    body names it (a column expression is otherwise copied to each place)."""
    return F.get(F.transform(F.array(value), body), 0)


def run_id_problem(run_id: Column | str) -> Column:
    """Null for a valid run id, else the reason it is refused."""
    r = _col(run_id)
    return (F.when(r.isNull() | (r == ""), F.lit(ID_EMPTY))
            .when(r.contains("/") | r.contains("\\"), F.lit(ID_SEPARATOR))
            .when(r.contains(".."), F.lit(ID_DOTS))
            .when(sanitise_run_id(r) == "", F.lit(ID_NOTHING_LEFT)))


def sanitise_run_id(run_id: Column | str) -> Column:
    """Runs of characters outside ``[A-Za-z0-9_.-]`` become ``_``; dots and
    underscores are stripped at both ends."""
    return F.btrim(F.regexp_replace(_col(run_id), SANITISE_PATTERN, "_"), F.lit(SANITISE_STRIP))


def json_object(text: Column | str) -> Column:
    """JSON text -> ordered MAP<STRING,VARIANT>; non-string, empty, malformed
    or non-object input -> empty map."""
    m = F.from_json(mark_bare(_col(text)), "map<string,variant>")
    return F.coalesce(m, F.create_map().cast("map<string,variant>"))


# Stands in front of nan, inf and -inf in place of the bare NaN, Infinity and
# -Infinity that Python's writer leaves in JSON text (a private-use character).
BARE = "\ue000"


def mark_bare(text: Column) -> Column:
    """JSON text with bare NaN and Infinity outside of strings made into marked
    strings, so that JSON functions keep the rest and the two stay apart."""
    parts = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]++|\\.)*+"|[^"]+|"'), F.lit(0))

    def mark(p: Column) -> Column:
        for bare, name in ((r"-Infinity\b", "-inf"), (r"\bInfinity\b", "inf"), (r"\bNaN\b", "nan")):
            p = F.regexp_replace(p, bare, f'"{BARE}{name}"')
        return p

    fixed = F.transform(parts, lambda p: F.when(
        ~p.startswith('"') & (p.contains("NaN") | p.contains("Infinity")), mark(p)).otherwise(p))
    return F.when(text.rlike("NaN|Infinity"), F.array_join(fixed, "")).otherwise(text)


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_number_type(t: Column) -> Column:
    return t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")


# Decimal literal with digit-group underscores, as Python's float() reads it.
_UNDERSCORED = r"^\s*[+-]?([0-9]+(_[0-9]+)*)?(\.([0-9]+(_[0-9]+)*)?)?([eE][+-]?[0-9]+(_[0-9]+)*)?\s*$"


def text_to_double(s: Column) -> Column:
    """Python ``float(str)`` on a string column: Spark-only spellings (suffix
    d/f) are refused; underscores between digits are accepted."""
    cleaned = F.when(s.contains("_") & s.rlike(_UNDERSCORED), F.regexp_replace(s, "_", "")).otherwise(s)
    spark_only = F.trim(s).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]$")
    return F.when(~spark_only, cleaned.try_cast("double"))


def variant_to_double(v: Column) -> Column:
    """float(value) of the reference: numbers and booleans convert, strings
    when they parse as a float, everything else (null, objects, arrays) is null."""
    def convert(t: Column) -> Column:
        # (The three names are compared: to cast them costs an exception each.)
        text = _once(F.try_variant_get(v, "$", "string"), lambda s: F.when(s == BARE + "nan", F.lit(float("nan")))
                     .when(s == BARE + "inf", F.lit(float("inf"))).when(s == BARE + "-inf", F.lit(float("-inf")))
                     .when(s.startswith(BARE), F.substr(s, F.lit(2)).try_cast("double")).otherwise(text_to_double(s)))
        return F.when(_is_number_type(t) | (t == "BOOLEAN"), F.try_variant_get(v, "$", "double")).when(t == "STRING", text)

    return _once(_vtype(v), convert)


def coerce_metrics(text: Column | str) -> Column:
    """Metrics JSON -> MAP<STRING,DOUBLE> in stored order, non-numeric keys dropped."""
    m = F.transform_values(json_object(text), lambda k, v: variant_to_double(v))
    return F.map_filter(m, lambda k, v: v.isNotNull())


def float_text(d: Column) -> Column:
    """A double as Python's ``str`` writes it: the shortest digits, positional
    from 1e-4 to below 1e16, else with an exponent of two digits at least."""
    return _once(d, lambda x: _once(_shortest(x), lambda s: F.when(F.isnan(x), F.lit("nan"))
                 .when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf"))
                 .when(~s.contains("E"), s).otherwise(_python_exponent(s))))


def _shortest(d: Column) -> Column:
    """The text of a double with no needless last digit, which older JVMs write
    for some: fewer digits that still read back as the same value are taken."""
    def fewer_digits(long_form: Column) -> Column:
        tries = F.array(*[F.format_string(f"%.{k}E", d) for k in (14, 15)])
        fewer = F.get(F.filter(tries, lambda t: t.try_cast("double") == d), 0)
        trimmed = F.regexp_replace(F.regexp_replace(fewer, r"(\.[0-9]*?)0+E", "$1E"), r"\.E", ".0E")
        trimmed = F.regexp_replace(F.regexp_replace(trimmed, r"E\+", "E"), r"E(-?)0+([0-9])", "E$1$2")
        wordy = F.length(F.regexp_replace(F.regexp_extract(long_form, r"^-?([0-9.]+)", 1), "[.]", "")) > 16
        return F.when(long_form.contains("E") & wordy, F.coalesce(trimmed, long_form)).otherwise(long_form)

    return _once(d.cast("string"), fewer_digits)


def _python_exponent(s: Column) -> Column:
    """A number's text with an exponent, as Python writes that number."""
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_replace(F.regexp_extract(s, r"^-?([0-9.]+)E", 1), r"\.0$", "")
    parts = F.struct(sign.alias("sign"), F.replace(mantissa, F.lit("."), F.lit("")).alias("digits"),
                     F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int").alias("exp"))

    def written(c: Column) -> Column:
        sign, digits, exp = c["sign"], c["digits"], c["exp"]
        n = F.length(digits)
        zeros = lambda k: F.repeat(F.lit("0"), k)
        whole = F.when(n <= exp + 1, F.concat(digits, zeros(exp + 1 - n), F.lit(".0"))).otherwise(
            F.concat(F.substr(digits, F.lit(1), exp + 1), F.lit("."), F.substr(digits, exp + 2)))
        small = F.concat(F.lit("0."), zeros(-exp - 1), digits)
        power = F.concat(F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(exp).cast("string"), F.greatest(F.length(F.abs(exp).cast("string")), F.lit(2)), F.lit("0")))
        wide = F.concat(F.substr(digits, F.lit(1), F.lit(1)),
                        F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit("")), F.lit("e"), power)
        return (F.when((exp >= 0) & (exp < 16), F.concat(sign, whole))
                .when((exp < 0) & (exp >= -4), F.concat(sign, small))
                .otherwise(F.concat(sign, wide)))

    return _once(parts, written)


def metric_text(metrics: Column | str) -> Column:
    """``k=v, k=v`` in stored order, or ``-`` when empty; floats as Python prints them."""
    entries = F.transform(F.map_entries(_col(metrics)),
                          lambda e: F.concat(e["key"], F.lit("="), float_text(e["value"])))
    return F.when(F.size(entries) > 0, F.array_join(entries, ", ")).otherwise(F.lit("-"))


def summary_text(result_summary: Column | str, items: int = 3) -> Column:
    """First ``items`` scalar entries of a JSON object as ``k=v`` joined by
    ``, ``; nested values and nulls are skipped; booleans print as True/False,
    numbers as Python prints the int or float that was written."""
    # The text of each value as it was written: a number with a point or an
    # exponent is a float.
    as_written = F.coalesce(F.from_json(mark_bare(_col(result_summary)), "map<string,string>"), F.create_map().cast("map<string,string>"))

    def fmt(e: Column, raw: Column) -> Column:
        parts = F.struct(_vtype(e["value"]).alias("t"), F.btrim(F.try_element_at(raw, e["key"]), F.lit('"')).alias("text"),
                         F.try_variant_get(e["value"], "$", "string").alias("value"))

        def shown(p: Column) -> Column:
            t, text, value = p["t"], p["text"], p["value"]
            return (F.when(t == "BOOLEAN", F.initcap(text))
                    .when(_is_number_type(t) & text.rlike("[.eEfN]"), float_text(text.try_cast("double")))
                    .when(_is_number_type(t), text)
                    .when((t == "STRING") & value.startswith(BARE), F.substr(value, F.lit(2)))
                    .when(t == "STRING", value))

        return F.concat(e["key"], F.lit("="), _once(parts, shown))

    entries = F.map_entries(json_object(result_summary))
    picked = _once(as_written, lambda raw: F.filter(F.transform(entries, lambda e: fmt(e, raw)), lambda x: x.isNotNull()))
    return F.array_join(F.slice(picked, 1, items), ", ")


def call_label(step: Column, name: Column, latency_ms: Column, summary: Column) -> Column:
    """``"{i}. {name}\\n{ms} ms"`` plus ``"\\n{summary}"`` when the summary is non-empty."""
    head = F.concat(step.cast("string"), F.lit(". "), name, F.lit("\n"), latency_ms.cast("string"), F.lit(" ms"))
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat(head, F.lit("\n"), summary)).otherwise(head)


def _is_object(v: Column) -> Column:
    # (An object alone is a map; the name of its type would be that of all it holds.)
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


# Text of an integral number: surrounding space, digit groups, a zero fraction.
_INTEGRAL = r"^\s*[+-]?[0-9]+(_[0-9]+)*(\.0+)?\s*$"


def _latency_ok(v: Column) -> Column:
    """Integers, integral floats, booleans and text of integral numbers."""
    s = F.try_variant_get(v, "$", "string")
    d = F.try_variant_get(v, "$", "double")
    return F.coalesce(_once(_vtype(v), lambda t: (
        t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN")
        | ((t.startswith("DECIMAL") | (t == "DOUBLE")) & (d == F.floor(d)) & (F.abs(d) < 9.3e18))
        | ((t == "STRING") & s.rlike(_INTEGRAL)))), F.lit(False))


def latency_value(raw: Column) -> Column:
    """The latency of a valid call, from its raw JSON text, as a long."""
    # (No long has a point or an exponent; to cast such a text costs an exception.)
    return _once(F.regexp_replace(F.trim(raw), "_", ""), lambda plain: (
        F.when(F.lower(plain) == "true", F.lit(1)).when(F.lower(plain) == "false", F.lit(0))
        .otherwise(F.coalesce(F.when(~plain.rlike("[.eE]"), plain.try_cast("long")), plain.try_cast("double").cast("long"))).cast("long")))


def lenient_variant(text: Column | str) -> Column:
    """JSON text as a VARIANT; null where it isn't JSON."""
    return F.try_parse_json(mark_bare(_col(text)))


def _call_ok(c: Column) -> Column:
    g = lambda p: F.try_variant_get(c, p, "variant")
    return (_is_object(c) & F.coalesce(_vtype(g("$.name")) == "STRING", F.lit(False))
            & _is_object(g("$.params")) & _is_object(g("$.result_summary"))
            & _once(g("$.latency_ms"), _latency_ok))


def call_is_valid(call_json: Column | str) -> Column:
    """One ToolCall object (JSON text) against its rules: name string, params
    and result_summary objects, integral latency (booleans and numeric text accepted)."""
    return F.coalesce(_once(lenient_variant(call_json), _call_ok), F.lit(False))


def trace_is_valid(trace: Column | str) -> Column:
    """Validity of a trace document against FlowTrace(run_id: str,
    calls: list[ToolCall] = [], metrics: dict[str, float] = {}).

    Absent ``calls``/``metrics`` default to empty; an explicit JSON null,
    a wrong type, a call missing any field, a non-integral latency or a
    non-numeric metric make the whole trace invalid.
    """
    return marked_trace_is_valid(mark_bare(_col(trace)))


def marked_trace_is_valid(marked: Column | str) -> Column:
    """:func:`trace_is_valid` of JSON text that :func:`mark_bare` has gone over."""
    def valid(v: Column) -> Column:
        rid = F.try_variant_get(v, "$.run_id", "variant")
        calls = F.try_variant_get(v, "$.calls", "variant")
        mets = F.try_variant_get(v, "$.metrics", "variant")
        mets_map = F.try_variant_get(v, "$.metrics", "map<string,variant>")
        calls_ok = calls.isNull() | _once(F.try_variant_get(v, "$.calls", "array<variant>"),
                                          lambda each: each.isNotNull() & F.forall(each, _call_ok))
        mets_ok = mets.isNull() | (_is_object(mets) & F.forall(
            F.map_values(mets_map), lambda x: variant_to_double(x).isNotNull()))
        return _is_object(v) & (_vtype(rid) == "STRING") & calls_ok & mets_ok

    return F.coalesce(_once(F.try_parse_json(_col(marked)), valid), F.lit(False))

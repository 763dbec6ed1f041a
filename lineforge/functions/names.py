"""File-name Column functions: extensions, routing, table/column naming,
format detection and admission checks.  All pure Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Routing defaults, naming limits, markers and formats.
ROUTING_REGEX = "^([A-Z]{2})(\\d)(?:\\d{2})$"
ROUTING_TEMPLATE = "${g1}${g2}"
MAX_IDENTIFIER = 63
EMPTY_TABLE_NAME = "csv_data"
MARKER_EXTENSION = ".done"
WATCH_EXTENSIONS = (".csv", ".zip", "")
DEFAULT_FORMAT = "tsv"
FORMAT_DELIMITERS = {"tsv": "\t", "csv": ",", "pipe": "|"}
FORMAT_HEADERS = {"tsv": False, "csv": True}
ARCHIVE_ENTRY_NAME = "^([A-Z]{2})(\\d+)$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_extension(name) -> Column:
    """From the last dot (only if the dot is not the first char), dot included; else ''."""
    return F.regexp_extract(_c(name), "^.+(\\.[^.]*)$", 1)


def strip_extension(name) -> Column:
    """Stem before the last dot when that dot is not the first char."""
    return F.regexp_replace(_c(name), "^(.+)\\.[^.]*$", "$1")


def route_table(name, regex: str = ROUTING_REGEX, template: str = ROUTING_TEMPLATE,
                groups: int | None = None) -> Column:
    """Target table from a file name: strip extension, match, fill template, lower.

    NULL when the name cannot be routed (see :func:`can_route`).
    """
    base = strip_extension(name)
    if groups is None:
        groups = template.count("${g")
    filled = F.lit(template)
    for i in range(1, groups + 1):
        filled = F.replace(filled, F.lit("${g%d}" % i), F.regexp_extract(base, regex, i))
    return F.when(base.rlike(regex), F.lower(filled))


def can_route(name, regex: str = ROUTING_REGEX) -> Column:
    return F.coalesce(strip_extension(name).rlike(regex), F.lit(False))


def routing_error(name, regex: str = ROUTING_REGEX) -> Column:
    """Message for a name that does not route (NULL when it does)."""
    return F.when(~can_route(name, regex), F.format_string(
        "Filename '%s' does not match routing pattern. Expected pattern: %s", _c(name), F.lit(regex)))


def file_pattern(name) -> Column:
    """Rule key: stem; names starting ``IM``/``PM`` + digit give their first 3 chars."""
    base = strip_extension(name)
    return F.when(base.rlike("^(IM|PM)\\d+"), F.substring(base, 1, 3)).otherwise(base)


def _sanitize(s: Column) -> Column:
    s = F.regexp_replace(F.lower(s), "[^a-zA-Z0-9_]", "_")
    s = F.regexp_replace(s, "_{2,}", "_")
    return F.regexp_replace(s, "^_|_$", "")


def sanitize_table_name(name) -> Column:
    """lower, non-word -> ``_``, collapse ``_`` runs, drop one leading/trailing ``_``."""
    name = _c(name)
    return F.when(name.isNull(), F.lit("")).otherwise(_sanitize(name))


def table_name_from_file(name) -> Column:
    """Strip ``.csv/.gz/.zip`` repeatedly, sanitise, empty -> csv_data, cut to 63."""
    name = _c(name)
    base = F.regexp_replace(name, "(?i)(\\.(csv|gz|zip))+$", "")
    s = _sanitize(base)
    s = F.when(s == "", F.lit(EMPTY_TABLE_NAME)).otherwise(s)
    return F.substring(s, 1, MAX_IDENTIFIER)


def default_table_name(name) -> Column:
    """Un-routed variant: cut the last extension, non-word -> ``_``, lower."""
    return F.lower(F.regexp_replace(strip_extension(name), "[^a-zA-Z0-9_]", "_"))


def sanitize_column_name(name) -> Column:
    """As table names, plus a ``col_`` prefix when the result starts with a digit."""
    s = _sanitize(_c(name))
    return F.when(s.rlike("^\\d"), F.concat(F.lit("col_"), s)).otherwise(s)


def detect_format(name, requested=None, default: str = DEFAULT_FORMAT) -> Column:
    """Explicit csv/tsv (other values -> 'invalid'), else by extension, else default."""
    name = _c(name)
    lower = F.lower(name)
    inferred = F.when(lower.endswith(".tsv"), F.lit("tsv")) \
        .when(lower.endswith(".csv"), F.lit("csv")).otherwise(F.lit(default))
    if requested is None:
        return inferred
    req = F.lower(F.trim(_c(requested)))
    blank = req.isNull() | (req == "")
    return F.when(blank, inferred).when(req.isin("csv", "tsv"), req).otherwise(F.lit("invalid"))


def format_delimiter(fmt) -> Column:
    """Delimiter used to count fields: tsv tab, csv comma, pipe bar, anything else comma."""
    f = F.lower(_c(fmt))
    return F.when(f == "tsv", F.lit("\t")).when(f == "pipe", F.lit("|")).otherwise(F.lit(","))


def format_has_header(fmt) -> Column:
    return F.lower(_c(fmt)) != F.lit("tsv")


def marker_name(name) -> Column:
    return F.concat(_c(name), F.lit(MARKER_EXTENSION))


def data_name_of_marker(marker) -> Column:
    m = _c(marker)
    return F.when(m.endswith(MARKER_EXTENSION),
                  m.substr(F.lit(1), F.length(m) - len(MARKER_EXTENSION))).otherwise(m)


def supported_extension(name, allowed=WATCH_EXTENSIONS) -> Column:
    return F.lower(file_extension(name)).isin(*allowed)


def timestamped_name(name, ts) -> Column:
    """``stem_yyyy-MM-dd_HH-mm-ss.ext`` (extension rule as :func:`file_extension`)."""
    stamp = F.date_format(_c(ts), "yyyy-MM-dd_HH-mm-ss")
    ext = file_extension(name)
    return F.concat(strip_extension(name), F.lit("_"), stamp, ext)


def has_no_extension(name) -> Column:
    """Admission rule: no dot at all, or the dot is the last character."""
    name = _c(name)
    return (F.instr(name, ".") == 0) | name.endswith(".")


def admission_reason(name, size, allowed) -> Column:
    """NULL when the file is admitted, else the rejection text.

    ``allowed`` is a list of extensions without dot; ``""`` admits names
    without an extension.
    """
    name, size = _c(name), _c(size)
    lower = F.lower(name)
    ok = F.lit(False)
    for ext in allowed:
        ok = ok | (has_no_extension(name) if not ext.strip() else lower.endswith("." + ext.lower()))
    shown = ", ".join("(no extension)" if not e.strip() else e.upper() for e in allowed) or "unknown"
    return F.when(size.isNull() | (size <= 0), F.lit("File is empty or not provided")) \
        .when(name.isNull() | (F.trim(name) == ""), F.lit("Invalid filename")) \
        .when(~ok, F.format_string(
            "Invalid file type. Expected %s file but received '%s'. Please upload a valid file.",
            F.lit(shown), name))


def is_data_entry(name, mode: str = "load") -> Column:
    """Archive entry filter: ``.csv``/``.tsv`` (any case) or a bare ``XX9..`` name.

    ``analysis`` mode strips the extension before the name test, ``load`` does not.
    """
    name = _c(name)
    lower = F.lower(name)
    by_ext = lower.endswith(".csv") | lower.endswith(".tsv")
    subject = strip_extension(name) if mode == "analysis" else name
    return by_ext | subject.rlike(ARCHIVE_ENTRY_NAME)

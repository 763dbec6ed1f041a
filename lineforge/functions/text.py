"""Line-level Column functions: character cleaning, tab counting and fixing.

All of these are plain Catalyst expressions, so they run inside whole-stage
codegen with no Python on the executors.  Counts follow UTF-16 units where
the stored metrics depend on them (a supplementary character counts 2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and limits used by cleaning and issue text.
CONTROL_CHARS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
NON_LATIN_CHARS = "[^\\x00-\\x7F]"
SUPPLEMENTARY_CHARS = "[\\x{10000}-\\x{10FFFF}]"
ASTERISK_RUN = "\\*{2,}"
ISO_CONTROL = "[\\x00-\\x1F\\x7F-\\x9F]"
TAB = "\t"
ISSUE_TEXT_LIMIT = 500
REPLACEMENT = "*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def replace_control_chars(line) -> Column:
    """Every control character except TAB, LF and CR becomes ``*``."""
    return F.regexp_replace(_c(line), CONTROL_CHARS, REPLACEMENT)


def count_control_chars(line) -> Column:
    return F.regexp_count(_c(line), F.lit(CONTROL_CHARS))


def is_ascii(line) -> Column:
    """True when every character is below U+0080 (byte length equals character length)."""
    line = _c(line)
    return F.octet_length(line) == F.length(line)


def replace_non_latin(line) -> Column:
    """Every code point above U+007F becomes one ``*`` (ASCII lines skip the regex)."""
    line = _c(line)
    return F.when(is_ascii(line), line).otherwise(F.regexp_replace(line, NON_LATIN_CHARS, REPLACEMENT))


def count_non_latin(line) -> Column:
    """Replacements as UTF-16 units: BMP chars count 1, supplementary 2."""
    line = _c(line)
    return F.when(is_ascii(line), F.lit(0)).otherwise(
        F.regexp_count(line, F.lit(NON_LATIN_CHARS)) + F.regexp_count(line, F.lit(SUPPLEMENTARY_CHARS)))


def collapse_replaced(line) -> Column:
    """Runs of two or more asterisks (including pre-existing ones) -> one."""
    return F.regexp_replace(_c(line), ASTERISK_RUN, REPLACEMENT)


def count_replacements(before, after) -> Column:
    """Length drop plus new asterisks, in UTF-16 units; 0 when unchanged."""
    before, after = _c(before), _c(after)

    def units(s):
        return F.length(s) + F.regexp_count(s, F.lit(SUPPLEMENTARY_CHARS))

    def stars(s):
        return F.length(s) - F.length(F.replace(s, F.lit("*"), F.lit("")))

    return F.when(before == after, F.lit(0)).otherwise(
        (units(before) - units(after)) + (stars(after) - stars(before)))


def clean_line(line, control, non_latin, collapse) -> Column:
    """Clean one line under three rule flags.

    Returns ``struct(cleaned, n_control, n_non_latin, n_collapsed)``.  The
    flags may be literals or columns (from a rule join).  Null or empty lines
    and lines whose rule has all flags off pass through with zero counts.
    """
    line = _c(line)
    control, non_latin, collapse = _c(control), _c(non_latin), _c(collapse)
    active = (control | non_latin | collapse) & line.isNotNull() & (F.length(line) > 0)
    zero = F.lit(0)
    s1 = F.when(control, replace_control_chars(line)).otherwise(line)
    n1 = F.when(control, count_control_chars(line)).otherwise(zero)
    s2 = F.when(non_latin, replace_non_latin(s1)).otherwise(s1)
    n2 = F.when(non_latin, count_non_latin(s1)).otherwise(zero)
    do_collapse = collapse & (F.instr(s2, "**") > 0)
    s3 = F.when(do_collapse, collapse_replaced(s2)).otherwise(s2)
    # only asterisks are removed by the collapse, so the length drop is the count
    n3 = F.when(do_collapse, F.length(s2) - F.length(s3)).otherwise(zero)
    return F.when(active, F.struct(
        s3.alias("cleaned"), n1.alias("n_control"), n2.alias("n_non_latin"),
        n3.alias("n_collapsed"),
    )).otherwise(F.struct(
        line.alias("cleaned"), zero.alias("n_control"), zero.alias("n_non_latin"),
        zero.alias("n_collapsed"),
    ))


def count_tabs(line) -> Column:
    """Number of TAB characters (0 for an empty line)."""
    line = _c(line)
    return F.length(line) - F.length(F.replace(line, F.lit(TAB), F.lit("")))


def count_fields(line, delimiter: str = TAB) -> Column:
    """Fields on a line split by ``delimiter`` with trailing empties; '' -> 0."""
    line = _c(line)
    n = F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit(""))) + 1
    return F.when(line.isNull() | (F.length(line) == 0), F.lit(0)).otherwise(n)


def fix_excess_tabs(line, expected) -> Column:
    """Keep the first ``expected`` tabs; every later tab becomes one space."""
    line = _c(line)
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    head = F.call_function("substring_index", line, F.lit(TAB), expected)
    tail = line.substr(F.length(head) + 2, F.lit(2147483647))
    kept = F.concat(head, F.lit(TAB), F.replace(tail, F.lit(TAB), F.lit(" ")))
    return F.when(expected <= 0, F.replace(line, F.lit(TAB), F.lit(" "))) \
        .when(count_tabs(line) > expected, kept).otherwise(line)


def issue_text(s, limit: int = ISSUE_TEXT_LIMIT) -> Column:
    """NUL -> ``*`` then cut to ``limit`` characters plus ``...``."""
    s = F.replace(_c(s), F.lit("\u0000"), F.lit("*"))
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s)


def java_trim(s) -> Column:
    """Strip every character <= U+0020 from both ends (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(s), "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")


def pin_fix_control(line, min_length: int = 7) -> Column:
    """Insert ``0000`` at 0-based index 6 when that character is an ISO control."""
    line = _c(line)
    cond = (F.length(line) > min_length) & F.substring(line, 7, 1).rlike(ISO_CONTROL)
    return F.when(cond, F.concat(F.substring(line, 1, 6), F.lit("0000"), F.substring(line, 7, 2147483647))) \
        .otherwise(line)


def pin_fix_nondigit(line, min_length: int = 6) -> Column:
    """When index 6 is not a digit: first 6 chars + ``0000`` + text from index 10."""
    line = _c(line)
    cond = (F.length(line) > min_length) & ~F.substring(line, 7, 1).rlike("^\\p{Nd}$")
    return F.when(cond, F.concat(F.substring(line, 1, 6), F.lit("0000"), F.substring(line, 11, 2147483647))) \
        .otherwise(line)


def zero_date_to_null(s) -> Column:
    """``0000/00/00`` or blank -> NULL, anything else kept as text."""
    s = _c(s)
    return F.when((s == "0000/00/00") | (F.length(s) == 0), F.lit(None).cast("string")).otherwise(s)


def im2_transform(line) -> Column:
    """Trim every tab field (Java trim); field 4 ``0000/00/00`` or blank -> empty."""
    line = _c(line)
    fields = F.transform(F.split(line, TAB, -1), lambda f: java_trim(f))
    fixed = F.transform(fields, lambda f, i: F.when(
        (i == 3) & ((f == "0000/00/00") | (f == "")), F.lit("")).otherwise(f))
    return F.when(line.isNull() | (F.length(line) == 0), line).otherwise(F.array_join(fixed, TAB))

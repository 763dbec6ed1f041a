"""CSV text as Column expressions: row parse, CSV -> tab row, header names.

``csv_row_parse`` follows the quote-toggle reading (``""`` inside quotes is a
literal quote, every field trimmed, one physical line is one row).  The line
is split at its quotes once, so the cost is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import sanitize_column_name
from .text import java_trim

# Stands for a comma outside quotes while the pieces are put together again.
FIELD_END = "\u0000\u0001,"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def csv_row_parse(line) -> Column:
    """``array<string>`` of trimmed field values of one CSV line."""
    line = _c(line)
    pieces = F.split(line, '"', -1)  # outside and inside quotes in turn
    # an empty piece between two quoted ones is a doubled quote
    joined = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, p)
                                      .when((p == "") & (i > 0) & (i < F.size(pieces) - 1), F.lit('"'))
                                      .otherwise(F.replace(p, F.lit(","), F.lit(FIELD_END)))), "")
    return F.transform(F.split(joined, FIELD_END, -1), lambda f: java_trim(f))


def csv_to_tsv(line, width) -> Column:
    """Parsed values re-emitted as one tab row of exactly ``width`` fields.

    Missing values become empty, extra values are dropped, tabs and LF
    inside a value become a space and CR is removed.
    """
    vals = csv_row_parse(line)
    width = width if isinstance(width, Column) else F.lit(width)
    idx = F.sequence(F.lit(0), width - 1)
    cells = F.transform(idx, lambda i: F.translate(
        F.replace(F.coalesce(F.get(vals, i), F.lit("")), F.lit("\r"), F.lit("")), "\t\n", "  "))
    return F.when(width > 0, F.array_join(cells, "\t")).otherwise(F.lit(""))


def header_columns(line, mode: str = "csv") -> Column:
    """Column names from a header line.

    ``csv``: quote-aware parse, names sanitised, blanks dropped.
    ``naive``: split on every comma (trailing empty pieces dropped), trim, lower.
    """
    line = _c(line)
    if mode == "csv":
        names = F.transform(csv_row_parse(line), lambda f: sanitize_column_name(f))
        return F.filter(names, lambda n: n != "")
    stripped = F.regexp_replace(line, ",+$", "")
    pieces = F.transform(F.split(stripped, ",", -1), lambda f: F.lower(java_trim(f)))
    return F.when(line.rlike("^,*$"), F.array().cast("array<string>")).otherwise(pieces)

"""Column -> Column text helpers with Python ``str`` semantics.

Python's ``split()``/``strip()`` treat every Unicode whitespace character plus
the separators U+001C..U+001F as blanks; Spark's ``trim`` only strips spaces
and Java's ``\\s`` is ASCII.  ``PY_WS`` spells the Python class out so the
same pattern works in Java regex (Spark) and RE2 (DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters for which Python's str.isspace() is true.
PY_WS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
PY_WS_RUN = PY_WS + "+"
#: The same characters one by one, for ``btrim``.
PY_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_str(col: Column | str) -> Column:
    """``str(x)`` of a nullable string: None becomes ``'None'``."""
    return F.coalesce(_c(col), F.lit("None"))


def py_strip(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), f"^{PY_WS_RUN}|{PY_WS_RUN}$", "")


def py_split(col: Column | str) -> Column:
    """``str.split()`` with no argument: whitespace runs, no empty tokens."""
    return F.filter(F.split(_c(col), PY_WS_RUN), lambda t: t != "")


def extract_text(columns: list[str]) -> Column:
    """Text a check looks at, chosen statically from the schema.

    ``text`` if present; else the contents of ``messages`` joined by a space;
    else ``input + ' ' + output`` stripped; else the whole row as JSON.
    """
    if "text" in columns:
        return py_str("text")
    if "messages" in columns:
        parts = F.transform(F.col("messages"), lambda m: F.coalesce(m["content"], F.lit("None")))
        return F.coalesce(F.array_join(parts, " "), F.lit("None"))
    if "input" in columns and "output" in columns:
        return py_strip(F.concat_ws(" ", F.coalesce(F.col("input"), F.lit("")), F.coalesce(F.col("output"), F.lit(""))))
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def normalize_pair_text(col: Column | str) -> Column:
    """``str(x).strip().lower()`` used to compare chosen and rejected."""
    return F.lower(py_strip(py_str(col)))


def py_strip_length(col: Column | str) -> Column:
    """``len(s.strip())`` from two anchored matches (leading whitespace of the
    text and of its reverse): linear, no unanchored scan of long texts."""
    s = _c(col)
    n = F.length(s)
    lead = F.length(F.regexp_extract(s, f"^{PY_WS}*", 0))
    trail = F.length(F.regexp_extract(F.reverse(s), f"^{PY_WS}*", 0))
    return F.when(lead >= n, F.lit(0)).otherwise(n - lead - trail)


def fixed(x: Column, digits: int) -> Column:
    """``f"{x:.{digits}f}"``: rounded by the exact binary value, ties to even, as Python and C do.

    The JVM rounds the shortest decimal text of a double instead (43.55 to 43.6, though the double
    lies below 43.55).  The product with 10**digits is taken with its rounding error, which decides ties.
    """
    scale = F.lit(10.0**digits)
    p = x * scale
    c = x * F.lit(134217729.0)  # 2**27 + 1: splits a double in two halves whose products are exact
    hi = c - (c - x)
    error = (hi * scale - p) + (x - hi) * scale if digits else F.lit(0.0)
    n = F.floor(p)
    rest = p - n
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (n % 2 != 0))))
    return F.format_string(f"%.{digits}f", (n + up.cast("int")) / scale)

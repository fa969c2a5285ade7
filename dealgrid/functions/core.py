"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def enum_invalid(col: Column | str, values: list[str]) -> Column:
    """True when the value is outside the domain; NULL counts as invalid."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(~c.isin(*values), F.lit(True))


def count_if(cond: Column) -> Column:
    """Number of rows where ``cond`` is true (NULL counts as false); 0 on empty input."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def half_up_ratio(num: str, den: str, digits: int = 0, scale: int = 1) -> Column:
    """round(num * scale / den, digits) with exact half-away-from-zero rounding.

    ``num`` and ``den`` are SQL expressions of integral values.  The rounding is
    done on 38-digit decimals with an integer quotient (``div``): exact, unlike
    rounding a double, and free of overflow for sums over any number of rows (the
    rounded quotient itself must fit in 64 bits).  NULL when ``den`` is 0 or NULL.
    """
    p = 10 ** digits * scale
    n = f"(CAST({num} AS DECIMAL(38,0)) * {p})"
    d = f"CAST(nullif({den}, 0) AS DECIMAL(38,0))"
    q = f"((2 * abs({n}) + abs({d})) div (2 * abs({d})))"
    return F.expr(f"CAST(signum({n}) * signum({d}) * {q} AS DOUBLE) / {10 ** digits}")


def capitalize(col: Column | str) -> Column:
    """Python ``str.capitalize``: first character upper, all others lower."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def pretty_label(col: Column | str) -> Column:
    """``'_'`` -> space, then capitalize (``medical_devices`` -> ``Medical devices``)."""
    c = F.col(col) if isinstance(col, str) else col
    return capitalize(F.replace(c, F.lit("_"), F.lit(" ")))


def money(col: Column | str) -> Column:
    """``$1,234,567`` for a whole number of dollars."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit("$"), F.format_number(c.cast("double"), 0))


# Whitespace exactly as Python's ``str.split()`` / ``str.strip()`` see it: the
# characters for which ``str.isspace()`` is true (none lies above U+3000).
WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# The same 29 characters as a Java regex class (``\s`` is ASCII
# [ \t\n\x0B\f\r] in Java); ranges keep the matcher fast.
WS_CLASS = (r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def split_words(col: Column | str) -> Column:
    """Python ``text.split()``: one regex split on whitespace runs, then the empty
    strings a leading or trailing run (or an empty text) leaves are removed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_remove(F.split(c, f"{WS_CLASS}+"), "")


def strip_ws(col: Column | str) -> Column:
    """Python ``str.strip()``: a character-set trim, no regex."""
    c = F.col(col) if isinstance(col, str) else col
    return F.btrim(c, F.lit(WS_CHARS))


def padded_id(prefix: str, n: Column | str, width: int = 4) -> Column:
    """``prefix`` + zero-padded number (``LEAD0001``); wider numbers are kept whole."""
    c = F.col(n) if isinstance(n, str) else n
    return F.format_string(f"{prefix}%0{width}d", c.cast("long"))

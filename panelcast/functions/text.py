"""Text cleaning expressions (STR1-STR6).  All return NULL rather than raising (ANSI mode)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal / scientific number, optionally signed and padded.  Guards
# ``try_cast`` against Java-only literals such as '1d' or '2f' (pandas: NaN).
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Sentinel strings that mean "no measurement".
MISSING_TOKENS = ("---", "-", "")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def station_code(c, pattern: str = r"DKI\d") -> Column:
    """First ``DKI<digit>`` in the text, NULL if there is none (STR1)."""
    return F.regexp_substr(_c(c), F.lit(pattern))


def station_code_or_keep(c) -> Column:
    """Case-insensitive ``DKI<digits>`` upper-cased; the original text if none (STR1 variant)."""
    c = _c(c)
    return F.coalesce(F.upper(F.regexp_substr(c, F.lit(r"(?i)DKI\d+"))), c)


def to_number(c, missing=MISSING_TOKENS) -> Column:
    """Sentinels and blanks -> NULL, then a number or NULL (STR2)."""
    s = F.trim(_c(c).cast("string"))
    ok = s.rlike(NUMBER_RE) & ~s.isin(*missing)
    return F.when(ok, s.try_cast("double"))


def european_number(c, thousands: str = ".", decimal: str = ",") -> Column:
    """European number text -> double (STR3): drop thousands separators, decimal comma
    to point.  Like the reference, an already dotted decimal loses its point
    ('-6.2' -> -62); pass ``thousands=''`` for text that has none."""
    s = _c(c).cast("string")
    if thousands:
        s = F.replace(s, F.lit(thousands), F.lit(""))
    if decimal != ".":
        s = F.replace(s, F.lit(decimal), F.lit("."))
    return to_number(s)


def strip_censoring(c) -> Column:
    """Drop leading ``< > ≤ ≥`` / blanks and trailing ``< > = ≤ ≥`` / blanks (STR4).
    '<=5' keeps '=5', which then is not a number."""
    return F.regexp_replace(_c(c), r"^[<>≤≥\s]+|[<>=≤≥\s]+$", "")


def censored_number(c, european: bool = True) -> Column:
    """STR4 then STR3: '<0,002' -> 0.002."""
    s = strip_censoring(c)
    return european_number(s) if european else to_number(s)


def title_case(c) -> Column:
    """Capitalise each blank-separated word (STR5; pandas ``str.title`` also
    capitalises after '-' and apostrophes)."""
    return F.initcap(_c(c))


def strip_prefix(c, prefix: str) -> Column:
    c = _c(c)
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def strip_suffix(c, suffix: str) -> Column:
    return F.regexp_replace(_c(c), re.escape(suffix) + "$", "")


def zero_pad(c, width: int = 2) -> Column:
    """Left pad with zeros (STR6)."""
    return F.lpad(_c(c).cast("string"), width, "0")


def slice_text(c, start: int, length: int | None = None) -> Column:
    """1-based substring (STR6)."""
    return F.substring(_c(c).cast("string"), start, length if length is not None else 1 << 30)

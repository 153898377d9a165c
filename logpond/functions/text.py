"""Text helpers (P17, P21) as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logpond.functions.values import double_text


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal(term: str) -> str:
    """A pattern for the term itself."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def body_hits(body, term: str) -> tuple[Column, Column]:
    """(parts, hits). ``parts`` is the body split around every
    occurrence of the trimmed term in any case, also of letters beyond
    ASCII, matches kept as their own elements between the rest; ``hits``
    counts the occurrences. A blank term gives the whole body and 0 hits."""
    b = _col(body)
    t = term.strip()
    if not t:
        return F.array(b), F.lit(0)
    pattern = "(?iu)" + _literal(t)
    found = F.regexp_extract_all(b, F.lit(pattern), F.lit(0))
    parts = F.flatten(F.transform(F.split(b, pattern), lambda gap, i: F.when(
        i < F.size(found), F.array(gap, F.get(found, i))).otherwise(F.array(gap))))
    return parts, F.size(found)


def _round_half_up(v: Column, digits: int) -> Column:
    scale = 10 ** digits
    return F.floor(v * scale + 0.5) / scale


def _three_significant(v: Column) -> Column:
    """Three significant digits for v >= 1: plain below 1000, with an
    exponent from there on (rounding can carry into it)."""
    r0, r1, r2 = _round_half_up(v, 0), _round_half_up(v, 1), _round_half_up(v, 2)
    power = F.floor(F.log10(v) + 1e-12)
    digits = F.floor(v / F.pow(F.lit(10.0), power - 2) + 0.5)       # 100 to 1000
    carry = digits >= 1000
    exponent = F.concat(F.format_string("%.2f", F.when(carry, F.lit(1.0)).otherwise(digits / 100)), F.lit("e+"),
                        F.when(carry, power + 1).otherwise(power).cast("int").cast("string"))
    return (F.when(r0 >= 1000, exponent)
            .when(v >= 100, F.format_string("%.0f", r0))
            .when(v >= 10, F.when(r1 >= 100, F.lit("100")).otherwise(F.format_string("%.1f", r1)))
            .otherwise(F.when(r2 >= 10, F.lit("10.0")).otherwise(F.format_string("%.2f", r2))))


def short_number(x) -> Column:
    """>= 1e9 -> ``B``, >= 1e6 -> ``M``, >= 1e3 -> ``k`` with three
    significant digits; smaller numbers in shortest form, plain down to 1e-6
    and with an exponent below."""
    x = _col(x).cast("double")
    tiny = F.regexp_replace(F.lower(x.cast("string")), r"\.0(?=e)", "")      # 1.0E-7 -> 1e-7
    return (F.when(x >= 1e9, F.concat(_three_significant(x / 1e9), F.lit("B")))
            .when(x >= 1e6, F.concat(_three_significant(x / 1e6), F.lit("M")))
            .when(x >= 1e3, F.concat(_three_significant(x / 1e3), F.lit("k")))
            .when((x != 0) & (F.abs(x) < 1e-6), tiny)
            .otherwise(double_text(x)))


def fixed(x, digits: int) -> Column:
    """``toFixed(digits)`` for non-negative numbers (half up)."""
    return F.format_string(f"%.{digits}f", _round_half_up(_col(x).cast("double"), digits))

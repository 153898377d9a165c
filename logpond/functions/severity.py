"""Severity helpers (P15, P16) as JVM column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from logpond import schema as S


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(base: Column) -> Column:
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(S.SEVERITY_NORMALISE.items())])
    return F.coalesce(F.try_element_at(m, base), F.lit(S.SEVERITY_FALLBACK))


def severity_normalise(text, strip_digits: bool = True) -> Column:
    """Trailing digits stripped (``WARN3`` -> ``warn``), lower-cased,
    ``warning`` -> ``warn``; empty, NULL or unknown -> ``info``. With
    ``strip_digits=False`` this is the search-table variant."""
    t = _col(text)
    base = F.lower(F.regexp_replace(t, r"\d+$", "") if strip_digits else t)
    return F.when(t.isNull() | (t == ""), F.lit(S.SEVERITY_FALLBACK)).otherwise(_lookup(base))


def severity_band(number) -> Column:
    """Band name of a severity number; NULL outside 5-24."""
    n = _col(number)
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(S.SEVERITY_BANDS):
        out = F.when(n.between(lo, hi), F.lit(name)).otherwise(out)
    return out

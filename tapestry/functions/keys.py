"""Keys, names and scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapestry.functions._util import as_col

_PROPAGATE = object()


def surrogate_key(*cols, null="NA") -> Column:
    """md5 over the concatenation of ``cols``.

    ``null='NA'`` (I1) or ``null=''`` (I2): a NULL part is replaced by that text,
    so the key is never NULL.  ``null=None`` (I3): NULL-propagating — any NULL
    part gives a NULL key.  Every part is cast to string first, so dates and
    numbers hash by their text form.
    """
    parts = [as_col(c).cast("string") for c in cols]
    if null is None:
        return F.md5(F.concat(*parts))
    return F.md5(F.concat(*[F.coalesce(p, F.lit(null)) for p in parts]))


def full_name(*parts) -> Column:
    """I4: present parts joined by single spaces, NULL parts skipped (no stray
    space); an empty-string part still counts as present."""
    return F.concat_ws(" ", *[as_col(p) for p in parts])


def padded_name(*parts) -> Column:
    """``trim(concat(coalesce(part, ' ') ...))``."""
    return F.trim(F.concat(*[F.coalesce(as_col(p), F.lit(" ")) for p in parts]))


def split_code(c) -> tuple[Column, Column]:
    """(base, extension) of a code such as ``12345-6789``: characters 1-5
    and up to ten characters from position 7.  Both come from the original
    value, so the extension must be taken before the base overwrites it."""
    c = as_col(c)
    return F.substring(c, 1, 5), F.substring(c, 7, 10)


def first_non_empty(a, b) -> Column:
    """C4: ``a`` when it is a non-empty string, else ``b`` (a NULL ``a`` falls to
    ``b`` because ``NULL != ''`` is not true)."""
    a = as_col(a)
    return F.when(a != "", a).otherwise(as_col(b))


def iso_ts(c) -> Column:
    """ISO-8601 text with milliseconds and offset (``Z`` in a UTC session)."""
    return F.date_format(as_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def base_name(c, first: bool = False) -> Column:
    """Last (or first) dot-separated segment of a qualified name."""
    parts = F.split(as_col(c), r"\.")
    return F.element_at(parts, 1 if first else -1)


def clamp(c, lo: float = 0.1, hi: float = 1.0) -> Column:
    """``max(min(c, hi), lo)``."""
    return F.greatest(F.least(as_col(c), F.lit(hi)), F.lit(lo))

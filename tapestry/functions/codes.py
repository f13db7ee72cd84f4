"""Code translation and classification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapestry.functions._util import as_col

# --- fixed values -----------------------------------------------------------
# Provider role by primary-care code: code -> (pcp_ind, role).  More than one
# distinct code means both roles.
ROLE_CODES = {
    "P": (True, "PCP"),
    "S": (False, "Specialist"),
    "B": (True, "Both PCP and Specialist"),
}
ROLE_MANY = (True, "Both PCP and Specialist")
# ---------------------------------------------------------------------------

_SELF = object()


def translate(c, mapping: Mapping, else_=None, *, keep_other: bool = False) -> Column:
    """I8: translate a code through ``mapping`` (first match wins); other values
    become ``else_`` (``''``, NULL, ...) or stay themselves with ``keep_other``."""
    c = as_col(c)
    out = None
    for k, v in mapping.items():
        cond = c == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    other = c if keep_other else F.lit(else_)
    return other if out is None else out.otherwise(other)


def classify(c, lists: Mapping[str, Sequence], else_=None) -> Column:
    """Many-to-one classification by value lists, first list wins."""
    c = as_col(c)
    out = None
    for label, values in lists.items():
        cond = c.isin(list(values))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(else_) if out is None else out.otherwise(F.lit(else_))


def yes_no(c) -> Column:
    """I10: 'Y' -> true, 'N' -> false, anything else NULL."""
    c = as_col(c)
    return F.when(c == "Y", F.lit(True)).when(c == "N", F.lit(False)).otherwise(F.lit(None).cast("boolean"))


def role_of(codes, table: Mapping = ROLE_CODES, many=ROLE_MANY) -> Column:
    """struct<pcp_ind boolean, service_provider_role string> from a set of
    codes.  One code -> its entry (unknown code -> NULLs); several -> ``many``;
    none (or NULL) -> NULLs."""
    arr = F.coalesce(as_col(codes), F.array().cast("array<string>"))
    n = F.size(arr)
    first = F.get(arr, F.lit(0))
    ind = F.lit(None).cast("boolean")
    role = F.lit(None).cast("string")
    ind_one, role_one = None, None
    for code, (i, r) in table.items():
        cond = first == F.lit(code)
        ind_one = F.when(cond, F.lit(i)) if ind_one is None else ind_one.when(cond, F.lit(i))
        role_one = F.when(cond, F.lit(r)) if role_one is None else role_one.when(cond, F.lit(r))
    ind = F.when(n > 1, F.lit(many[0])).when(n == 1, ind_one).otherwise(ind)
    role = F.when(n > 1, F.lit(many[1])).when(n == 1, role_one).otherwise(role)
    return F.struct(ind.cast("boolean").alias("pcp_ind"), role.cast("string").alias("service_provider_role"))

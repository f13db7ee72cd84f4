"""Name and text clean-up rules for mapping rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapestry.functions._util import as_col

# --- fixed values (must equal the documented behaviour) ---------------------
# Names that are method names, function names or date formats, never columns.
UNWANTED_NAMES = [
    "alias", "isNull", "isNotNull", "isin", "otherwise", "when", "between",
    "startswith", "endswith", "contains", "cast", "substr", "rlike", "like",
    "over", "desc", "asc", "asc_nulls_first", "asc_nulls_last", "desc_nulls_first",
    "desc_nulls_last", "getItem",
    "coalesce", "substring", "upper", "lower", "trim", "ltrim", "rtrim",
    "regexp_replace", "regexp_extract", "concat", "concat_ws", "collect_set",
    "length", "date_format", "to_date", "to_timestamp", "from_unixtime",
    "unix_timestamp", "nvl", "ifnull", "explode", "explode_outer", "posexplode",
    "posexplode_outer", "element_at", "array", "struct",
    "yyyy-MM-dd", "MM-dd-yyyy", "dd-MM-yyyy", "yyyyMMdd",
]
# A column name containing any of these characters is rejected.
INVALID_SYMBOLS = "-:<>/\\|&=+*^%$#@!~`"
# Output naming: characters removed from a target name, its maximum length,
# the name used when nothing is left, and the name of a missing target.
OUTPUT_NAME_DROP = "<>[]:*?/\\'"
OUTPUT_NAME_MAX = 31
OUTPUT_NAME_EMPTY = "Sheet1"
OUTPUT_NAME_MISSING = "unknown"
# ---------------------------------------------------------------------------

# identifier syntax (letters/underscore first, then letters, digits, underscore)
IDENTIFIER_RE = r"^[\p{L}_][\p{L}\p{N}_]*\z"


# Python's str.strip() whitespace: ASCII controls \t \n \v \f \r, the
# separators \x1c-\x1f, space, and the Unicode spaces.
PY_WHITESPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


PY_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(x) for x in range(0x2000, 0x200B))
                       + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """Strip leading/trailing whitespace exactly as Python's ``str.strip``."""
    return F.regexp_replace(as_col(c), f"^{PY_WHITESPACE}+|{PY_WHITESPACE}+$", "")


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def clean_table(c) -> Column:
    """NULL/''/'unknown' -> 'unknown'; else strip, lower-case and drop one
    trailing ``_df``."""
    c = as_col(c)
    cleaned = F.regexp_replace(F.lower(py_strip(c)), "_df$", "")
    return F.when(_blank(c) | (c == "unknown"), F.lit("unknown")).otherwise(cleaned)


def clean_column(c) -> Column:
    """NULL/''/'unknown' -> 'unknown'; else strip and remove one pair of
    surrounding double quotes, or else one pair of single quotes."""
    c = as_col(c)
    s = py_strip(c)
    inner = F.when(F.length(s) >= 2, F.regexp_replace(s, r"(?s)^.(.*).$", "$1")).otherwise(F.lit(""))
    quoted = (s.startswith('"') & s.endswith('"')) | (s.startswith("'") & s.endswith("'"))
    return F.when(_blank(c) | (c == "unknown"), F.lit("unknown")).when(quoted, inner).otherwise(s)


def clean_rule(c) -> Column:
    """NULL/'' -> ''; strip; remove ``F.`` and then ``pyspark.sql.functions.``."""
    c = as_col(c)
    s = F.replace(F.replace(py_strip(c), F.lit("F."), F.lit("")), F.lit("pyspark.sql.functions."), F.lit(""))
    return F.when(_blank(c), F.lit("")).otherwise(s)


def clean_field(c) -> Column:
    """NULL/'' -> ''; strip."""
    c = as_col(c)
    return F.when(_blank(c), F.lit("")).otherwise(py_strip(c))


def is_column_name(c) -> Column:
    """Non-empty, not a known method/function/date-format name, none of the
    invalid symbols, identifier syntax."""
    c = as_col(c)
    symbol_class = "[" + "".join("\\" + ch for ch in INVALID_SYMBOLS) + "]"
    return (
        c.isNotNull()
        & (c != "")
        & ~c.isin(UNWANTED_NAMES)
        & ~c.rlike(symbol_class)
        & c.rlike(IDENTIFIER_RE)
    )


def output_name(c, ts=None, prefix=None) -> Column:
    """Output name of a target table — NULL/'' -> 'unknown'; dots become
    underscores; ``<>[]:*?/\\'`` are dropped; keep 31 characters; nothing left
    -> 'Sheet1'.  With ``prefix``/``ts``: ``prefix_name_yyyyMMdd_HHmmss``."""
    c = as_col(c)
    raw = F.when(_blank(c), F.lit(OUTPUT_NAME_MISSING)).otherwise(c)
    base = F.substring(F.translate(F.replace(raw, F.lit("."), F.lit("_")), OUTPUT_NAME_DROP, ""), 1, OUTPUT_NAME_MAX)
    base = F.when(base == "", F.lit(OUTPUT_NAME_EMPTY)).otherwise(base)
    parts = ([F.lit(prefix)] if prefix is not None else []) + [base]
    if ts is not None:
        parts.append(F.date_format(as_col(ts), "yyyyMMdd_HHmmss"))
    return F.concat_ws("_", *parts) if len(parts) > 1 else base

"""Tokens of script expressions as regular expressions, and the one-pass renaming
of names (D14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapestry.operators.calls import LITERAL

_STRING = r"(?:\"[^\"\n]*\"|'[^'\n]*')"
NAME = r"[A-Za-z_]\w*+"
#: Tokens of an expression: strings and comments, numbers, attributes of a call's
#: result, col("x"), a name with its attributes (no methods) and string
#: subscripts, any other character.
_AFTER_CALL = r"\.\s*" + NAME + r"(?:\s*\.\s*" + NAME + ")*"
_COL = r"(?:" + NAME + r"\s*\.\s*)?\bcol\(\s*" + _STRING + r"\s*\)"
_PATH = NAME + r"(?:\s*\.\s*" + NAME + r"(?!\s*\()|\s*\[\s*" + _STRING + r"\s*\])*+"
TOKEN = r"(?:" + LITERAL + r"|\d[\w.]*+|" + _AFTER_CALL + "|" + _COL + "|" + _PATH + r"|[\s\S])"
#: Words of a text: strings and comments, numbers, dotted names, other characters.
WORD = r"(?:" + LITERAL + r"|\d[\w.]*+|" + _AFTER_CALL + "|" + NAME + r"(?:\s*\.\s*" + NAME + r")*+|[\s\S])"


def rename_heads(text: Column, names: Column) -> Column:
    """The first part of every dotted name replaced by the map ``names``: each
    name once, so a table called like another variable stays; strings, comments
    and attributes of a call's result are left alone."""
    head = lambda w: F.regexp_extract(w, r"^([A-Za-z_]\w*)\s*\.", 1)
    new = lambda w: F.coalesce(F.try_element_at(names, head(w)), head(w))
    word = lambda w: F.when(head(w) == "", w).otherwise(F.concat(new(w), w.substr(F.length(head(w)) + 1, F.length(w))))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), word), "")

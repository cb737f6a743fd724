"""Reading of category, source and bin names as they were meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of blanks, hyphens and underscores are one separator between words.
_SEPARATORS = r"(?U)[\s_\-‐-―]+"


def name_key(c: Column) -> Column:
    """Lower case, outer blanks dropped, any separator between words as ``_``; an empty name is null."""
    s = F.regexp_replace(F.lower(c), _SEPARATORS, "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s != "", s)


def bin_key(c: Column) -> Column:
    """A pressure bin's two bounds as ``a-b`` with one decimal place, whatever the notation; otherwise null."""
    lo = F.regexp_extract(c, r"(\d+(?:\.\d+)?)\D+(\d+(?:\.\d+)?)\s*[\])]?\s*$", 1)
    hi = F.regexp_extract(c, r"(\d+(?:\.\d+)?)\D+(\d+(?:\.\d+)?)\s*[\])]?\s*$", 2)
    text = F.format_string("%.1f-%.1f", lo.try_cast("double"), hi.try_cast("double"))
    return F.when((lo != "") & (hi != ""), text)

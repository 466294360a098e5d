"""Column expressions for keys written by hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that say there is no value, as they look after normal_key.
NO_VALUE = ["", "NONE", "NA", "NOTAPPLICABLE", "UNKNOWN", "SPORADIC", "MISSING", "NOTPROVIDED", "NOTCOLLECTED", "NOTKNOWN", "NONEGIVEN", "NOTDETERMINED", "NULL", "NAN", "NO", "RESTRICTEDACCESS"]


def normal_key(c: Column) -> Column:
    """Upper-case letters and digits of a text."""
    return F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]+", "")


def accession_key(c: Column) -> Column:
    """The isolate an accession names, whatever its case, blanks, punctuation and version suffix; null for none."""
    key = normal_key(F.regexp_replace(c, r"\.[0-9]{1,2}\s*$", ""))
    return F.when(~key.isin(NO_VALUE), key)


def outbreak_key(c: Column) -> Column:
    """An outbreak code whatever its case, blanks and punctuation; null where the text says none or not known."""
    key = normal_key(c)
    return F.when(~key.isin(NO_VALUE), key)


def site_key(c: Column) -> Column:
    """Name and number of the site in a source text ("Bovine:elm ford #10"), whatever the writing; null for a class only.

    The class stands first or, after ; or in brackets, last; "no" before the number is dropped.
    """
    text = F.lower(c)
    last = F.regexp_extract(text, r"^(.*[0-9])\s*(?:;.*|\(.*\)\s*)$", 1)
    first = F.regexp_extract(text, r"^\s*\p{L}+\s*(?:[:/,\-]|\s{2,})\s*(.*[0-9].*)$", 1)
    site = F.when(last != "", last).when(first != "", first)
    bare = F.regexp_replace(F.regexp_replace(site, r"\bno\b\.?", " "), r"[^\p{L}\p{N}]+", "")
    return F.when(bare.rlike(r"^\p{L}+[0-9]+$"), bare)

"""Several values packed in one text field: one row for each value, its position kept.

Quoted spans are swapped for indexed placeholders that cannot occur in the text, the remaining delimiters split
the text, each placeholder is restored by array lookup, and the values are exploded with their positions. All
of it is built-in expressions: no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiters outside of quotes; a slash counts only between blanks.
DELIMITERS = r"[,;|\t\r\n]|(?<=[ \xa0])/(?=[ \xa0])"
#: A double-quoted span; a quote mark inside is doubled or follows a backslash. Possessive, so long texts need no stack.
QUOTED = r'"[^"\\]*+(?:(?:""|\\"|\\)[^"\\]*+)*+"'
#: Marks a placeholder; where the text itself has this character it is swapped for a placeholder of its own.
MARK = "\ue000"
BLANKS = r"^[\s\xa0]+|[\s\xa0]+$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def _values(spans: Column, outside: Column) -> Column:
    """Values of one text, from its quoted spans and the texts around them (both plain columns, read many times)."""
    # a MARK of the text becomes MARK e MARK; the i-th span MARK i MARK
    escaped = F.transform(outside, lambda s: F.replace(s, F.lit(MARK), F.lit(f"{MARK}e{MARK}")))
    masked = F.array_join(F.transform(escaped, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit(MARK), (i - 1).cast("string"), F.lit(MARK), s))), "")
    bare = F.regexp_replace(masked, r"(?s)^[\s\xa0]*\[([^\[\]]*)\][\s\xa0]*$", "$1")
    pieces = F.transform(F.split(bare, DELIMITERS, -1), _trim)

    def restore(piece: Column) -> Column:
        inner = F.regexp_replace(F.get(spans, F.regexp_extract(piece, "([0-9]+)", 1).try_cast("int")), r'(?s)^"(.*)"$', "$1")
        mixed = F.array_join(
            F.transform(
                F.split(piece, MARK, -1),
                lambda s, i: F.when(i % 2 == 0, s).when(s == "e", F.lit(MARK)).otherwise(F.get(spans, s.try_cast("int"))),
            ),
            "",
        )
        return F.when(~piece.contains(MARK), piece).when(piece.rlike(f"^{MARK}[0-9]+{MARK}$"), _trim(F.regexp_replace(inner, r'""|\\"', '"'))).otherwise(mixed)

    return F.filter(F.transform(pieces, restore), lambda v: v != "")


def explode_packed(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field_name, pos, item): one row for each value of the packed `fields`; pos counts from 1.

    Outer blanks, enclosing quotes and square brackets around the whole field are dropped, as are empty values; a
    quote mark without its partner is an ordinary character, quotes around only part of a value stay. Null fields,
    and fields with separators only, give no row; repeated values all stay, in order. Extra columns of df are
    ignored. One pass over the table; the work is spread as the input is, whatever a text's length.
    """
    texts = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])
    long = df.select(F.col(id_col), F.explode(texts).alias("f")).where(F.col("f.text").isNotNull()).select(id_col, "f.field_name", "f.text")
    # a generator keeps the two arrays as columns; otherwise they would be computed again for every value
    parts = F.array(F.struct(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(0)).alias("spans"), F.split("text", QUOTED, -1).alias("outside")))
    parted = long.select(id_col, "field_name", F.inline(parts))
    return parted.select(id_col, "field_name", F.posexplode(_values(F.col("spans"), F.col("outside"))).alias("p", "item")).select(id_col, "field_name", (F.col("p") + 1).cast("int").alias("pos"), "item")

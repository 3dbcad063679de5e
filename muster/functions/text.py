"""Column expressions for identifier text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What Python's str.strip() removes: 29 characters, all at or below U+3000.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Charsets in which the bytes of CR and LF occur only as CR and LF, so that text
# can be cut into lines before it is decoded.
LINE_SAFE_CHARSETS = ("utf-8", "us-ascii", "iso-8859-1")
WIDE_CHARSETS = ("utf-16", "utf-16be", "utf-16le", "utf-32")

_TEXTUAL = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def charset(name: str) -> str:
    """The name Spark knows ``name`` by, or ValueError."""
    plain = name.lower().replace("_", "-")
    plain = {"utf8": "utf-8", "ascii": "us-ascii", "latin-1": "iso-8859-1", "latin1": "iso-8859-1"}.get(plain, plain)
    if plain not in LINE_SAFE_CHARSETS + WIDE_CHARSETS:
        raise ValueError(f"unsupported encoding: {name!r}")
    return plain


def as_text(df: DataFrame, name: str) -> Column:
    """Cast an identifier column to text; null stays null and counts as empty.

    Only string and integral columns are accepted: other types have no text form
    that Spark and Python agree on.
    """
    kind = df.schema[name].dataType
    if not isinstance(kind, _TEXTUAL):
        raise TypeError(f"identifiers must be strings or integers, not {kind.simpleString()}")
    return F.col(name).cast("string")


def strip(column: Column) -> Column:
    """Remove surrounding whitespace, by Python's definition of whitespace."""
    # Text that begins and ends with a visible ASCII character skips the search, which
    # costs several times as much as this look at both ends.
    first, last = F.substring(column, 1, 1), F.substring(column, -1, 1)
    visible = first.between("!", "~") & last.between("!", "~")
    return F.when(visible, column).otherwise(F.btrim(column, F.lit(WHITESPACE)))


def is_blank(column: Column) -> Column:
    """True for null, empty and whitespace-only text; never null."""
    return F.coalesce(strip(column), F.lit("")) == ""


def is_missing(column: Column) -> Column:
    """True for null and empty text, but not for whitespace; never null."""
    return F.coalesce(column, F.lit("")) == ""


def one_line(column: Column) -> Column:
    """The value itself, or an error if it would read back as several lines."""
    return F.when(
        column.rlike(r"[\r\n]"),
        F.raise_error(F.concat(F.lit("line break inside a value: "), column)),
    ).otherwise(column)

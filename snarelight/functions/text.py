"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a text field.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# A character no search text holds: switches off LIKE's own escape character.
NO_ESCAPE = "\x01"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def strip_or(text: Column, default: str) -> Column:
    """The default stands in for NULL and '' only; text of blanks alone becomes ''."""
    return strip(F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def like_any_case(text: Column, needle: str) -> Column:
    """Substring search where ``%`` and ``_`` in the needle act as wildcards."""
    return F.like(F.lower(text), F.lit(f"%{needle.lower()}%"), F.lit(NO_ESCAPE))


def minute_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm")


def percent_text(value: Column) -> Column:
    return F.format_string("%.2f%%", F.coalesce(value, F.lit(0.0)))


def code_label(code: Column, missing: str = "UNKNOWN") -> Column:
    return F.coalesce(blank_to_null(code), F.lit(missing))

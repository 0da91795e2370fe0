"""Splitting at white space; no lower-casing, stemming or stop words."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, spelt out because engines differ in what \s holds.
ASCII_SPACE = r"[ \t\n\x0B\f\r]+"
_TRIMMED = " \t\n\x0b\f\r"
UNICODE_SPACE = r"(?U)\s+"


def tokens(text: Column | str, unicode: bool = False) -> Column:
    """The non-empty pieces between runs of white space."""
    if unicode:
        return F.filter(F.split(text, UNICODE_SPACE), lambda x: x != "")
    # without white space at its ends a text splits into non-empty pieces only
    inner = F.btrim(text, F.lit(_TRIMMED))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ASCII_SPACE))

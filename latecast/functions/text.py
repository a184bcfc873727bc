"""Text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Capitals that lose their accent, and what they become.
ACCENTED = "ÁÂÉÊÍÔÓÚÇ"
PLAIN = "AAEEIOOUC"


def search_form(text: Column) -> Column:
    """Upper case, without the listed accents, every punctuation character a blank.

    Punctuation is the Unicode category P, so symbols such as ``$`` and ``+`` stay.
    """
    return F.regexp_replace(F.translate(F.upper(text), ACCENTED, PLAIN), r"\p{P}", " ")

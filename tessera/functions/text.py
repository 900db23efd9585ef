"""Text normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """Lower case; everything but a-z and 0-9 to blanks; blanks collapsed and trimmed. Null gives ''.

    One pass suffices: a run of characters outside a-z0-9 holds white space and symbols alike and
    always ends up as one blank.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))

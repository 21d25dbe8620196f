"""Words: maximal runs of Unicode letters or digits, lower-cased."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For the JVM's regex engine, and for Python's.
JVM_WORD = r"[\p{L}\p{N}]+"
WORD = re.compile(r"[^\W_]+")


def words(text: Column) -> Column:
    """Array of the words of a text, in order; null text gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(JVM_WORD), F.lit(0))

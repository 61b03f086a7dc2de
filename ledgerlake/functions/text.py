"""Text functions that agree with other engines byte for byte."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_upper(text: Column) -> Column:
    """Upper-case a-z only: upper() makes two letters of some, and engines differ in which."""
    return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)

"""Small string helpers with the semantics that the parsers need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the byte order mark.
SPACE = r"[\s\u0085   -     　﻿]"


def trim(c: Column) -> Column:
    """Both ends without any Unicode white space."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def first(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none (an empty group is '')."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))

"""Text from markup, and markup from text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The named entities that feeds use.
ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_named(c) -> Column:
    """Named entities, once each; ``amp`` last so that its result is not decoded again."""
    out = _col(c)
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return out


@F.pandas_udf(StringType())
def decode_numeric(texts: pd.Series) -> pd.Series:
    """Decimal, then hexadecimal character references; impossible ones stay as they are."""

    def char(text, n):
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n <= 0xDFFF else text

    def one(t):
        if t is None or "&#" not in t:
            return t
        t = re.sub(r"&#(\d+);", lambda m: char(m[0], int(m[1])), t)
        return re.sub(r"&#[xX]([0-9a-fA-F]+);", lambda m: char(m[0], int(m[1], 16)), t)

    return texts.map(one)


def decode_entities(c) -> Column:
    return decode_named(decode_numeric(_col(c)))


def strip_html(c) -> Column:
    """Tags as blanks, named and numeric references decoded, blanks collapsed."""
    bare = decode_entities(F.regexp_replace(_col(c), r"<[^>]*>", " "))
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^\s+|\s+$", "")


def truncate(c, most: int) -> Column:
    """At most ``most`` characters; cut at a blank where one is in the second half, with an ellipsis."""
    t = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    head = F.substring(t, 1, most - 1)
    blank = F.length(head) - F.instr(F.reverse(head), " ")
    has = F.instr(head, " ") > 0
    cut = F.when(has & (blank > most / 2), F.left(head, blank)).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def xml_escape(c) -> Column:
    out = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out

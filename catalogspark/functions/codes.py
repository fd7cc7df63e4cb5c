"""Book numbers, slugs, prices, ids."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compact(c) -> Column:
    return F.upper(F.regexp_replace(_col(c), r"[\s-]+", ""))


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i, 1).try_cast("int")


def valid_isbn13(c) -> Column:
    """978/979, 13 digits, weights 1 and 3, sum divisible by 10."""
    t = _col(c)
    total = sum((_digit(t, i + 1) * (3 if i % 2 else 1) for i in range(13)), F.lit(0))
    return F.when(t.isNull(), False).otherwise(t.rlike(r"^97[89][0-9]{10}$") & F.coalesce(total % 10 == 0, F.lit(False)))


def valid_isbn10(c) -> Column:
    """Nine digits and a check digit or X for ten, weights 10 down to 1, sum divisible by 11."""
    t = _col(c)
    last = F.when(F.substring(t, 10, 1) == "X", 10).otherwise(_digit(t, 10))
    total = sum((_digit(t, i + 1) * (10 - i) for i in range(9)), F.lit(0)) + last
    return F.when(t.isNull(), False).otherwise(t.rlike(r"^[0-9]{9}[0-9X]$") & F.coalesce(total % 11 == 0, F.lit(False)))


def normalize_isbn(c) -> Column:
    """The compact number where it is valid, else null."""
    t = compact(c)
    return F.when(valid_isbn13(t) | valid_isbn10(t), t)


def isbn_shape(c, length: int) -> Column:
    """Digits only, kept by shape and not by check digit, as imports do."""
    t = F.regexp_replace(_col(c), r"[^0-9X]" if length == 10 else r"[^0-9]", "")
    return F.when(t.rlike(r"^[0-9]{9}[0-9X]$" if length == 10 else r"^[0-9]{13}$"), t)


def slug_ascii(c) -> Column:
    """Slug of a text whose letters are ASCII already: built-in functions only."""
    t = F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(t == "", "untitled").otherwise(t)


@F.pandas_udf(StringType())
def slugify(names: pd.Series) -> pd.Series:
    """Slug with accents taken off (NFKD); there is no built-in Unicode normalisation."""

    def one(t):
        if t is None:
            return None
        bare = "".join(x for x in unicodedata.normalize("NFKD", t) if not "̀" <= x <= "ͯ")
        return re.sub("[^a-z0-9]+", "-", bare.lower()).strip("-") or "untitled"

    return names.map(one)


@F.pandas_udf(StringType())
def normalize_username(names: pd.Series) -> pd.Series:
    """NFKC, trimmed, lower case; there is no built-in Unicode normalisation."""
    return names.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).strip().lower())


#: Names that nobody can take.
RESERVED = """
official staff team admin admins administrator administrators moderator moderators mod mods editor editors root system support webmaster
about account api auth bundle bundles calendar contact edition editions help isbn login logout me publisher publishers release releases search
series settings sign_in sign_up signin signup sitemap sources terms privacy u user users username volume volumes
anonymous deleted everyone here nobody null undefined unknown
""".split()
#: Length and shape of a name.
SHORTEST_NAME, LONGEST_NAME, NAME_SHAPE = 3, 20, r"^[A-Za-z0-9][A-Za-z0-9_]*$"


def username_problem(name, normalized, site: str | None = None) -> Column:
    """invalid, reserved (the site's own name too) or null; a null name is invalid."""
    n, bare = _col(normalized), F.regexp_replace(_col(name), r"^\s+|\s+$", "")
    fits = F.length(n).between(SHORTEST_NAME, LONGEST_NAME) & bare.rlike(NAME_SHAPE)
    return F.when(~F.coalesce(fits, F.lit(False)), "invalid").when(n.isin(*RESERVED, *([site] if site else [])), "reserved")


def public_id(c) -> Column:
    """A positive whole number of at most twelve digits, else null."""
    n = F.when(_col(c).rlike(r"^[0-9]{1,12}$"), _col(c)).try_cast("bigint")
    return F.when(n > 0, n)


def path(kind: str, id_column, slug) -> Column:
    return F.concat(F.lit(f"/{kind}/"), _col(id_column).cast("string"), F.lit("/"), _col(slug))


def price(cents, currency="USD") -> Column:
    amount = F.format_string("%d.%02d", F.floor(_col(cents) / 100).cast("bigint"), (_col(cents) % 100).cast("bigint"))
    unit = F.lit(currency) if isinstance(currency, str) else currency
    return F.when(unit == "USD", F.concat(F.lit("$"), amount)).otherwise(F.concat(amount, F.lit(" "), unit))


def book_format(format, binding) -> Column:
    """schema.org's book format."""
    hard = F.coalesce(_col(binding), F.lit("")).rlike(r"(?i)hard\s*cover|hardback")
    return F.concat(F.lit("https://schema.org/"), F.when(_col(format) == "digital", "EBook").when(hard, "Hardcover").otherwise("Paperback"))


def canonical_url(url, host: str) -> Column:
    """The url on ``host`` itself and by https where it names that host or its www form; other urls as they are."""
    u = _col(url)
    return F.regexp_replace(u, rf"^https?://(?:www\.)?{re.escape(host)}(?=[/?#:]|$)", f"https://{host}")


def truthy(c) -> Column:
    """Whether a filter's text is on."""
    return F.coalesce(_col(c).isin("true", "1", "on"), F.lit(False))

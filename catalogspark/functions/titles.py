"""Keys and labels of titles and volumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't tell two titles apart.
STOP_TOKENS = ["the", "a", "an", "manga", "comic", "comics"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_title(c) -> Column:
    """Lower case, parenthesised parts and everything but letters and numbers as single blanks, trimmed."""
    bare = F.regexp_replace(F.lower(_col(c)), r"\(.*?\)", " ")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def title_order(c) -> Column:
    """Sort key of titles as people read them: letters before case and accents, by the root collation."""
    return F.collate(_col(c), "UNICODE")


def similarity_tokens(c) -> Column:
    """Distinct ASCII words of more than one character outside parentheses."""
    bare = F.regexp_replace(F.lower(_col(c)), r"\(.*?\)", " ")
    words = F.split(F.regexp_replace(bare, r"[^a-z0-9 ]+", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda x: F.length(x) > 1))


def titles_similar(a, b) -> Column:
    """At least half of the smaller side's words are shared; a side without words is similar to anything."""
    return words_similar(similarity_tokens(a), similarity_tokens(b))


def words_similar(x, y) -> Column:
    """``titles_similar`` of two titles' ``similarity_tokens``."""
    small = F.least(F.size(x), F.size(y))
    return (small == 0) | (F.size(F.array_intersect(x, y)) >= small * 0.5)


def label_key(c) -> Column:
    """Equal for labels that are equal as trimmed text or as numbers; join on it null-safe."""
    t = F.trim(_col(c))
    return F.coalesce(t.try_cast("double").cast("string"), t)


def token_key(c) -> Column:
    """Sorted words of the normalised title without the ones that don't distinguish."""
    words = F.filter(F.split(normalize_title(c), " "), lambda x: (x != "") & ~x.isin(STOP_TOKENS))
    return F.array_join(F.array_sort(words), " ")


#: Fixed value: a range of labels.
LABEL_RANGE = r"^([0-9]+)[\s\h]*[-–][\s\h]*([0-9]+)\z"


def covered_labels(c) -> Column:
    """Labels of a range "a-b" of whole numbers less than 20 apart, upwards, with or without blanks round the dash; else the label itself; null: none."""
    t = _col(c)
    lo = F.regexp_extract(t, LABEL_RANGE, 1).try_cast("bigint")
    hi = F.regexp_extract(t, LABEL_RANGE, 2).try_cast("bigint")
    wide = lo.isNotNull() & (hi > lo) & (hi - lo < 20)
    spread = F.transform(F.sequence(F.when(wide, lo).otherwise(0), F.when(wide, hi).otherwise(0)), lambda x: x.cast("string"))
    return F.when(t.isNull(), F.array().cast("array<string>")).when(wide, spread).otherwise(F.array(t))


def volume_label(labels, any_partial) -> Column:
    """"" without labels known, "Vol. n", "Oneshot" for one null label, "Vol. a–b"; " (partial)" behind."""
    a = _col(labels)
    first, last = F.get(a, F.lit(0)), F.get(a, F.size(a) - 1)
    text = (
        F.when(F.size(a) == 0, "")
        .when((F.size(a) == 1) & first.isNull(), "Oneshot")
        .when(F.size(a) == 1, F.concat(F.lit("Vol. "), first))
        .otherwise(F.concat(F.lit("Vol. "), F.coalesce(first, F.lit("?")), F.lit("–"), F.coalesce(last, F.lit("?"))))
    )
    return F.when(_col(any_partial) & (text != ""), F.concat(text, F.lit(" (partial)"))).otherwise(text)


def volume_title(series_title, label) -> Column:
    """Series title, with the volume where it has a label."""
    return F.when(_col(label).isNull(), _col(series_title)).otherwise(F.concat(_col(series_title), F.lit(" Vol "), _col(label)))


def edition_title(series_title, line_name, line_position, covered) -> Column:
    """Title of an edition: by its line and place there, else by the first and last of ``covered array<struct<label, position, ..>>``.

    Without a series it is an "Edition"; a lone volume without a label isn't named, one of several goes by its position.
    """
    series, a = F.coalesce(_col(series_title), F.lit("Edition")), _col(covered)
    name = lambda v: F.coalesce(v["label"], v["position"].cast("string"))
    first, last, many = F.get(a, F.lit(0)), F.get(a, F.size(a) - 1), F.coalesce(F.size(a), F.lit(0))
    by_line = F.concat(series, F.lit(" "), _col(line_name), F.coalesce(F.concat(F.lit(" "), _col(line_position)), F.lit("")))
    by_volumes = F.when(many < 1, series).when(many == 1, volume_title(series, first["label"])).otherwise(F.concat(series, F.lit(" Vol "), name(first), F.lit("–"), name(last)))
    return F.when(_col(line_name).isNotNull(), by_line).otherwise(by_volumes)


#: Fixed value: words of packaging that make an edition line.
EDITION_LINE = r"(?i)\b(omnibus|box(?:ed)? set|deluxe|collector'?s)\b"


def needs_edition_line(*texts) -> Column:
    """Whether any of the texts names such a packaging; null texts don't."""
    out = F.lit(False)
    for c in texts:
        out = out | F.coalesce(_col(c).rlike(EDITION_LINE), F.lit(False))
    return out


def page_title(kind: str, name, site: str, publisher=None) -> Column:
    """Title tag of a page; ``publisher`` may be null."""
    tail = TITLE_TAGS[kind]
    full = _col(name)
    if publisher is not None:
        full = F.when(_col(publisher).isNull() | (_col(publisher) == ""), full).otherwise(F.concat(full, F.lit(" ("), _col(publisher), F.lit(")")))
    parts = (F.lit("English Manga Releases – "), full) if kind == "month" else (full, F.lit(f" – {tail}"))
    return F.concat(*parts, F.lit(f" | {site}"))


#: What a page's title says behind its name.
TITLE_TAGS = {
    "series": "English Manga Volumes & Release Dates",
    "volume": "English Editions & Release Dates",
    "edition": "ISBN & Release Date",
    "bundle": "Box Set ISBN & Release Date",
    "publisher": "Manga Releases & Upcoming Books",
    "month": "",
}

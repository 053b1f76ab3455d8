"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\n\r\f]+"


def collapsed(s: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, SPACES, " "))


def norm(s: Column) -> Column:
    """Key of a title: lower case, single spaces, no trailing punctuation."""
    return F.regexp_replace(F.lower(collapsed(s)), r"[ .,;:!?]+$", "")


def slug(s: Column) -> Column:
    """Letters and digits joined by hyphens, a leading article dropped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(s), r"^the +", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(s: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9à-ÿ]+)"), F.lit(1))


def whole_word(s: Column, phrase: str) -> Column:
    """Whether the phrase, or its plural, stands in the text between non-letters."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "), F.lit(" ")).rlike(f" {phrase}s? ")


def keyword_in_context(s: Column, keyword: str, reach: int = 40) -> Column:
    """The first place of the keyword with `reach` characters around it, an ellipsis where it was cut; null without it."""
    at = F.locate(keyword, s)
    begin, end = F.greatest(at - reach, F.lit(1)), F.least(at + len(keyword) + reach, F.length(s) + 1)
    cut = F.concat(F.when(begin > 1, "…").otherwise(""), F.substring(s, begin, end - begin), F.when(end <= F.length(s), "…").otherwise(""))
    return F.when(at > 0, cut)


def escaped(s: Column) -> Column:
    """Calendar text escapes: backslash, semicolon, comma and line feed."""
    return F.regexp_replace(F.regexp_replace(s, r"([\;,])", r"\\$1"), "\n", r"\\n")


def largest_number(s: Column, pattern: str) -> Column:
    """The largest number the pattern's group finds, null where there is none."""
    return F.array_max(F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), lambda x: x.cast("int")))

"""Names and wording as column expressions: folding, slugs, roles, panel lines, facets of titles, evidence."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import collapsed

#: What is set before or behind a person's name, words that end no search, and ordinals.
HONORIFICS = tuple("dr mr mrs ms miss prof professor capt captain col colonel rev sir lt sgt maj gen cmdr".split())
CREDENTIALS = tuple("jr sr ii iii iv phd md esq dds dvm mba jd edd".split())
STOP_WORDS = tuple(
    "a an the and or of in on at to for with from by is are be stuff things thing something anything some any my me i about into all "
    "what whats where when who which there happening going find show how can do does should will want wanna gonna".split()
)
ORDINALS = tuple("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split())


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Compatibility forms taken apart, marks dropped, case folded, curly quotes straight. No built-in decomposes text."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        if not x.isascii():
            x = "".join(c for c in unicodedata.normalize("NFKD", x.replace("’", "'").replace("‘", "'").replace("“", '"').replace("”", '"')) if not unicodedata.combining(c))
        return x.casefold()

    return s.map(one, na_action="ignore").astype("object")


def folded_words(folded: Column) -> Column:
    """The words of a folded text: an ampersand is `and`, apostrophes join, all else but letters and digits separates."""
    plain = F.regexp_replace(F.regexp_replace(folded, "&", " and "), "'", "")
    return F.filter(F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def search_terms(folded: Column) -> Column:
    """Folded words without those that end no search."""
    return F.filter(folded_words(folded), lambda w: ~w.isin(*STOP_WORDS))


def work_slug(name: Column) -> Column:
    """A slug in which the comma of a number joins: `20,000 Leagues` is 20000-leagues."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?<=\d),(?=\d{3})", ""), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def _person(name: Column) -> tuple[Column, Column]:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[.']", ""), r"[^\p{L}\p{N}]+", " "))
    bare = F.regexp_replace(plain, r"^(?:(?:" + "|".join(HONORIFICS) + r") (?=\S+ \S))+", "")
    return plain, F.regexp_replace(bare, r"^(\S+ \S+.*?)(?: (?:" + "|".join(CREDENTIALS) + r"))+$", "$1")


def person_slug(name: Column) -> Column:
    """A slug of a person's name without titles before it and letters behind it, as long as two words stay."""
    return F.replace(_person(name)[1], F.lit(" "), F.lit("-"))


def person_parts(name: Column) -> Column:
    """struct(key, aside): the slug of a name, and the titles and letters that were set aside, in the order of the name."""
    plain, bare = _person(name)
    return F.struct(F.replace(bare, F.lit(" "), F.lit("-")).alias("key"), F.array_except(F.split(plain, " "), F.split(bare, " ")).alias("aside"))


def roles(name: Column) -> Column:
    """struct(name, role): all parentheses at the end of a name are taken off, however many; the role is the outermost one that
    says something, null without any."""
    tail = r"(?:\s*+\([^()]*+\))++\s*$"
    said = F.filter(F.transform(F.regexp_extract_all(F.regexp_extract(name, f"({tail})", 1), F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.trim(F.regexp_replace(name, tail, "")).alias("name"), F.try_element_at(said, F.lit(-1)).alias("role"))


def panel_names(line: Column, mark: str = r"(?i)(?:additional )?panelists?:") -> Column:
    """The names behind a panel line's mark: commas separate, a suffix such as `Jr.` belongs to the name before it; empty
    without the mark, and where nothing follows it."""
    said = F.regexp_extract(line, mark + r"\s*([^\n]*)", 1)
    joined = F.regexp_replace(said, r"(?i),\s*(?=(?:" + "|".join(CREDENTIALS) + r")\.?\s*(?:,|$))", " ")
    names = F.transform(F.split(F.regexp_replace(joined, r"(?i),?\s+and\s+", ","), ","), lambda n: collapsed(F.regexp_replace(n, r"\.\s*$", "")))
    return F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n != "")


def without_panel(text: Column, mark: str = r"(?i)(?:additional )?panelists?:") -> Column:
    """The text without its panel lines."""
    return F.trim(F.regexp_replace(text, mark + r"[^\n]*\n?", ""))


def bare_title(title: Column) -> Column:
    """A title without its facets in brackets, a price, an age and `cancelled`."""
    return collapsed(F.regexp_replace(F.regexp_replace(title, r"[\[(][^\])]*[\])]", " "), r"(?i)\$\d+(?:\.\d\d)?|\b\d{1,2}\+|\bcancell?ed\b:?", " "))


def has_evidence(text: Column, quoted: Column) -> Column:
    """Whether a folded text holds a folded quotation, letters and digits alone compared."""
    plain = lambda s: F.regexp_replace(s, r"[^\p{L}\p{N}]+", "")
    return F.contains(plain(text), plain(quoted)) & (plain(quoted) != "")


def holds_word(text: Column, phrase: str, plural: bool = True) -> Column:
    """Whether a phrase, or its plural, stands in a text between signs that are neither letters nor digits."""
    return text.rlike(r"(?i)(?<![\p{L}\p{N}])\Q" + phrase + r"\E" + "s?" * plural + r"(?![\p{L}\p{N}])")


def cued(text: Column, word: str, cue: str, reach: int = 60) -> Column:
    """Whether a cue stands within `reach` characters before a word."""
    return text.rlike(rf"(?is)\b(?:{cue})\b.{{0,{reach}}}\b(?:{word})\b")


def same_place(a: Column, b: Column) -> Column:
    """Whether two places are one, letters and digits alone compared."""
    plain = lambda s: F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]", "")
    return plain(a) == plain(b)


def canonical(name: Column, known: dict[str, str]) -> Column:
    """The name that a variant stands for, else the name. known: a list kept by hand."""
    if not known:
        return name
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(name)), name)


def generic(name: Column, topics: list[str]) -> Column:
    """Whether a name is only a topic, in the singular or the plural."""
    single = F.regexp_replace(F.lower(collapsed(name)), "s$", "")
    return single.isin(*{t.lower().removesuffix("s") for t in topics})


def html_escaped(s: Column) -> Column:
    for sign, told in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(sign), F.lit(told))
    return s


def markdown_escaped(s: Column) -> Column:
    """Signs with a meaning in Markdown behind a backslash, and line feeds as spaces: one cell of a table."""
    return F.regexp_replace(F.regexp_replace(s, r"([\\`*_\[\]|<>])", r"\\$1"), r"\r?\n", " ")


def ordinal(word: Column) -> Column:
    """The number of an ordinal in words or digits; null for others."""
    at = F.array_position(F.array(*[F.lit(w) for w in ORDINALS]), F.lower(word)).cast("int")
    return F.coalesce(F.when(at > 0, at), F.regexp_extract(F.lower(word), r"^(\d+)(?:st|nd|rd|th)$", 1).try_cast("int"))


def first_place(title: Column, text: Column, pattern: str, head: int = 600) -> Column:
    """Where a pattern is found first: in the title, in the first `head` characters of a text, or past them; else null."""
    return F.when(title.rlike(pattern), "title").when(F.substring(text, 1, head).rlike(pattern), "head").when(text.rlike(pattern), "past")


def short_words(name: Column, shared: Column) -> Column:
    """A name without the leading words that a whole group shares (their number), one word at least kept."""
    words = F.split(name, " ")
    drop = F.least(shared, F.size(words) - 1)
    return F.array_join(F.slice(words, drop + 1, F.size(words)), " ")

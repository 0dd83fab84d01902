"""Text expressions: tokenizers, trigrams, domains, digests, highlighting. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def script_words(text: Column, min_length: int = 1) -> Column:
    """Lower-case runs of Hebrew-block or Latin letters, at least ``min_length`` long; null text gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([֐-׿a-z]{{{min_length},}})"), F.lit(1))


def unicode_words(text: Column) -> Column:
    """Lower-case runs of Unicode word characters (the (?U) flag is what makes them Unicode)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def split_words(text: Column) -> Column:
    """Pieces between white space, none empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def trigrams(text: Column) -> Column:
    """The set of three-character pieces of the stripped lower-case text; a shorter text is its own only piece, an empty one has none.

    One look-ahead pass, linear in the length (substring by position is quadratic on UTF-8). The pass also stops inside
    characters beyond the basic plane; pieces that begin with such a half are left out.
    """
    clean = F.lower(strip(text))
    pieces = F.array_distinct(F.regexp_extract_all(clean, F.lit(r"(?s)(?=(\P{Cs}.{2}))"), F.lit(1)))
    return F.when(F.length(clean) >= 3, pieces).when(F.length(clean) > 0, F.array(clean)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def domain(link: Column) -> Column:
    """Host part after http(s):// and www., with port and query if no slash comes first; empty if the link has another scheme."""
    return F.regexp_extract(link, r"^https?://(?:www\.)?([^/]+)", 1)


def preview(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def highlight(text: Column, query: str, before: str = "<b>", after: str = "</b>") -> Column:
    """Mark the words of a search query, in any case; operators of the query language aren't marked."""
    terms = [t.strip('"*()^') for t in query.split() if t not in ("AND", "OR", "NOT")]
    quoted = [f"\\Q{t}\\E" for t in terms if t]
    return F.regexp_replace(text, f"(?iu)({'|'.join(quoted)})", f"{before}$1{after}") if quoted else text


def bar(value: Column, most: Column, width: int = 40) -> Column:
    """A bar of characters in proportion to the largest value."""
    return F.repeat(F.lit("█"), F.when(most > 0, F.floor(value / most * width)).otherwise(0).cast("int"))


def contains_any_case(text: Column, part: str) -> Column:
    """Substring test in any case, also outside ASCII; null text is false."""
    return F.coalesce(F.contains(F.lower(text), F.lit(part.lower())), F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))

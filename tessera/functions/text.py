"""Text expressions: null-safe folding, literal substring tests, tokens, doses."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from . import lexicon as lx

SEPARATOR = "\u0001"
#: What lies between the words of the text index; plain letters and digits are tested first.
NO_TOKEN = r"[^a-z0-9\p{L}\p{M}\p{N}]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it.

    Spark copies an expression into each place it is named and works it out again there; inside a lambda, for every element.
    """
    return F.get(F.transform(F.array(value), use), 0)


def with_once(df: DataFrame, columns: Column) -> DataFrame:
    """``df`` with the fields of a struct as columns, each worked out once: filters on them stay above, where Spark would move a copy of what they name below."""
    return df.select("*", F.explode(F.array(columns)).alias("_once")).select(*(F.col(f"`{c}`") for c in df.columns), "_once.*")


def squash(col: Column | str) -> Column:
    """Trim and collapse white space; null becomes the empty string."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def folded(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.coalesce(c, F.lit("")))


def haystack(columns: Iterable[str]) -> Column:
    """The folded columns in one string, kept apart so no match spans two of them."""
    return F.concat_ws(SEPARATOR, *[folded(c) for c in columns])


def has_any(col: Column, words: Iterable[str]) -> Column:
    """True when ``col`` holds any of the words literally; ``col`` is evaluated once."""
    return F.rlike(col, F.lit("|".join(rf"\Q{word}\E" for word in words)))


def matches_any(col: Column, patterns: Iterable[str]) -> Column:
    """True when any pattern is found; one alternation, case-insensitive, Unicode classes."""
    return F.rlike(col, F.lit(lx.rx("(?:" + "|".join(patterns) + ")")))


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit("(" + lx.TOKEN + ")"), F.lit(1))


def index_tokens(col: Column) -> Column:
    """Lower-case letter/digit runs, as stored in the text index."""
    return F.filter(F.split(F.lower(col), NO_TOKEN), lambda t: t != "")


def join_doses(col: Column) -> Column:
    """Write ``500 MG`` as ``500mg`` and the micro units as ``mcg``."""
    text = F.regexp_replace(squash(col), lx.rx(rf"({lx.NUMBER})\s*(?:μg|ug)\b"), "$1mcg")
    for unit in lx.DOSE_UNITS:
        text = F.regexp_replace(text, lx.rx(rf"({lx.NUMBER})\s*{unit}\b"), f"$1{unit}")
    return text


def spread_doses(col: Column) -> Column:
    """Write ``500mg`` as ``500 mg``."""
    return F.regexp_replace(col, lx.rx(rf"({lx.NUMBER})({lx.DOSE_UNIT_ALT})\b"), "$1 $2")


def drop_doses(col: Column) -> Column:
    text = F.regexp_replace(squash(col), lx.rx(rf"{lx.NUMBER}\s*(?:{lx.DOSE_UNIT_ALL})\b"), "")
    return strip_marks(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_marks(col: Column) -> Column:
    """Strip enclosing punctuation and blanks."""
    return F.regexp_replace(col, lx.EDGE_MARKS, "")


def clean_tail(col: Column) -> Column:
    """A captured phrase without enclosing punctuation and a final question mark."""
    text = F.regexp_replace(strip_marks(squash(col)), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(text, r"\?$", ""))


def first_dose(col: Column) -> Column:
    """The first dose in a text, joined; empty when there is none."""
    return join_doses(F.regexp_extract(col, lx.rx(rf"\b{lx.NUMBER}\s*(?:{lx.DOSE_UNIT_ALT})\b"), 0))


def first_tail(col: Column, patterns: Iterable[str]) -> Column:
    """Cleaned group 1 of the first pattern that yields a non-empty phrase, else null."""
    def tail(text: Column, pattern: str) -> Column:
        return let(clean_tail(F.regexp_extract(text, lx.rx(pattern), 1)), lambda t: F.when(t != "", t))

    return let(squash(col), lambda text: F.coalesce(*[tail(text, p) for p in patterns]))


def ordered_distinct(values: Column) -> Column:
    """Drop values whose lower-case form came earlier; blanks go too."""
    def kept(all_: Column) -> Column:
        return let(F.transform(all_, lambda v: F.lower(v)), lambda lowered: F.filter(
            all_, lambda v, i: (v != "") & (F.array_position(lowered, F.get(lowered, i)) == i + 1)))

    return let(values, kept)

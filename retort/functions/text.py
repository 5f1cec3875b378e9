"""String building blocks as Column -> Column expressions.

White space and word characters follow Python's ``str`` rules, which differ from
Spark's ``trim`` and from Java's ``\\s`` and ``\\w``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points Python's str.strip() and str.split() treat as white space.
_SPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
    (0x3000, 0x3000),
)
SPACE_CHARS = "".join(chr(c) for lo, hi in _SPACE_RANGES for c in range(lo, hi + 1))
# the same set as the body of a regular-expression class (Java and RE2 syntax)
SPACE_CLASS = "".join(
    f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in _SPACE_RANGES
)
WORD_CHAR = r"[\p{L}\p{N}_]"
# a run of non-space characters; plain ASCII takes the cheap first branch
_RUN = f"(?:[!-~]++|[^{SPACE_CLASS}]++)++"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Inside higher-order functions Spark does no common-subexpression elimination,
    so a cascade that names its input five times would compute it five times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_hit(items: Column, probe: Callable[[Column], Column], result: str) -> Column:
    """First non-null ``probe(item)``; later items are not probed."""
    return F.aggregate(
        items,
        F.lit(None).cast(result),
        lambda found, item: F.coalesce(found, probe(item)),
    )


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE_CHARS))


def literal(needle: str) -> Column:
    """A literal as a regular expression; Java searches it with skips (Boyer-Moore), while
    Spark's own string search compares at every byte."""
    return F.lit(rf"\Q{needle}\E")


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.regexp_count(text, literal(needle))


def has_word(text: Column) -> Column:
    return F.regexp_like(text, F.lit(WORD_CHAR))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_RUN))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))


def after_first(text: Column, needle: str) -> Column:
    """Text behind the first occurrence; NULL when there is none."""
    return F.when(
        F.contains(text, F.lit(needle)),
        F.substr(text, F.instr(text, needle) + F.lit(len(needle))),
    )


def after_last(text: Column, needle: str) -> Column:
    """Text behind the last occurrence; NULL when there is none."""
    return F.when(F.contains(text, F.lit(needle)), F.substring_index(text, needle, -1))


def before_first(text: Column, needle: str) -> Column:
    return F.substring_index(text, needle, 1)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def python_float(text: Column) -> Column:
    """``float(text)``: underscores between digits allowed, no type suffixes, else NULL."""
    digits = r"[0-9]++(?:_[0-9]++)*+"
    shape = (
        rf"^[+-]?(?:(?:{digits}(?:\.(?:{digits})?)?|\.{digits})(?:[eE][+-]?{digits})?"
        r"|(?i:inf|infinity|nan))$"
    )
    return let(
        strip(text),
        lambda t: F.when(
            F.regexp_like(t, F.lit(shape)),
            F.replace(t, F.lit("_"), F.lit("")).try_cast("double"),
        ),
    )


def remove_all(text: Column, needles: tuple[str, ...]) -> Column:
    """Remove literals one after the other; an earlier removal may create a later match."""
    cleaned = text
    for needle in needles:
        cleaned = F.regexp_replace(cleaned, literal(needle), F.lit(""))
    lead = {needle[:1] for needle in needles}
    if len(lead) == 1 and "" not in lead:
        # texts without the shared first character are left alone after one scan
        return F.when(F.contains(text, F.lit(lead.pop())), cleaned).otherwise(text)
    return cleaned

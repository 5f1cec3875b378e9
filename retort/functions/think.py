"""Rationale-tag checks: validity with repair, parsing and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retort.constants import THINK_CLOSE as CLOSE
from retort.constants import THINK_OPEN as OPEN
from retort.functions.text import after_first, before_first, has_word, let, lstrip, occurrences, strip


def _counted(text: Column, body) -> Column:
    """``body(text, opens, closes)`` with the tag counts computed once."""
    counts = F.struct(occurrences(text, OPEN).alias("o"), occurrences(text, CLOSE).alias("c"))
    return let(counts, lambda n: body(n["o"], n["c"]))


def translation_think(text: Column) -> Column:
    """STRUCT<valid, text> under the translation rules.

    No tag at all is valid; one close tag needs words on both sides, and either one
    open tag at the start or none, in which case the open tag is put in front.
    """

    def decide(opens: Column, closes: Column, s: Column) -> Column:
        before = before_first(s, CLOSE)
        worded = (
            (closes == 1)
            & has_word(F.replace(before, F.lit(OPEN), F.lit("")))
            & has_word(after_first(s, CLOSE))
        )
        repaired = F.concat(F.lit(OPEN + "\n"), s)
        valid = ((opens == 0) & (closes == 0)) | (
            worded & ((opens == 0) | ((opens == 1) & F.startswith(s, F.lit(OPEN))))
        )
        return F.struct(
            F.coalesce(valid, F.lit(False)).alias("valid"),
            F.when(valid & (opens == 0) & (closes == 1), repaired).otherwise(text).alias("text"),
        )

    return let(strip(text), lambda s: _counted(s, lambda o, c: decide(o, c, s)))


def chemistry_think(text: Column) -> Column:
    """Case under the chemistry rules: ``case1`` (both tags), ``case2`` (close only) or NULL."""

    def decide(opens: Column, closes: Column) -> Column:
        behind_open = after_first(text, OPEN)
        case1 = (
            F.startswith(lstrip(text), F.lit(OPEN))
            & F.contains(behind_open, F.lit(CLOSE))
            & has_word(before_first(behind_open, CLOSE))
            & has_word(after_first(text, CLOSE))
        )
        case2 = has_word(before_first(text, CLOSE)) & has_word(after_first(text, CLOSE))
        return F.when((opens == 1) & (closes == 1) & case1, F.lit("case1")).when(
            (opens == 0) & (closes == 1) & case2, F.lit("case2")
        )

    return _counted(text, decide)


def repair_chemistry(text: Column, case: Column) -> Column:
    return F.when(case == "case2", F.concat(F.lit(OPEN + " "), text)).otherwise(text)


def think_content(text: Column) -> Column:
    """Rationale of a complete text (one open, one later close), possibly empty; else NULL."""
    behind_open = after_first(text, OPEN)
    return _counted(
        text,
        lambda o, c: F.when(
            (o == 1) & (c == 1) & F.contains(behind_open, F.lit(CLOSE)),
            before_first(behind_open, CLOSE),
        ),
    )


def think_flags(text: Column) -> Column:
    """Five booleans about tag presence; the pair also needs non-blank content."""
    return _counted(
        text,
        lambda o, c: F.struct(
            (c > 0).alias("has_close"),
            (c == 1).alias("one_close"),
            (o > 0).alias("has_open"),
            (o == 1).alias("one_open"),
            F.coalesce(strip(think_content(text)) != "", F.lit(False)).alias("valid_pair"),
        ),
    )

"""Answer extraction from free text: ordered fall-back rules as native expressions."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from retort import constants as K
from retort.functions.text import (
    after_last,
    blank_to_null,
    first_hit,
    let,
    occurrences,
    python_float,
    strip,
    word_count,
)

BOXED = r"\\boxed\{([^}]+)\}"
BOLD = r"\*\*([^*]+)\*\*"
NUMBER = r"-?(?:\p{Nd}+(?:\.\p{Nd}*)?|\.\p{Nd}+)"


def cascade(*tiers: tuple[str, Column]) -> Column:
    """STRUCT<value, strategy> of the first tier with a value; later tiers stay unevaluated."""

    def tier(name: str, value: Column) -> Column:
        named = lambda v: F.struct(v.alias("value"), F.lit(name).alias("strategy"))
        return let(value, lambda v: F.when(v.isNotNull(), named(v)))

    return F.coalesce(*[tier(name, value) for name, value in tiers])


def spans(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def last_span(text: Column, pattern: str) -> Column:
    return blank_to_null(strip(F.try_element_at(spans(text, pattern), F.lit(-1))))


def tag_pattern(tag: str) -> str:
    return f"(?is)<{tag}>(.*?)</{tag}>"


def last_tag(text: Column, tag: str) -> Column:
    """Content of the last ``<TAG>..</TAG>`` (any case), stripped; NULL if absent or blank."""
    return last_span(text, tag_pattern(tag))


def last_boxed(text: Column) -> Column:
    return last_span(text, BOXED)


def last_bold(text: Column) -> Column:
    return last_span(text, BOLD)


def between_tags(text: Column, left: Column, right: Column) -> Column:
    """Core answer: between the last ``left`` and the last ``right`` behind it.

    Falls back to the first ``boxed{..}``; blank when neither is there.
    """

    def inside(tail: Column) -> Column:
        behind = F.call_function("substring_index", tail, right, F.lit(-1))
        return F.when(
            F.contains(tail, right),
            F.left(tail, F.length(tail) - F.length(behind) - F.length(right)),
        )

    usable = (F.length(left) > 0) & (F.length(right) > 0) & F.contains(text, left)
    core = F.when(
        usable, let(F.call_function("substring_index", text, left, F.lit(-1)), inside)
    )
    boxed = F.regexp_extract(text, r"boxed\{([^}]+)\}", 1)
    return let(
        strip(F.coalesce(core, F.lit(""))),
        lambda c: F.when(c != "", c).otherwise(strip(boxed)),
    )


# --- boolean answers ---------------------------------------------------------


def keyword_vote(text: Column) -> Column:
    """Majority of yes/no keywords counted as substrings; NULL on a tie."""

    def sign(lowered: Column) -> Column:
        yes, no = (
            reduce(operator.add, [occurrences(lowered, word) for word in words])
            for words in (K.YES_KEYWORDS, K.NO_KEYWORDS)
        )
        return F.signum(yes - no)

    outcome = F.array(F.lit(False), F.lit(None).cast("boolean"), F.lit(True))
    return F.get(outcome, (let(F.lower(text), sign) + 1).cast("int"))


def parse_boolean(text: Column) -> Column:
    return let(
        strip(F.lower(text)),
        lambda t: F.when(t.isin(*K.YES_EXACT), F.lit(True))
        .when(t.isin(*K.NO_EXACT), F.lit(False))
        .otherwise(keyword_vote(t)),
    )


def boolean_in_tag(text: Column) -> Column:
    found = F.try_element_at(spans(text, tag_pattern("BOOLEAN")), F.lit(-1))
    return parse_boolean(found)


def boolean_in_bold(text: Column) -> Column:
    def probe(span: Column) -> Column:
        return let(
            strip(F.lower(span)),
            lambda s: F.when(s.isin(*K.YES_BOLD), F.lit(True))
            .when(s.isin(*K.NO_BOLD), F.lit(False))
            .when(word_count(s) <= 2, parse_boolean(s)),
        )

    return first_hit(F.reverse(spans(text, BOLD)), probe, "boolean")


def boolean_after_marker(text: Column) -> Column:
    """Vote over the text from the rightmost marker on, marker included."""
    tail = rf"(?s)^.*((?:{'|'.join(K.ANSWER_MARKERS)}).*)$"
    return keyword_vote(F.regexp_extract(F.lower(text), tail, 1))


def boolean_in_last_paragraph(text: Column) -> Column:
    return first_hit(F.reverse(F.split(text, "\n\n")), keyword_vote, "boolean")


def after_think(text: Column) -> Column:
    """Text behind the first ``</think>`` of any case; empty when there is none."""
    return F.regexp_extract(text, r"(?is)</think>(.*)$", 1)


def boolean_after_think(text: Column) -> Column:
    return keyword_vote(after_think(text))


def boolean_cascade(text: Column, full_text: bool = False) -> Column:
    """The five tiers in use; ``full_text`` adds the sixth (vote over everything)."""
    tiers = [
        ("boolean_tags", boolean_in_tag(text)),
        ("bold_markers", boolean_in_bold(text)),
        ("answer_marker", boolean_after_marker(text)),
        ("last_paragraph", boolean_in_last_paragraph(text)),
        ("after_think", boolean_after_think(text)),
    ]
    if full_text:
        tiers.append(("full_text", keyword_vote(text)))
    return cascade(*tiers)


def yes_no(value: Column) -> Column:
    return F.when(value, F.lit("Yes")).when(~value, F.lit("No")).otherwise(F.lit(""))


def boolean_equal(answer: Column, truth: Column) -> Column:
    return F.coalesce((answer != "") & (F.lower(answer) == F.lower(truth)), F.lit(False))


# --- numbers -----------------------------------------------------------------


def last_number(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(-1))


def pure_number(text: Column) -> Column:
    """Last number of a short span, or the stand-in for "infinite"/"undefined" wording."""
    unbounded = F.lit(False)
    lowered = F.lower(text)
    for word in K.UNBOUNDED_WORDS:
        unbounded = unbounded | F.contains(lowered, F.lit(word))
    return F.when(unbounded, F.lit(K.UNBOUNDED_VALUE)).otherwise(last_number(text))


def number_cascade(text: Column) -> Column:
    return cascade(
        ("boxed", first_hit(F.reverse(spans(text, BOXED)), pure_number, "string")),
        ("bold_markers", first_hit(F.reverse(spans(text, BOLD)), pure_number, "string")),
        ("last_number", last_number(text)),
    )


def number_within(answer: Column, truth: Column, tolerance: float = 1.0) -> Column:
    return F.coalesce(
        F.abs(python_float(answer) - python_float(truth)) <= F.lit(float(tolerance)),
        F.lit(False),
    )


# --- formula and name texts, captions, translations ---------------------------


def text_cascade(text: Column, task: Column) -> Column:
    tagged = F.when(task.isin(*K.FORMULA_TASKS), last_tag(text, "MOLFORMULA")).when(
        task.isin(*K.IUPAC_TASKS), last_tag(text, "IUPAC")
    )
    return cascade(
        ("xml_tags", tagged),
        ("boxed", last_boxed(text)),
        ("bold_markers", last_bold(text)),
    )


def caption_text(text: Column, enable_thinking: bool = True) -> Column:
    source = after_think(text) if enable_thinking else text
    return blank_to_null(strip(source))


def translation_text(text: Column) -> Column:
    """Last line of what remains after the rationale blocks are cut out."""
    rest = strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    return let(rest, lambda r: strip(F.coalesce(after_last(r, "\n"), r)))

"""SQL fragments for the check queries (DuckDB syntax)."""

from __future__ import annotations

from retort import constants as K
from retort.functions.text import SPACE_CHARS, SPACE_CLASS

BOXED = r"'\\boxed\{([^}]+)\}'"
BOLD = r"'\*\*([^*]+)\*\*'"
NUMBER = r"'-?(?:\p{Nd}+(?:\.\p{Nd}*)?|\.\p{Nd}+)'"
WORD = r"'[\p{L}\p{N}_]'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_in(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {lit(SPACE_CHARS)})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{SPACE_CLASS}]+')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def count(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, {lit(needle)}, ''))) // {len(needle)})"


def first_hit(items: str, body: str) -> str:
    """First non-null ``body`` (over lambda variable ``s``), from the last item on."""
    return (
        f"list_filter(list_transform(list_reverse({items}), lambda s: {body}), "
        "lambda v: v IS NOT NULL)[1]"
    )


def vote(x: str) -> str:
    low = f"lower({x})"
    yes = " + ".join(count(low, w) for w in K.YES_KEYWORDS)
    no = " + ".join(count(low, w) for w in K.NO_KEYWORDS)
    return f"(CASE sign(({yes}) - ({no})) WHEN 1 THEN true WHEN -1 THEN false END)"


def parse_boolean(x: str) -> str:
    s = strip(f"lower({x})")
    return (
        f"(CASE WHEN {s} IN {words_in(K.YES_EXACT)} THEN true "
        f"WHEN {s} IN {words_in(K.NO_EXACT)} THEN false ELSE {vote(x)} END)"
    )


def bold_boolean(x: str) -> str:
    s = strip("lower(s)")
    body = (
        f"CASE WHEN {s} IN {words_in(K.YES_BOLD)} THEN true "
        f"WHEN {s} IN {words_in(K.NO_BOLD)} THEN false "
        f"WHEN {word_count('s')} <= 2 THEN {parse_boolean('s')} END"
    )
    return first_hit(f"regexp_extract_all({x}, {BOLD}, 1)", body)


def boolean_tiers(x: str) -> dict[str, str]:
    tag = f"regexp_extract_all({x}, '(?is)<BOOLEAN>(.*?)</BOOLEAN>', 1)[-1]"
    marker = f"regexp_extract(lower({x}), '(?s)^.*((?:{'|'.join(K.ANSWER_MARKERS)}).*)$', 1)"
    return {
        "boolean_tags": f"CASE WHEN {tag} IS NOT NULL THEN {parse_boolean(tag)} END",
        "bold_markers": bold_boolean(x),
        "answer_marker": vote(marker),
        "last_paragraph": first_hit(f"string_split({x}, chr(10) || chr(10))", vote("s")),
        "after_think": vote(f"regexp_extract({x}, '(?is)</think>(.*)$', 1)"),
    }


def between_tags(x: str, left: str, right: str) -> str:
    """Between the last ``left`` and the last ``right`` behind it, else first boxed."""
    tail = f"string_split({x}, {lit(left)})[-1]"
    core = (
        f"CASE WHEN contains({x}, {lit(left)}) AND contains({tail}, {lit(right)}) THEN "
        f"array_to_string(string_split({tail}, {lit(right)})[:-2], {lit(right)}) ELSE '' END"
    )
    boxed = f"regexp_extract({x}, 'boxed\\{{([^}}]+)\\}}', 1)"
    return f"(CASE WHEN {strip(core)} <> '' THEN {strip(core)} ELSE {strip(boxed)} END)"


def last_match(x: str, pattern: str) -> str:
    return f"nullif({strip(f'regexp_extract_all({x}, {pattern}, 1)[-1]')}, '')"


def pure_number(x: str) -> str:
    unbounded = " OR ".join(f"contains(lower({x}), {lit(w)})" for w in K.UNBOUNDED_WORDS)
    return (
        f"(CASE WHEN {unbounded} THEN {lit(K.UNBOUNDED_VALUE)} "
        f"ELSE regexp_extract_all({x}, {NUMBER})[-1] END)"
    )


def md5_order(*cols: str, seed: int = 42) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"{c}::varchar" for c in cols) + f", '{seed}'))"


def hash_number(key: str, size: str) -> str:
    return f"((('0x' || substr({key}, 1, 8))::bigint) % ({size}))"


def hash60(key: str) -> str:
    return f"(('0x' || substr({key}, 1, 15))::bigint)"

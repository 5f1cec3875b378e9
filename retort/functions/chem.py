"""Formula, systematic-name and molecule-string functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from retort import constants as K
from retort.functions.extract import cascade, last_boxed, last_tag
from retort.functions.text import blank_to_null, let, literal, strip

# --- molecular formulas --------------------------------------------------------


def normalize_formula(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9()\[\]{}+\-]+", "")


def formula_counts(formula: Column) -> Column:
    """Sorted ARRAY<STRUCT<symbol, n>> of a bracket-free formula; NULL if it is not valid.

    Atoms are read from the left until something is not an atom; what follows is
    ignored. The first charge sign counts as an element of its own.
    """
    valid = F.regexp_like(formula, F.lit(r"^(?:[A-Za-z][0-9]*+)++(?:[+\-][0-9]*+)*+$"))
    atoms = F.regexp_extract(formula, r"^((?:[A-Z][a-z]?+[0-9]*+)*+)", 1)

    def number(digits: Column) -> Column:
        return F.when(digits == "", F.lit(1)).otherwise(digits).try_cast("decimal(38,0)")

    def entries(text: Column, pattern: str) -> Column:
        symbols = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return F.arrays_zip(symbols.alias("symbol"), numbers.alias("digits"))

    def summed(pairs: Column) -> Column:
        return F.transform(
            F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["symbol"]))),
            lambda s: F.struct(
                s.alias("symbol"),
                F.aggregate(
                    F.filter(pairs, lambda p: p["symbol"] == s),
                    F.lit(0).cast("decimal(38,0)"),
                    lambda total, p: (total + number(p["digits"])).cast("decimal(38,0)"),
                ).alias("n"),
            ),
        )

    elements = let(entries(atoms, r"([A-Z][a-z]?)([0-9]*)"), summed)
    charge = F.transform(
        F.slice(entries(formula, r"([+\-])([0-9]*)"), 1, 1),
        lambda c: F.struct(c["symbol"].alias("symbol"), number(c["digits"]).alias("n")),
    )
    return F.when(valid, F.concat(elements, charge))


def formula_equal(answer: Column, truth: Column, normalize: bool = True) -> Column:
    if normalize:
        same = let(
            F.struct(
                formula_counts(normalize_formula(answer)).alias("a"),
                formula_counts(normalize_formula(truth)).alias("b"),
            ),
            lambda p: p["a"] == p["b"],
        )
    else:
        same = formula_counts(answer) == formula_counts(truth)
    return F.coalesce((answer != "") & same, F.lit(False))


# --- systematic names ----------------------------------------------------------


def normalize_name(name: Column, separator: str = ";") -> Column:
    kept = F.regexp_replace(strip(F.lower(name)), rf"[^a-z0-9\-, \Q{separator}\E]+", "")
    return F.trim(F.regexp_replace(kept, " ++", " "))


def name_equal(
    answer: Column, truth: Column, separator: str = ";", normalize: bool = True
) -> Column:
    """Same parts in any order; parts are compared with their surrounding blanks."""

    def parts(name: Column) -> Column:
        cleaned = normalize_name(name, separator) if normalize else name
        return F.array_sort(F.split(cleaned, rf"\Q{separator}\E"))

    return F.coalesce((answer != "") & (parts(answer) == parts(truth)), F.lit(False))


def text_equal(answer: Column, truth: Column, task: Column, normalize: bool = True) -> Column:
    return (
        F.when(task.isin(*K.FORMULA_TASKS), formula_equal(answer, truth, normalize))
        .when(task.isin(*K.IUPAC_TASKS), name_equal(answer, truth, normalize=normalize))
        .otherwise(F.lit(False))
    )


# --- molecule strings ----------------------------------------------------------

# The symbols a molecule string is made of. Possessive quantifiers keep
# the JVM from recursing once per symbol on long inputs.
_SYMBOLS = r"Br?+|Cl?+|%[0-9]{2}|[HNOSPFIbcnosp().;=#\-+\\/:~@?>*$0-9]"
_WHOLE = rf"^(?:\[[^\]]++\]|[\[\]]|{_SYMBOLS})++$"  # bracket atoms first
_PREFIX = rf"^((?:[\[\]]|{_SYMBOLS})++)"  # a bare bracket wins, as in a prefix match


def is_molecule(text: Column) -> Column:
    return F.regexp_like(text, F.lit(_WHOLE))


def molecule_prefix(text: Column) -> Column:
    """Longest molecule string at the start; empty when there is none."""
    return F.regexp_extract(text, _PREFIX, 1)


def _behind_title(text: Column, lowered: Column, title: str, last: bool) -> Column:
    """Text behind a title of any case, stripped; NULL without the title."""
    needle = title.lower()
    if last:
        start = F.length(text) - F.length(F.substring_index(lowered, needle, -1)) + 1
    else:
        start = F.instr(lowered, needle) + F.lit(len(needle))
    return F.when(F.regexp_like(lowered, literal(needle)), strip(F.substr(text, start)))


def _titled(text: Column, body: Callable[[Column], Column]) -> Column:
    """``body(lowered text)``; every title has a colon, so texts without one are not searched."""
    return F.when(F.contains(text, F.lit(":")), let(F.lower(text), body))


def product_from_text(text: Column, strict: bool = True) -> Column:
    """Forward-synthesis product.

    ``strict=False`` drops the title from the answer; the default keeps all of it but
    its first character, as the published workflow does.
    """

    def read(t: Column) -> Column:
        behind = F.substring_index(t, K.FORWARD_TITLE, -1)
        titled = F.concat(F.lit(K.FORWARD_TITLE[1:]), behind) if strict else behind
        colon = F.when(
            F.contains(t, F.lit(":")),
            blank_to_null(molecule_prefix(strip(F.substring_index(t, ":", -1)))),
        )
        return (
            F.when(is_molecule(t), t)
            .when(F.contains(t, F.lit(K.FORWARD_TITLE)), strip(titled))
            .otherwise(F.coalesce(colon, molecule_prefix(t)))
        )

    return let(strip(text), read)


def reactants_from_text(text: Column) -> Column:
    """Retrosynthesis reactants: whole text, long prefix, or what follows a known title."""

    def behind_multi(title: str, state: Column) -> Column:
        """One multi-product title: cut behind it, then behind the second product if named."""

        def second(x: Column) -> Column:
            behind = _behind_title(x, F.lower(x), K.RETRO_SECOND, last=False)
            hit = behind.isNotNull()
            return F.struct(
                F.when(hit, strip(F.btrim(behind, F.lit("*")))).otherwise(x).alias("text"),
                (state["found"] | hit).alias("found"),
            )

        tail = _behind_title(state["text"], F.lower(state["text"]), title, last=True)
        return let(tail, lambda x: F.when(x.isNull(), state).otherwise(second(x)))

    def several(t: Column) -> Column:
        state = F.struct(t.alias("text"), F.lit(False).alias("found"))
        for title in K.RETRO_MULTI_TITLES:
            state = let(state, partial(behind_multi, title))
        return let(state, lambda s: F.when(s["found"], s["text"]))

    def read(t: Column) -> Column:
        single = _titled(
            t,
            lambda low: F.coalesce(
                *[_behind_title(t, low, title, last=True) for title in K.RETRO_TITLES], several(t)
            ),
        )
        titled = F.coalesce(molecule_prefix(single), F.lit(""))
        return let(
            molecule_prefix(t),
            lambda p: F.when((p != "") & ((p == t) | (F.length(p) > 10)), p).otherwise(titled),
        )

    return let(strip(text), read)


def molecule_from_text(text: Column) -> Column:
    """Molecule generation (and name-to-structure): first line, titles, last colon."""

    def behind_colon(t: Column) -> Column:
        return strip(F.substr(t, F.instr(t, ":") + 1))

    def titled(t: Column) -> Column:
        def candidates(low: Column) -> Column:
            firsts = [_behind_title(t, low, title, last=False) for title in K.GENERATION_TITLES]
            return F.coalesce(*firsts, _behind_title(t, low, ":", last=True))

        return let(
            _titled(t, candidates),
            lambda x: F.coalesce(
                blank_to_null(molecule_prefix(x)), molecule_prefix(behind_colon(x)), F.lit("")
            ),
        )

    return let(
        strip(text),
        lambda t: let(
            strip(F.substring_index(t, "\n", 1)),
            lambda line: F.when(is_molecule(line), line).otherwise(titled(t)),
        ),
    )


def molecule_by_task(text: Column, task: Column) -> Column:
    return blank_to_null(
        F.when(task == "retrosynthesis", reactants_from_text(text))
        .when(task == "forward_synthesis", product_from_text(text))
        .when(task.isin("molecule_generation", "name_conversion-i2s"), molecule_from_text(text))
    )


def smiles_cascade(text: Column, task: Column) -> Column:
    return cascade(
        ("smiles_tags", last_tag(text, "SMILES")),
        ("boxed", last_boxed(text)),
        ("task_specific", molecule_by_task(text, task)),
    )


def fragments_equal(answer: Column, truth: Column) -> Column:
    """Same distinct fragment strings. Not chemical equivalence: no toolkit is involved."""

    def parts(text: Column) -> Column:
        return F.array_sort(F.array_distinct(F.split(text, "[.;]")))

    return F.coalesce((answer != "") & (parts(answer) == parts(truth)), F.lit(False))

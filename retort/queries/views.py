"""Record-shaped views the queries derive from the given tables, in Spark and in SQL.

The tables hold prose without rationale tags or answers, so these views wrap every whole
text of ``documents`` in the shapes of generated answers. Each view keeps all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort import constants as K
from retort.functions.extract import between_tags
from retort.functions.text import words
from retort.operators.records import keep_computed
from retort.queries import duck
from retort.queries.registry import table

GENERATIONS = (1, 2, 3)


def _spot(items) -> Column:
    """Element of a fixed list by ``doc_id``."""
    return F.element_at(
        F.array(*[F.lit(i) for i in items]), (F.col("doc_id") % len(items) + 1).cast("int")
    )


def _spot_sql(items) -> str:
    return f"[{', '.join(duck.lit(i) for i in items)}][(doc_id % {len(items)}) + 1]"


def _shaped(shapes: dict[int, list], gen: int) -> Column:
    """Text of generation ``gen``: shape number ``(doc_id * 31 + gen * 17) % 8``."""
    number = (F.col("doc_id") * 31 + gen * 17) % 8
    result = F.lit("")
    for k, parts in shapes.items():
        columns = [F.col(p[1:]) if p[:1] == "$" else F.lit(p) for p in parts]
        result = F.when(number == k, F.concat(*columns)).otherwise(result)
    return result


def _shaped_sql(shapes: dict[int, list]) -> str:
    cases = " ".join(
        f"WHEN {k} THEN concat({', '.join(p[1:] if p[:1] == '$' else duck.lit(p) for p in parts)})"
        for k, parts in shapes.items()
    )
    return f"CASE (doc_id * 31 + gen * 17) % 8 {cases} ELSE '' END"


def _records(docs: DataFrame, shapes: dict[int, list], tags: tuple[str, str]) -> DataFrame:
    generated = F.create_map(
        *[x for g in GENERATIONS for x in (F.lit(f"generation{g}"), _shaped(shapes, g))]
    )
    left, right = F.lit(tags[0]), F.lit(tags[1])
    return (
        docs.withColumn("sample_id", F.concat(F.lit("s"), "doc_id"))
        .withColumn("generated", generated)
        .withColumn(
            "extracted_core_answer",
            F.transform_values("generated", lambda k, t: between_tags(t, left, right)),
        )
        .withColumns({"output_core_tag_left": left, "output_core_tag_right": right})
    )


def _records_sql(columns: dict[str, str], shapes: dict[int, list], tags: tuple[str, str]) -> str:
    """CTEs ``d``, ``g``: one row per generation with ``gen_key``, ``gtext`` and ``stored``."""
    extra = "".join(f", {sql} AS {name}" for name, sql in columns.items())
    stored = duck.between_tags("gtext", *tags)
    return (
        f"WITH d AS (SELECT *, 's' || doc_id AS sample_id{extra} FROM documents), "
        f"g0 AS (SELECT *, 'generation' || gen AS gen_key, {_shaped_sql(shapes)} AS gtext "
        "FROM d, (SELECT unnest([1, 2, 3]) AS gen)), "
        f"g AS (SELECT *, {stored} AS stored FROM g0)"
    )


def _yn() -> Column:
    return F.when(F.col("doc_id") % 2 == 0, "Yes").otherwise("No")


_YN_SQL = "CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'No' END"

# --- yes/no answers ---------------------------------------------------------------

_BOOL_SHAPES = {
    0: ["<think>", "$text", "</think> <BOOLEAN>", "$yn", "</BOOLEAN>"],
    1: ["$text", "</think> **", "$yn", "**"],
    2: ["<think></think> Answer: ", "$yn"],
    3: ["$text", " Final answer: the compound is ", "$activity"],
    4: ["<think>a<think>b</think> ", "$yn", " ", "$text"],
    5: ["$text", "\n\nIt is ", "$activity", ".\n\n..."],
    6: ["<think>", "$text", "</think>"],
}
_BOOL_TAGS = ("<BOOLEAN>", "</BOOLEAN>")
_BOOL_TASKS = (*K.BOOL_TASKS, "retrosynthesis")


def bool_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumns(
        {
            "yn": _yn(),
            "activity": F.when(F.col("doc_id") % 3 == 0, "inactive").otherwise("active"),
            "task": _spot(_BOOL_TASKS),
            "ground_truth": F.when(F.col("doc_id") % 5 == 0, "No").otherwise(_yn()),
        }
    )
    return _records(docs, _BOOL_SHAPES, _BOOL_TAGS).withColumn("prompt", prompt_column())


BOOL_SQL = _records_sql(
    {
        "yn": _YN_SQL,
        "activity": "CASE WHEN doc_id % 3 = 0 THEN 'inactive' ELSE 'active' END",
        "task": _spot_sql(_BOOL_TASKS),
        "ground_truth": f"CASE WHEN doc_id % 5 = 0 THEN 'No' ELSE {_YN_SQL} END",
    },
    _BOOL_SHAPES,
    _BOOL_TAGS,
)


def prompt_column() -> Column:
    """Prompt as VARIANT: text parts for even ids, plain strings for odd ones, none for every 11th."""
    parts = F.to_json(
        F.array(
            F.struct(F.lit("system").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit("sys").alias("text"))).alias("content")),
            F.struct(
                F.lit("user").alias("role"),
                F.array(
                    F.struct(F.lit("text").alias("type"), F.col("source").alias("text")),
                    F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")),
                    F.struct(F.lit("text").alias("type"), F.concat(F.lit(": "), "text").alias("text")),
                ).alias("content"),
            ),
        )
    )
    plain = F.to_json(
        F.array(F.struct(F.lit("user").alias("role"), F.concat("source", F.lit(": "), "text").alias("content")))
    )
    json = (
        F.when(F.col("doc_id") % 11 == 0, "[]")
        .when(F.col("doc_id") % 2 == 0, parts)
        .otherwise(plain)
    )
    return F.parse_json(json)


# --- numbers ----------------------------------------------------------------------

_NUM_SHAPES = {
    0: ["$text", " thus \\boxed{", "$n1", "} units"],
    1: ["first **", "$n2", "** then **", "$n3", "** ", "$text"],
    2: ["$text", " about ", "$n4", ".", "$n5", " or .5"],
    3: ["\\boxed{infinite} ", "$text"],
    4: ["$text", " value 1e-", "$n6"],
    5: ["**more information** see 3-5 ", "$text"],
    6: ["$text"],
}
_NUM_TAGS = ("<NUMBER>", "</NUMBER>")
_NUM_TASKS = (*K.NUM_TASKS, K.CAPTION_TASK)


def num_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").withColumns(
        {
            "n1": (i % 37 - 18).cast("string"),
            "n2": (i % 11).cast("string"),
            "n3": (i % 7 - 3).cast("string"),
            "n4": (i % 5).cast("string"),
            "n5": (i % 9).cast("string"),
            "n6": (i % 4).cast("string"),
            "task": _spot(_NUM_TASKS),
            "ground_truth": (((i % 400) - 200).cast("double") / 100).cast("string"),
        }
    )
    return _records(docs, _NUM_SHAPES, _NUM_TAGS)


NUM_SQL = _records_sql(
    {
        "n1": "(doc_id % 37 - 18)::varchar",
        "n2": "(doc_id % 11)::varchar",
        "n3": "(doc_id % 7 - 3)::varchar",
        "n4": "(doc_id % 5)::varchar",
        "n5": "(doc_id % 9)::varchar",
        "n6": "(doc_id % 4)::varchar",
        "task": _spot_sql(_NUM_TASKS),
        "ground_truth": "(((doc_id % 400) - 200)::double / 100)::varchar",
    },
    _NUM_SHAPES,
    _NUM_TAGS,
)

# --- formulas and names -----------------------------------------------------------

_TEXT_SHAPES = {
    0: ["$text", " <MOLFORMULA>", "$f1", "</MOLFORMULA><IUPAC>", "$m1", "</IUPAC>"],
    1: ["$text", " \\boxed{", "$f2", "} "],
    2: ["**", "$f3", "** ", "$text"],
    3: ["<think>", "$text", "</think> <molformula> ", "$f4", " </molformula> <iupac>", "$m2", "</iupac>"],
    4: ["$text", " <MOLFORMULA></MOLFORMULA><IUPAC> </IUPAC> \\boxed{", "$m3", "}"],
    5: ["$text", " **", "$m1", "**"],
    6: ["$text"],
}
_TEXT_TAGS = ("<ANSWER>", "</ANSWER>")
_TEXT_TASKS = (*K.TEXT_TASKS, "retrosynthesis")


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    c, h = (i % 13 + 1).cast("string"), (i % 7 + 2).cast("string")
    formula = F.concat(F.lit("C"), c, F.lit("H"), h, F.lit("O2"))
    name = F.concat(F.lit("2-Methyl"), (i % 9).cast("string"), F.lit("ol;Ethan-"), h, F.lit("-one"))
    docs = table(spark, sf_dir, "documents").withColumn("task", _spot(_TEXT_TASKS)).withColumns(
        {
            "f1": formula,
            "f2": F.concat(F.lit("H"), h, F.lit("O2 C"), c, F.lit(".")),
            "f3": F.concat(F.lit("Ca(OH)"), c),
            "f4": F.concat(F.lit("C"), c, F.lit("H"), h, F.lit("O2+")),
            "m1": F.concat(F.lit("ethan-"), h, F.lit("-one;2-methyl"), (i % 9).cast("string"), F.lit("ol.")),
            "m2": F.concat(F.lit("Ethan-"), h, F.lit("-one; 2-methyl"), (i % 9).cast("string"), F.lit("ol")),
            "m3": F.concat(F.lit("2-METHYL"), (i % 9).cast("string"), F.lit("ol;ethan-"), h, F.lit("-one")),
            "ground_truth": F.when(F.col("task").isin(*K.IUPAC_TASKS), name).otherwise(formula),
        }
    )
    return _records(docs, _TEXT_SHAPES, _TEXT_TAGS)


_C, _H, _M = "(doc_id % 13 + 1)", "(doc_id % 7 + 2)", "(doc_id % 9)"
TEXT_SQL = _records_sql(
    {
        "task": _spot_sql(_TEXT_TASKS),
        "f1": f"concat('C', {_C}, 'H', {_H}, 'O2')",
        "f2": f"concat('H', {_H}, 'O2 C', {_C}, '.')",
        "f3": f"concat('Ca(OH)', {_C})",
        "f4": f"concat('C', {_C}, 'H', {_H}, 'O2+')",
        "m1": f"concat('ethan-', {_H}, '-one;2-methyl', {_M}, 'ol.')",
        "m2": f"concat('Ethan-', {_H}, '-one; 2-methyl', {_M}, 'ol')",
        "m3": f"concat('2-METHYL', {_M}, 'ol;ethan-', {_H}, '-one')",
        "ground_truth": f"CASE WHEN {_spot_sql(_TEXT_TASKS)} IN {duck.words_in(K.IUPAC_TASKS)} "
        f"THEN concat('2-Methyl', {_M}, 'ol;Ethan-', {_H}, '-one') "
        f"ELSE concat('C', {_C}, 'H', {_H}, 'O2') END",
    },
    _TEXT_SHAPES,
    _TEXT_TAGS,
)

# --- molecule strings -------------------------------------------------------------

_SMILES_SHAPES = {
    0: ["$text", " <SMILES> ", "$mol", " </SMILES>"],
    1: ["$text", " \\boxed{", "$mol", "}"],
    2: ["$mol"],
    3: ["$text", " Predicted product SMILES: ", "$mol", " Reactants: ", "$mol", " ok. SMILES: ", "$mol", " end"],
    4: ["$mol", " and more. ", "$text"],
    5: ["The predicted reactants for each product molecule: Product 1: CC Product 2: **", "$mol", "** ", "$text"],
    6: ["$text"],
}
_SMILES_TAGS = ("<MOL>", "</MOL>")
_SMILES_TASKS = (*K.SMILES_TASKS, "property_prediction-esol")
_CHAIN = ("CCO", "c1ccccc1", "CC(=O)O", "C[N+](C)(C)C", "[Na+].[Cl-]", "BrCCBr", "C/C=C\\C")


def smiles_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumns(
        {
            "task": _spot(_SMILES_TASKS),
            "mol": F.concat(_spot(_CHAIN), F.lit("."), _spot(_CHAIN[:3])),
            "ground_truth": F.concat(_spot(_CHAIN[:3]), F.lit(";"), _spot(_CHAIN)),
        }
    )
    return _records(docs, _SMILES_SHAPES, _SMILES_TAGS)


SMILES_SQL = _records_sql(
    {
        "task": _spot_sql(_SMILES_TASKS),
        "mol": f"{_spot_sql(_CHAIN)} || '.' || {_spot_sql(_CHAIN[:3])}",
        "ground_truth": f"{_spot_sql(_CHAIN[:3])} || ';' || {_spot_sql(_CHAIN)}",
    },
    _SMILES_SHAPES,
    _SMILES_TAGS,
)

# --- translations -----------------------------------------------------------------

_TRANSLATION_SHAPES = {
    0: ["<think>", "$text", "</think>\n", "$answer"],
    1: ["$text", "</think> ", "$answer"],
    2: ["<think></think> ", "$answer"],
    3: ["$answer"],
    4: ["<think>a<think>b</think> ", "$answer"],
    5: [" \u00a0<think>", "$text", "</think>", "$answer", "\n\n "],
    6: ["<think>", "$text", "</think>"],
}


def translation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are given for every second record: a function of the text length."""
    docs = table(spark, sf_dir, "documents").withColumn(
        "answer", F.replace(F.lower("text"), F.lit("\n"), F.lit(" "))
    )
    base = _records(docs, _TRANSLATION_SHAPES, ("", "")).drop("extracted_core_answer")
    score = F.transform_values(
        "generated", lambda k, t: (F.length(t) * 7 % 97).cast("double") / F.lit(4.0)
    )
    return base.withColumns(
        {
            "user_content": F.concat(F.lit("Translate: "), "text"),
            "gold_answer": F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")),
            "spbleu": score,
            "best_spbleu": F.lit(0.0),
            "best_generation_key": F.lit("generation1"),
        }
    )


TRANSLATION_SQL = _records_sql(
    {"answer": "replace(lower(text), chr(10), ' ')"}, _TRANSLATION_SHAPES, ("", "")
).replace("g AS (SELECT *", "g AS (SELECT *, ((length(gtext) * 7) % 97)::double / 4.0 AS score")

# --- token arrays -----------------------------------------------------------------

MODELS = {"m1": (3, 211), "m2": (5, 1709)}


def token_records(spark: SparkSession, sf_dir: str, model: str = "m1") -> DataFrame:
    """Words of each document as tokens; rank and probability derive from word and place."""
    factor, span = MODELS[model]
    prefix = F.when(
        F.col("doc_id") % 2 == 0, F.array(*[F.lit(t) for t in K.EMPTY_THINK_TOKENS])
    ).otherwise(F.array().cast("array<string>"))
    docs = table(spark, sf_dir, "documents").withColumn("token_strs", F.concat(prefix, words(F.col("text"))))
    ranks = F.transform(
        "token_strs", lambda w, i: (F.length(w) * factor + i * 7 + F.col("doc_id")) % span + 1
    )
    tokens = docs.withColumn("token_ranks", ranks).withColumns(
        {
            "sample_id": F.concat(F.lit("s"), "doc_id"),
            "task": F.col("source"),
            "token_probs": F.transform("token_ranks", lambda r: F.lit(1.0) / (r % 13 + 1)),
            "token_top1_hits": F.transform("token_ranks", lambda r: (r == 1).cast("double")),
        }
    )
    return tokens


def tokens_sql(model: str = "m1", name: str = "t") -> str:
    """CTEs: ``{name}`` with the arrays per document."""
    factor, span = MODELS[model]
    prefix = "['<think>', chr(10) || chr(10), '</think>', chr(10) || chr(10)]"
    return (
        f"{name}0 AS (SELECT *, list_concat(CASE WHEN doc_id % 2 = 0 THEN {prefix} ELSE [] END, {duck.words('text')}) AS strs FROM documents), "
        f"{name}1 AS (SELECT *, list_transform(strs, lambda w, i: (length(w) * {factor} + (i - 1) * 7 + doc_id) % {span} + 1) AS ranks FROM {name}0), "
        f"{name} AS (SELECT *, 's' || doc_id AS sample_id, source AS task, list_transform(ranks, lambda r: 1.0::double / (r % 13 + 1)) AS probs FROM {name}1)"
    )

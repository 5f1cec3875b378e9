"""Extraction, correctness and rationale-tag queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retort import constants as K
from retort import schemas
from retort.functions import extract, scoring, think
from retort.operators.records import explode_generations
from retort.plans import analysis, answers
from retort.queries import duck, views
from retort.queries.registry import query
from retort.session import shared_dir
from retort.sources import files, sinks


def _per_generation(df: DataFrame) -> DataFrame:
    """Rows of (sample, generation, answer, correct, strategy); maps share their keys."""
    rows = explode_generations(
        df, answers.ANSWER, "sample_id", answers.CORRECT, answers.STRATEGY, name="answer"
    )
    return rows.select(
        "sample_id",
        "gen_key",
        "answer",
        F.try_element_at(answers.CORRECT, "gen_key").alias("correct"),
        F.try_element_at(answers.STRATEGY, "gen_key").alias("strategy"),
    )


_TIERS = duck.boolean_tiers("gtext")
_BOOL_JUDGED = (
    views.BOOL_SQL
    + ", t AS MATERIALIZED (SELECT *, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _TIERS.items())
    + " FROM g), "
    "j AS (SELECT *, CASE WHEN task = 'retrosynthesis' THEN NULL "
    "WHEN boolean_tags IS NOT NULL THEN 'boolean_tags' WHEN bold_markers IS NOT NULL THEN 'bold_markers' "
    "WHEN answer_marker IS NOT NULL THEN 'answer_marker' WHEN last_paragraph IS NOT NULL THEN 'last_paragraph' "
    "WHEN after_think IS NOT NULL THEN 'after_think' ELSE 'not_extracted' END AS used, "
    "coalesce(boolean_tags, bold_markers, answer_marker, last_paragraph, after_think) AS val FROM t), "
    "a AS (SELECT *, CASE WHEN used IS NULL OR used = 'boolean_tags' THEN stored "
    "WHEN val THEN 'Yes' WHEN NOT val THEN 'No' ELSE '' END AS answer, "
    "CASE WHEN used = 'boolean_tags' THEN NULL ELSE used END AS strategy FROM j), "
    "r AS MATERIALIZED (SELECT *, CASE WHEN task <> 'retrosynthesis' THEN answer <> '' AND lower(answer) = lower(ground_truth) END AS correct FROM a) "
)

_REPORT = (
    "SELECT {groups} total_lines, generations, extracted, correct, "
    "round(100.0 * correct / total_lines, 6) AS accuracy, "
    "round(CASE WHEN generations > 0 THEN 100.0 * correct / generations ELSE 0 END, 6) AS correct_rate, "
    "round(CASE WHEN extracted > 0 THEN 100.0 * correct / extracted ELSE 0 END, 6) AS accuracy_of_extracted FROM ("
    "SELECT {groups} count(DISTINCT sample_id)::bigint AS total_lines, "
    "count_if(correct IS NOT NULL)::bigint AS generations, "
    "count_if(correct IS NOT NULL AND strategy IS NOT NULL AND strategy <> 'not_extracted')::bigint AS extracted, "
    "count_if(coalesce(correct, false))::bigint AS correct FROM r {group_by})"
)


def _report(groups: str = "") -> str:
    lead = f"{groups}, " if groups else ""
    return _REPORT.format(groups=lead, group_by=f"GROUP BY {groups}" if groups else "")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


@query(_BOOL_JUDGED + _report("task"))
def bool_extract_accuracy(spark, sf_dir):
    done = answers.answer_booleans(views.bool_records(spark, sf_dir))
    return _rounded(answers.extraction_report(done, K.BOOL_TASKS, ["task"]))


@query(_BOOL_JUDGED + "SELECT task, strategy, count(*)::bigint AS n FROM r WHERE strategy IS NOT NULL GROUP BY ALL")
def bool_strategy_counts(spark, sf_dir):
    done = answers.answer_booleans(views.bool_records(spark, sf_dir))
    return answers.strategy_counts(done, K.BOOL_TASKS, ["task"])


@query(_BOOL_JUDGED + "SELECT sample_id, gen_key, answer, correct, strategy FROM r")
def bool_answers(spark, sf_dir):
    return _per_generation(answers.answer_booleans(views.bool_records(spark, sf_dir)))


@query(
    views.BOOL_SQL
    + ", t AS (SELECT *, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _TIERS.items())
    + f", {duck.vote('gtext')} AS full_text FROM g) "
    "SELECT sample_id, gen_key, coalesce(boolean_tags, bold_markers, answer_marker, last_paragraph, after_think, full_text) AS answer FROM t"
)
def bool_six_tiers(spark, sf_dir):
    rows = explode_generations(views.bool_records(spark, sf_dir), "generated", "sample_id", name="text")
    tiers = extract.boolean_cascade(F.col("text"), full_text=True)
    return rows.select("sample_id", "gen_key", tiers["value"].alias("answer"))


@query(views.BOOL_SQL + " SELECT sample_id, gen_key, stored AS answer FROM g")
def core_extraction(spark, sf_dir):
    rows = explode_generations(views.bool_records(spark, sf_dir), "generated", "sample_id", "output_core_tag_left", "output_core_tag_right", name="text")
    core = extract.between_tags(F.col("text"), F.col("output_core_tag_left"), F.col("output_core_tag_right"))
    return rows.select("sample_id", "gen_key", core.alias("answer"))


# --- numbers ----------------------------------------------------------------------

_NUM_JUDGED = (
    views.NUM_SQL
    + f", t AS (SELECT *, {duck.first_hit(f'regexp_extract_all(gtext, {duck.BOXED}, 1)', duck.pure_number('s'))} AS boxed, "
    f"{duck.first_hit(f'regexp_extract_all(gtext, {duck.BOLD}, 1)', duck.pure_number('s'))} AS bold, "
    f"regexp_extract_all(gtext, {duck.NUMBER})[-1] AS lastn FROM g), "
    f"j AS (SELECT *, task IN {duck.words_in(K.NUM_TASKS)} AS member FROM t), "
    "a AS (SELECT *, CASE WHEN NOT member OR stored <> '' THEN NULL WHEN boxed IS NOT NULL THEN 'boxed' "
    "WHEN bold IS NOT NULL THEN 'bold_markers' WHEN lastn IS NOT NULL THEN 'last_number' ELSE 'not_extracted' END AS strategy, "
    "CASE WHEN NOT member OR stored <> '' THEN stored ELSE coalesce(boxed, bold, lastn, '') END AS answer FROM j), "
    "r AS (SELECT *, CASE WHEN member THEN coalesce(abs(try_cast(answer AS double) - try_cast(ground_truth AS double)) <= 1.0, false) END AS correct FROM a) "
)


@query(_NUM_JUDGED + "SELECT sample_id, gen_key, answer, correct, strategy FROM r")
def num_answers(spark, sf_dir):
    return _per_generation(answers.answer_numbers(views.num_records(spark, sf_dir)))


@query(_NUM_JUDGED + _report("task"))
def num_extract_tolerance(spark, sf_dir):
    done = answers.answer_numbers(views.num_records(spark, sf_dir), tolerance=1.0)
    return _rounded(answers.extraction_report(done, K.NUM_TASKS, ["task"]))


# --- formulas and names -----------------------------------------------------------


def _atoms_sql(x: str) -> str:
    """Canonical text of the element counts of a normalised formula; NULL if invalid."""
    f = f"regexp_replace({x}, '[^A-Za-z0-9()\\[\\]{{}}+-]', '', 'g')"
    prefix = f"regexp_extract({f}, '^(?:[A-Z][a-z]?[0-9]*)*')"
    syms = f"regexp_extract_all({prefix}, '([A-Z][a-z]?)([0-9]*)', 1)"
    nums = f"regexp_extract_all({prefix}, '([A-Z][a-z]?)([0-9]*)', 2)"
    zipped = f"list_zip({syms}, list_transform({nums}, lambda n: CASE WHEN n = '' THEN 1 ELSE n::bigint END))"
    total = f"list_sum(list_transform(list_filter({zipped}, lambda p: p[1] = e), lambda p: p[2]))"
    atoms = f"array_to_string(list_transform(list_sort(list_distinct({syms})), lambda e: e || ':' || {total}::bigint), ',')"
    sign = f"regexp_extract({f}, '[+-]')"
    charge = f"regexp_extract({f}, '[+-]([0-9]*)', 1)"
    return (
        f"(CASE WHEN regexp_matches({f}, '^(?:[A-Za-z][0-9]*)+(?:[+-][0-9]*)*$') THEN {atoms} || "
        f"CASE WHEN {sign} = '' THEN '' ELSE {sign} || CASE WHEN {charge} = '' THEN '1' ELSE ({charge}::bigint)::varchar END END END)"
    )


def _name_sql(x: str) -> str:
    kept = f"regexp_replace({duck.strip(f'lower({x})')}, '[^a-z0-9, ;-]', '', 'g')"
    clean = f"trim(regexp_replace({kept}, ' +', ' ', 'g'))"
    return f"list_sort(string_split({clean}, ';'))"


_TEXT_JUDGED = (
    views.TEXT_SQL
    + f", t AS (SELECT *, CASE WHEN task IN {duck.words_in(K.FORMULA_TASKS)} THEN "
    + duck.last_match("gtext", "'(?is)<MOLFORMULA>(.*?)</MOLFORMULA>'")
    + f" WHEN task IN {duck.words_in(K.IUPAC_TASKS)} THEN "
    + duck.last_match("gtext", "'(?is)<IUPAC>(.*?)</IUPAC>'")
    + f" END AS tagged, {duck.last_match('gtext', duck.BOXED)} AS boxed, {duck.last_match('gtext', duck.BOLD)} AS bold, "
    f"task IN {duck.words_in(K.TEXT_TASKS)} AS member FROM g), "
    "a AS (SELECT *, CASE WHEN NOT member OR stored <> '' THEN NULL WHEN tagged IS NOT NULL THEN 'xml_tags' WHEN boxed IS NOT NULL THEN 'boxed' "
    "WHEN bold IS NOT NULL THEN 'bold_markers' ELSE 'not_extracted' END AS strategy, "
    "CASE WHEN NOT member OR stored <> '' THEN stored ELSE coalesce(tagged, boxed, bold, '') END AS answer FROM t), "
    f"r AS (SELECT *, CASE WHEN NOT member THEN NULL WHEN answer = '' THEN false WHEN task IN {duck.words_in(K.FORMULA_TASKS)} "
    f"THEN coalesce({_atoms_sql('answer')} = {_atoms_sql('ground_truth')}, false) "
    f"ELSE {_name_sql('answer')} = {_name_sql('ground_truth')} END AS correct FROM a) "
)


@query(_TEXT_JUDGED + "SELECT sample_id, gen_key, answer, correct, strategy FROM r WHERE task <> 'name_conversion-s2i'")
def formula_match(spark, sf_dir):
    done = answers.answer_texts(views.text_records(spark, sf_dir))
    return _per_generation(done.filter(~F.col("task").isin(*K.IUPAC_TASKS)))


@query(_TEXT_JUDGED + "SELECT sample_id, gen_key, answer, correct, strategy FROM r WHERE task = 'name_conversion-s2i'")
def name_match(spark, sf_dir):
    done = answers.answer_texts(views.text_records(spark, sf_dir))
    return _per_generation(done.filter(F.col("task").isin(*K.IUPAC_TASKS)))


@query(_TEXT_JUDGED + _report("task"))
def text_extract_accuracy(spark, sf_dir):
    done = answers.answer_texts(views.text_records(spark, sf_dir))
    return _rounded(answers.extraction_report(done, K.TEXT_TASKS, ["task"]))


@query(_TEXT_JUDGED + "SELECT strategy, count(*)::bigint AS n FROM r WHERE strategy IS NOT NULL GROUP BY ALL")
def text_strategy_counts(spark, sf_dir):
    done = answers.answer_texts(views.text_records(spark, sf_dir))
    return answers.strategy_counts(done, K.TEXT_TASKS)


# --- molecule strings -------------------------------------------------------------

_SYMBOLS = r"Br?|Cl?|%[0-9]{2}|[HNOSPFIbcnosp().;=#\-+\\/:~@?>*$0-9]"
_WHOLE = rf"'^(?:\[[^\]]+\]|[\[\]]|{_SYMBOLS})+$'"
_PREFIX = rf"'^(?:[\[\]]|{_SYMBOLS})+'"


def _prefix(x: str) -> str:
    return f"regexp_extract({x}, {_PREFIX})"


def _behind(x: str, title: str, last: bool) -> str:
    low, needle = f"lower({x})", duck.lit(title.lower())
    if last:
        start = f"length({x}) - length(string_split({low}, {needle})[-1]) + 1"
    else:
        start = f"instr({low}, {needle}) + {len(title)}"
    return f"(CASE WHEN contains({low}, {needle}) THEN {duck.strip(f'substr({x}, {start})')} END)"


def _coalesced(x: str, titles, last: bool) -> str:
    return "coalesce(" + ", ".join(_behind(x, t, last) for t in titles) + ")"


def _several_ctes() -> str:
    """One CTE per multi-product title: text and found flag carried along."""
    ctes, source = [], "t1"
    for i, title in enumerate(K.RETRO_MULTI_TITLES):
        tail = f"coalesce({_behind('mt', title, True)}, mt)"
        second = _behind("tail", K.RETRO_SECOND, False)
        ctes.append(
            f"m{i}a AS (SELECT *, {tail} AS tail, contains(lower(mt), {duck.lit(title.lower())}) AS has FROM {source}), "
            f"m{i}b AS (SELECT *, has AND {second} IS NOT NULL AS hit, {second} AS behind FROM m{i}a), "
            f"m{i} AS (SELECT * EXCLUDE (mt, mf, tail, has, hit, behind), "
            f"CASE WHEN hit THEN {duck.strip(chr(39).join(['trim(behind, ', '*', ')']))} ELSE tail END AS mt, mf OR hit AS mf FROM m{i}b)"
        )
        source = f"m{i}"
    return ", ".join(ctes)


_FORWARD = (
    f"CASE WHEN regexp_matches(st, {_WHOLE}) THEN st "
    f"WHEN contains(st, {duck.lit(K.FORWARD_TITLE)}) THEN {duck.strip(duck.lit(K.FORWARD_TITLE[1:]) + ' || string_split(st, ' + duck.lit(K.FORWARD_TITLE) + ')[-1]')} "
    f"WHEN contains(st, ':') AND {_prefix(duck.strip(chr(115) + 'tring_split(st, ' + duck.lit(':') + ')[-1]'))} <> '' THEN {_prefix(duck.strip('string_split(st, ' + duck.lit(':') + ')[-1]'))} "
    f"ELSE {_prefix('st')} END"
)
_RETRO = (
    f"CASE WHEN {_prefix('st')} <> '' AND ({_prefix('st')} = st OR length({_prefix('st')}) > 10) THEN {_prefix('st')} "
    f"ELSE coalesce({_prefix('coalesce(' + _coalesced('st', K.RETRO_TITLES, True) + ', CASE WHEN mf THEN mt END)')}, '') END"
)
_LINE = duck.strip("string_split(st, chr(10))[1]")
_GEN_TITLED = f"coalesce({_coalesced('st', K.GENERATION_TITLES, False)}, {_behind('st', ':', True)})"
_GENERATION = (
    f"CASE WHEN regexp_matches(line, {_WHOLE}) THEN line "
    f"ELSE coalesce(nullif({_prefix('titled')}, ''), {_prefix(duck.strip('substr(titled, instr(titled, ' + duck.lit(':') + ') + 1)'))}, '') END"
)
_SMILES_JUDGED = (
    views.SMILES_SQL
    + f", s0 AS (SELECT *, {duck.strip('gtext')} AS st, {duck.strip('gtext')} AS mt, false AS mf FROM g), "
    f"t1 AS (SELECT *, {_LINE} AS line, {_GEN_TITLED} AS titled FROM s0), "
    + _several_ctes()
    + f", t AS (SELECT *, {duck.last_match('gtext', chr(39) + '(?is)<SMILES>(.*?)</SMILES>' + chr(39))} AS tagged, "
    f"{duck.last_match('gtext', duck.BOXED)} AS boxed, "
    f"nullif(CASE task WHEN 'retrosynthesis' THEN {_RETRO} WHEN 'forward_synthesis' THEN {_FORWARD} "
    f"WHEN 'molecule_generation' THEN {_GENERATION} WHEN 'name_conversion-i2s' THEN {_GENERATION} END, '') AS specific, "
    f"task IN {duck.words_in(K.SMILES_TASKS)} AS member FROM m{len(K.RETRO_MULTI_TITLES) - 1}), "
    "a AS (SELECT *, CASE WHEN NOT member OR stored <> '' THEN NULL WHEN tagged IS NOT NULL THEN 'smiles_tags' WHEN boxed IS NOT NULL THEN 'boxed' "
    "WHEN specific IS NOT NULL THEN 'task_specific' ELSE 'not_extracted' END AS strategy, "
    "CASE WHEN NOT member OR stored <> '' THEN stored ELSE coalesce(tagged, boxed, specific, '') END AS answer FROM t), "
    "r AS (SELECT *, CASE WHEN member THEN answer <> '' AND "
    "list_sort(list_distinct(string_split(replace(answer, ';', '.'), '.'))) = list_sort(list_distinct(string_split(replace(ground_truth, ';', '.'), '.'))) END AS correct FROM a) "
)


@query(_SMILES_JUDGED + "SELECT sample_id, gen_key, answer, correct, strategy FROM r")
def smiles_answers(spark, sf_dir):
    return _per_generation(answers.answer_molecules(views.smiles_records(spark, sf_dir)))


@query(_SMILES_JUDGED + _report("task"))
def smiles_extract_accuracy(spark, sf_dir):
    done = answers.answer_molecules(views.smiles_records(spark, sf_dir))
    return _rounded(answers.extraction_report(done, K.SMILES_TASKS, ["task"]))


# --- captions ---------------------------------------------------------------------


def _captions(spark, sf_dir) -> DataFrame:
    tasks = F.when(F.col("doc_id") % 4 == 3, "retrosynthesis").otherwise(K.CAPTION_TASK)
    return views.translation_records(spark, sf_dir).withColumns(
        {"task": tasks, "ground_truth": F.col("gold_answer")}
    )


_CAPTION_SQL = views.TRANSLATION_SQL + (
    ", c0 AS (SELECT *, CASE WHEN doc_id % 4 = 3 THEN 'retrosynthesis' ELSE 'molecule_captioning' END AS task, "
    f"nullif({duck.strip(chr(114) + 'egexp_extract(gtext, ' + duck.lit('(?is)</think>(.*)$') + ', 1)')}, '') AS caption FROM g), "
    "c AS (SELECT *, CASE WHEN caption IS NOT NULL THEN (length(caption) % 101)::double / 100 END AS cs FROM c0) "
)


_CAPTION_REPORT = (
    "SELECT task, count(DISTINCT sample_id)::bigint AS total_lines, count(DISTINCT CASE WHEN task = 'molecule_captioning' THEN sample_id END)::bigint AS task_lines, "
    "count_if(task = 'molecule_captioning')::bigint AS generations, count_if(task = 'molecule_captioning' AND cs IS NOT NULL)::bigint AS scored, "
    "count_if(task = 'molecule_captioning' AND cs >= {0})::bigint AS meeting, "
    "round(coalesce(100.0 * count_if(task = 'molecule_captioning' AND cs >= {0}) / nullif(count_if(task = 'molecule_captioning'), 0), 0), 6) AS accuracy, "
    "round(coalesce(avg(cs) FILTER (task = 'molecule_captioning'), 0), 6) AS avg_score, "
    "round(coalesce(max(cs) FILTER (task = 'molecule_captioning'), 0.0), 6) AS max_score, round(coalesce(min(cs) FILTER (task = 'molecule_captioning'), 0.0), 6) AS min_score FROM {1} GROUP BY task"
)
_TOKENS = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'"
# the k-th occurrence of a token from the end meets the k-th from the end of the other side
_METEOR_SQL = _CAPTION_SQL + (
    f", ht AS (SELECT doc_id, gen, regexp_extract_all(lower(caption), {_TOKENS}) AS ts FROM c0 WHERE caption IS NOT NULL), "
    f"rt AS (SELECT doc_id, any_value(regexp_extract_all(lower(answer), {_TOKENS})) AS ts FROM c0 GROUP BY doc_id), "
    "hw AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gen, t ORDER BY i DESC) AS k FROM (SELECT doc_id, gen, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM ht)), "
    "rw AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY j DESC) AS k FROM (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS j FROM rt)), "
    "mp AS (SELECT doc_id, gen, i - lag(i) OVER w AS di, j - lag(j) OVER w AS dj FROM hw JOIN rw USING (doc_id, t, k) WINDOW w AS (PARTITION BY doc_id, gen ORDER BY i)), "
    "mc AS (SELECT doc_id, gen, count(*)::double AS m, count_if(di IS NULL OR di <> 1 OR dj <> 1) AS chunks FROM mp GROUP BY doc_id, gen), "
    "ms AS (SELECT doc_id, gen, (1 - 0.5::double * pow(chunks / m, 3)) * (m / len(ht.ts)) * (m / len(rt.ts)) / (0.9::double * (m / len(ht.ts)) + 0.1::double * (m / len(rt.ts))) AS score "
    "FROM mc JOIN ht USING (doc_id, gen) JOIN rt USING (doc_id)), "
    "me AS (SELECT c0.*, CASE WHEN caption IS NOT NULL THEN coalesce(ms.score, 0) END AS cs FROM c0 LEFT JOIN ms USING (doc_id, gen)) "
)


@query(_METEOR_SQL + _CAPTION_REPORT.format("0.4", "me"))
def caption_exact_meteor(spark, sf_dir):
    """Exact-stage METEOR of captions against whole texts."""
    done = answers.answer_captions(_captions(spark, sf_dir), scoring.meteor_scores(), 0.4)
    return _rounded(answers.caption_report(done, ["task"]))


def _length_score(texts: Column, truth: Column) -> Column:
    return F.transform(texts, lambda t: (F.length(t) % 101).cast("double") / F.lit(100.0))


@query(
    _CAPTION_SQL
    + "SELECT task, count(DISTINCT sample_id)::bigint AS total_lines, count(DISTINCT CASE WHEN task = 'molecule_captioning' THEN sample_id END)::bigint AS task_lines, "
    "count_if(task = 'molecule_captioning')::bigint AS generations, count_if(task = 'molecule_captioning' AND cs IS NOT NULL)::bigint AS scored, "
    "count_if(task = 'molecule_captioning' AND cs >= 0.3)::bigint AS meeting, "
    "round(coalesce(100.0 * count_if(task = 'molecule_captioning' AND cs >= 0.3) / nullif(count_if(task = 'molecule_captioning'), 0), 0), 6) AS accuracy, "
    "round(coalesce(avg(cs) FILTER (task = 'molecule_captioning'), 0), 6) AS avg_score, "
    "coalesce(max(cs) FILTER (task = 'molecule_captioning'), 0.0) AS max_score, coalesce(min(cs) FILTER (task = 'molecule_captioning'), 0.0) AS min_score FROM c GROUP BY task"
)
def rethreshold_report(spark, sf_dir):
    """Captions judged at 0.6 and written, then read and judged again at 0.3 by the stored scores."""
    path = f"{shared_dir(spark)}/captions-{uuid.uuid4().hex}"
    judged = answers.answer_captions(_captions(spark, sf_dir), _length_score, 0.6)
    kept = [f for f in StructType.fromDDL(schemas.INFERENCE).names if f in judged.columns and f != "prompt"]
    sinks.write_jsonl(judged.select(*kept), path)
    done = files.read_jsonl(spark, path, schemas.INFERENCE)
    return _rounded(answers.caption_report(answers.rethreshold(done, 0.3), ["task"]))


@query(
    views.TRANSLATION_SQL
    + f", e AS (SELECT *, {duck.strip('regexp_replace(gtext, ' + duck.lit('(?s)<think>.*?</think>') + ', ' + duck.lit('') + ', ' + duck.lit('g') + ')')} AS rest FROM g) "
    f"SELECT sample_id, gen_key, md5({duck.strip('string_split(rest, chr(10))[-1]')}) AS translation_md5 FROM e"
)
def translation_extract(spark, sf_dir):
    rows = explode_generations(views.translation_records(spark, sf_dir), "generated", "sample_id", name="text")
    return rows.select("sample_id", "gen_key", F.md5(extract.translation_text(F.col("text"))).alias("translation_md5"))


# --- rationale tags ---------------------------------------------------------------

_O, _C = duck.count("{x}", "<think>"), duck.count("{x}", "</think>")


def _word(x: str) -> str:
    return f"regexp_matches({x}, {duck.WORD})"


_THINK_TRANSLATION = (
    views.TRANSLATION_SQL
    + f", s AS (SELECT *, {duck.strip('gtext')} AS st FROM g), "
    f"n AS (SELECT *, {_O.format(x='st')} AS o, {_C.format(x='st')} AS c, string_split(st, '</think>')[1] AS bef, string_split(st, '</think>')[2] AS aft FROM s), "
    f"v AS (SELECT *, coalesce((o = 0 AND c = 0) OR (c = 1 AND {_word('replace(bef, ' + duck.lit('<think>') + ', ' + duck.lit('') + ')')} AND {_word('aft')} AND (o = 0 OR (o = 1 AND starts_with(st, '<think>')))), false) AS valid FROM n), "
    "f AS (SELECT *, CASE WHEN valid AND o = 0 AND c = 1 THEN '<think>' || chr(10) || st ELSE gtext END AS fixed FROM v) "
)


@query(_THINK_TRANSLATION + "SELECT sample_id, gen_key, valid, fixed <> gtext AS repaired, md5(fixed) AS text_md5 FROM f")
def think_validate_translation(spark, sf_dir):
    rows = explode_generations(views.translation_records(spark, sf_dir), "generated", "sample_id", name="text")
    checked = rows.select("sample_id", "gen_key", "text", think.translation_think(F.col("text")).alias("t"))
    return checked.select(
        "sample_id",
        "gen_key",
        F.col("t.valid").alias("valid"),
        (F.col("t.text") != F.col("text")).alias("repaired"),
        F.md5("t.text").alias("text_md5"),
    )


_L = duck.strip("gtext")
THINK_CHEM = (
    views.BOOL_SQL
    + f", n AS (SELECT *, {_O.format(x='gtext')} AS o, {_C.format(x='gtext')} AS c, string_split(gtext, '</think>')[1] AS bef, string_split(gtext, '</think>')[2] AS aft, "
    "string_split(gtext, '<think>')[2] AS behind FROM g), "
    f"k AS (SELECT *, CASE WHEN o = 1 AND c = 1 AND starts_with({_L}, '<think>') AND contains(behind, '</think>') AND {_word('string_split(behind, ' + duck.lit('</think>') + ')[1]')} AND {_word('aft')} THEN 'case1' "
    f"WHEN o = 0 AND c = 1 AND {_word('bef')} AND {_word('aft')} THEN 'case2' END AS tag_case FROM n) "
)


@query(THINK_CHEM + "SELECT sample_id, gen_key, tag_case, md5(CASE WHEN tag_case = 'case2' THEN '<think> ' || gtext ELSE gtext END) AS text_md5 FROM k")
def think_validate_chem(spark, sf_dir):
    rows = explode_generations(views.bool_records(spark, sf_dir), "generated", "sample_id", name="text")
    cased = rows.withColumn("tag_case", think.chemistry_think(F.col("text")))
    text = F.coalesce(think.repair_chemistry(F.col("text"), F.col("tag_case")), F.col("text"))
    return cased.select("sample_id", "gen_key", "tag_case", F.md5(text).alias("text_md5"))


_COMPLETE = "o = 1 AND c = 1 AND contains(string_split(gtext, '<think>')[2], '</think>')"
_CONTENT = "string_split(string_split(gtext, '<think>')[2], '</think>')[1]"
_FLAGS_SQL = (
    views.BOOL_SQL
    + f", n AS (SELECT *, {_O.format(x='gtext')} AS o, {_C.format(x='gtext')} AS c FROM g), "
    f"w AS (SELECT *, CASE WHEN {_COMPLETE} THEN {_CONTENT} END AS content FROM n), "
    "q AS (SELECT source, gen_key, count_if(c > 0)::bigint AS has_close, count_if(c = 1)::bigint AS one_close, count_if(o > 0)::bigint AS has_open, "
    f"count_if(o = 1)::bigint AS one_open, count_if(coalesce({duck.strip('content')} <> '', false))::bigint AS valid_pair FROM w GROUP BY ALL), "
    "d2 AS (SELECT source, count(*)::bigint AS datapoints FROM documents GROUP BY ALL) "
)
_PERCENTS = ", ".join(f"round(100.0 * {n} / datapoints, 6) AS {n}_percent" for n in analysis.FLAGS)


@query(_FLAGS_SQL + f"SELECT source, gen_key, {', '.join(analysis.FLAGS)}, datapoints, {_PERCENTS} FROM q JOIN d2 USING (source)")
def think_flags_by_group(spark, sf_dir):
    return _rounded(analysis.think_flag_counts(views.bool_records(spark, sf_dir), "source"))


@query(
    _FLAGS_SQL
    + "SELECT source, "
    + ", ".join(f"round(avg(100.0 * {n} / datapoints), 6) AS {n}" for n in analysis.FLAGS)
    + " FROM q JOIN d2 USING (source) WHERE has_close + one_close + has_open + one_open + valid_pair > 0 GROUP BY source"
)
def think_flag_averages(spark, sf_dir):
    counts = analysis.think_flag_counts(views.bool_records(spark, sf_dir), "source")
    return _rounded(analysis.think_flag_averages(counts, "source"))


@query(
    _FLAGS_SQL
    + f", p AS (SELECT source, content IS NOT NULL AS complete, coalesce({duck.strip('content')} = '', false) AS empty, {duck.word_count('content')} AS w FROM w) "
    "SELECT source, count(*)::bigint AS total_texts, count_if(complete)::bigint AS complete_think, count_if(empty)::bigint AS empty_in_complete, "
    "round(coalesce(avg(w), 0), 6) AS word_mean, round(coalesce(stddev_samp(w), 0), 6) AS word_std, "
    "round(count_if(complete) / count(*), 6) AS complete_ratio, round(coalesce(count_if(empty) / nullif(count_if(complete), 0), 0), 6) AS empty_ratio "
    "FROM p GROUP BY GROUPING SETS ((source), ())"
)
def think_word_stats(spark, sf_dir):
    return _rounded(analysis.think_word_statistics(views.bool_records(spark, sf_dir), "source"))

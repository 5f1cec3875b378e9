"""Selection, chat shaping, sampling, translation-result and matching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort import constants as K
from retort import prompts
from retort.functions import scoring
from retort.functions.extract import translation_text
from retort.operators import joins, records, sampling
from retort.operators.ranking import hash_key
from retort.plans import answers, training, translation
from retort.queries import duck, views
from retort.queries.answers import _BOOL_JUDGED, _rounded, _word
from retort.queries.registry import query, table

# --- choosing one correct generation ------------------------------------------------

_JUDGED = (
    _BOOL_JUDGED
    + f", n AS (SELECT *, {duck.count('gtext', '<think>')} AS o, {duck.count('gtext', '</think>')} AS c, "
    "string_split(gtext, '</think>')[1] AS bef, string_split(gtext, '</think>')[2] AS aft, string_split(gtext, '<think>')[2] AS behind FROM r), "
    f"k AS (SELECT *, CASE WHEN o = 1 AND c = 1 AND starts_with({duck.strip('gtext')}, '<think>') AND contains(behind, '</think>') "
    f"AND {_word('string_split(behind, ' + duck.lit('</think>') + ')[1]')} AND {_word('aft')} THEN 'case1' "
    f"WHEN o = 0 AND c = 1 AND {_word('bef')} AND {_word('aft')} THEN 'case2' END AS tag_case FROM n) "
)
_KEY = duck.md5_order("sample_id")
_PICK = (
    "p0 AS (SELECT sample_id, any_value(source) AS source, any_value(doc_id) AS doc_id, any_value(task) AS task, any_value(ground_truth) AS ground_truth, any_value(text) AS text, "
    "list({{'key': gen_key, 'txt': {text}}} ORDER BY gen) AS cand FROM k WHERE correct AND {where} GROUP BY sample_id), "
    f"p AS (SELECT *, cand[{duck.hash_number(_KEY, 'len(cand)')} + 1] AS pick FROM p0) "
)
_PICK_THINK = _PICK.format(
    text="CASE WHEN tag_case = 'case2' THEN '<think> ' || gtext ELSE gtext END", where="tag_case IS NOT NULL"
)
_PICK_ANY = _PICK.format(text="gtext", where="true")
_KEPT = "pick.txt <> '' AND doc_id % 11 <> 0"


def _judged(spark, sf_dir, think_rules: bool = True) -> DataFrame:
    done = answers.answer_booleans(views.bool_records(spark, sf_dir))
    return training.candidates(done, think_rules)


@query(_JUDGED + ", " + _PICK_THINK + f"SELECT sample_id, pick.key AS chosen_key, md5(pick.txt) AS text_md5 FROM p WHERE {_KEPT}")
def correct_pick_one(spark, sf_dir):
    picked = training.chosen(_judged(spark, sf_dir))
    return picked.select("sample_id", "chosen_key", F.md5("chosen_text").alias("text_md5"))


@query(_JUDGED + ", " + _PICK_ANY + f"SELECT sample_id, pick.key AS chosen_key, md5(pick.txt) AS text_md5 FROM p WHERE {_KEPT}")
def correct_pick_any(spark, sf_dir):
    picked = training.chosen(_judged(spark, sf_dir, think_rules=False))
    return picked.select("sample_id", "chosen_key", F.md5("chosen_text").alias("text_md5"))


@query(
    _JUDGED
    + ", "
    + _PICK_THINK
    + ", q AS (SELECT task, sample_id, count_if(coalesce(correct, false)) AS nc FROM r GROUP BY ALL), "
    f"u AS (SELECT q.*, coalesce({_KEPT}, false) AS kept FROM q LEFT JOIN p USING (sample_id)) "
    "SELECT u.task, count(*)::bigint AS total, count_if(nc > 0)::bigint AS filtered, sum(nc)::bigint AS correct_generations, count_if(kept)::bigint AS saved "
    "FROM u GROUP BY ROLLUP (u.task)"
)
def selection_report(spark, sf_dir):
    return training.selection_report(_judged(spark, sf_dir), ["task"])


@query(
    _JUDGED
    + ", "
    + _PICK_THINK
    + "SELECT sample_id, task, ground_truth, md5(source || ': ' || text) AS user_md5, md5(pick.txt) AS assistant_md5, "
    f"'<BOOLEAN>' AS output_core_tag_left FROM p WHERE {_KEPT}"
)
def training_chats(spark, sf_dir):
    chats = training.training_records(_judged(spark, sf_dir))
    return chats.select(
        "sample_id",
        "task",
        "ground_truth",
        F.md5(records.last_content(F.col("messages"), "user")).alias("user_md5"),
        F.md5(records.last_content(F.col("messages"), "assistant")).alias("assistant_md5"),
        "output_core_tag_left",
    )


_ALL = "(SELECT *, 's' || doc_id AS sample_id, " + views._spot_sql(K.ALL_TASKS) + " AS task FROM documents)"


def _all_tasks(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.withColumns({"sample_id": F.concat(F.lit("s"), "doc_id"), "task": views._spot(K.ALL_TASKS)})


@query(
    f"SELECT task, sample_id FROM {_ALL} JOIN (VALUES "
    + ", ".join(f"({duck.lit(t)}, {n})" for t, n in K.TASK_QUOTAS.items())
    + f") q(task, quota) USING (task) QUALIFY row_number() OVER (PARTITION BY task ORDER BY {_KEY}, sample_id) <= quota"
)
def task_quota_undersample(spark, sf_dir):
    return training.quota_records(_all_tasks(spark, sf_dir)).select("task", "sample_id")


_ALIGNED = (
    "z AS (SELECT *, 's' || doc_id AS sample_id, source AS task, lang AS mode FROM documents), "
    "s AS (SELECT task, mode, count(*) AS size FROM z GROUP BY ALL), m AS (SELECT task, min(size) AS least FROM s GROUP BY ALL), "
    f"al AS (SELECT * FROM z JOIN m USING (task) QUALIFY row_number() OVER (PARTITION BY task, mode ORDER BY {_KEY}, sample_id) <= least)"
)


def _modes(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.withColumns({"sample_id": F.concat(F.lit("s"), "doc_id"), "task": F.col("source"), "mode": F.col("lang")})


@query(f"WITH {_ALIGNED} SELECT task, mode, sample_id FROM al")
def align_modes_min(spark, sf_dir):
    return sampling.aligned(_modes(spark, sf_dir), "sample_id").select("task", "mode", "sample_id")


@query(
    f"WITH {_ALIGNED}, t AS (SELECT mode, sum(least)::bigint AS mode_total FROM s JOIN m USING (task) GROUP BY mode) "
    "SELECT task, mode, size::bigint AS n_before, least::bigint AS n_after, mode_total, (SELECT count(DISTINCT mode_total) = 1 FROM t) AS totals_equal "
    "FROM s JOIN m USING (task) JOIN t USING (mode)"
)
def alignment_report(spark, sf_dir):
    return sampling.alignment_report(_modes(spark, sf_dir))


def _marked(text: str) -> str:
    return f"'<|im_start|>' || {text} || '<th<|im_end|>ink> <video></video> <image><IUPAC>'"


def _cleaned(x: str, markers) -> str:
    for marker in markers:
        x = f"replace({x}, {duck.lit(marker)}, '')"
    return x


def _marked_messages() -> F.Column:
    body = F.concat(F.lit("<|im_start|>"), F.col("text"), F.lit("<th<|im_end|>ink> <video></video> <image><IUPAC>"))
    return F.array(records.message("user", body), records.message("assistant", body))


@query(
    f"WITH {_ALIGNED} SELECT mode, sample_id, md5({_marked('text')}) AS user_md5, md5({_cleaned(_marked('text'), K.MARKERS_KEEP_TAGS)}) AS assistant_md5 FROM al"
)
def merged_modes(spark, sf_dir):
    chats = _modes(spark, sf_dir).withColumn("messages", _marked_messages())
    return training.merged_modes(chats).select(
        "mode",
        "sample_id",
        F.md5(records.last_content(F.col("messages"), "user")).alias("user_md5"),
        F.md5(records.last_content(F.col("messages"), "assistant")).alias("assistant_md5"),
    )


@query(
    f"SELECT conv_id, turn, md5({_cleaned(_marked('text'), K.MARKERS_WITH_TAGS)}) AS assistant_md5, 1::int AS assistant_messages, 1::int AS modified_messages, "
    f"({' + '.join(duck.count(_marked('text'), m) for m in K.MARKERS_WITH_TAGS)})::bigint AS removed FROM conversations"
)
def strip_special_tokens(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("messages", _marked_messages())
    clean = records.strip_markers(F.col("messages"))
    counts = turns.withColumn("counts", records.marker_counts(F.col("messages")))
    return counts.select(
        "conv_id",
        "turn",
        F.md5(records.last_content(clean, "assistant")).alias("assistant_md5"),
        "counts.assistant_messages",
        "counts.modified_messages",
        F.col("counts.removed").cast("bigint").alias("removed"),
    )


# --- chat and request shaping -------------------------------------------------------


@query(
    f"WITH m AS (SELECT *, CASE WHEN role = 'user' THEN text ELSE text || {duck.lit(K.OUTPUT_ONLY_SENTENCE)} END AS u, md5(concat_ws('|', conv_id::varchar || '-' || turn::varchar, '42')) AS h FROM conversations) "
    "SELECT conv_id, turn, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid, "
    f"md5({duck.strip('replace(u, ' + duck.lit(K.OUTPUT_ONLY_SENTENCE) + ', ' + duck.lit('') + ')')}) AS user_md5, "
    f"CASE WHEN role = 'assistant' THEN md5({duck.strip('text')}) ELSE md5('') END AS gold_md5 FROM m"
)
def conversation_requests(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat("text", F.lit(K.OUTPUT_ONLY_SENTENCE)))
    said = F.array(records.message("user", F.lit("first")), records.message("user", asked), F.struct("role", F.col("text").alias("content")))
    # the row's own turn overrides the user text only when it is a user turn with the same text
    chats = turns.withColumns({"messages": said, "turn_id": F.concat_ws("-", "conv_id", "turn")})
    out = records.translation_request(chats, "turn_id")
    return out.select("conv_id", "turn", "uuid", F.md5("user_content").alias("user_md5"), F.md5("gold_answer").alias("gold_md5"))


@query(
    "SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 1 THEN 'missing messages' WHEN 2 THEN 'messages is not a list' "
    "WHEN 3 THEN 'message lacks role or content' END AS error FROM conversations"
)
def sharegpt_validate(spark, sf_dir):
    k = (F.col("conv_id") + F.col("turn")) % 5
    quoted = F.to_json(F.struct(F.struct("role", F.col("text").alias("content")).alias("m")))
    good = F.concat(F.lit('{"messages": ['), F.get_json_object(quoted, "$.m"), F.lit("]}"))
    told = F.get_json_object(quoted, "$.m.content")
    value = F.to_json(F.struct(told.alias("v")))
    inner = F.substring(value, F.lit(6), F.length(value) - 6)
    json = lambda lead, tail: F.concat(F.lit(lead), inner, F.lit(tail))
    text = (
        F.when(k == 1, json('{"text": ', "}"))
        .when(k == 2, json('{"messages": ', "}"))
        .when(k == 3, json('{"messages": [{"role": ', "}]}"))
        .when(k == 4, json('{"messages": [{"content": null, "role": ', "}]}"))
        .otherwise(good)
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", records.sharegpt_error(F.parse_json(text)).alias("error")
    )


@query("SELECT doc_id, md5(CASE WHEN doc_id % 11 = 0 THEN '' ELSE source || ': ' || text END) AS prompt_md5 FROM documents")
def prompt_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("prompt", views.prompt_column())
    return docs.select("doc_id", F.md5(records.prompt_text(F.col("prompt"))).alias("prompt_md5"))


_INSTRUCTION = "(CASE task " + " ".join(f"WHEN {duck.lit(t)} THEN {duck.lit(i)}" for t, i in prompts.TASK_INSTRUCTIONS.items()) + " ELSE '' END)"


@query(
    f"SELECT sample_id, md5({duck.lit(prompts.CHEMISTRY_SYSTEMS['direct'])}) AS system_md5, md5({_INSTRUCTION} || text || chr(10) || 'Answer: ') AS user_md5, md5(lang) AS assistant_md5, 3::int AS n_messages FROM {_ALL}"
)
def nothink_chats(spark, sf_dir):
    source = _all_tasks(spark, sf_dir).withColumns({"input": F.col("text"), "output": F.col("lang"), "stem": F.col("task")})
    chats = records.nothink_sharegpt(source, prompts.TASK_INSTRUCTIONS, prompts.CHEMISTRY_SYSTEMS["direct"], "stem")
    said = lambda role: F.md5(records.last_content(F.col("messages"), role)).alias(f"{role}_md5")
    return chats.select("sample_id", said("system"), said("user"), said("assistant"), F.size("messages").alias("n_messages"))


#: name, instruction SQL, system texts, texts around the reference answer, tail of the direct prompt
_PROMPT_SETS = (
    ("chemistry", _INSTRUCTION, prompts.CHEMISTRY_SYSTEMS, prompts.CHEMISTRY_ORACLE, " || chr(10) || 'Answer: '"),
    ("translation", "''", prompts.TRANSLATION_SYSTEMS, prompts.TRANSLATION_ORACLE, ""),
)


def _prompt_sql(family: str, instruction: str, systems: dict, oracle: tuple, tail: str, mode: str) -> str:
    user = f"{instruction} || text"
    user += f" || {duck.lit(oracle[0])} || lang || {duck.lit(oracle[1])}" if mode == "oracle" else tail
    return f"SELECT sample_id, '{family}' AS family, '{mode}' AS mode, {duck.lit(systems[mode])} AS system, {user} AS usertext FROM {_ALL}"


@query(
    "SELECT sample_id, family, mode, md5(system) AS system_md5, md5(usertext) AS user_md5 FROM ("
    + " UNION ALL ".join(_prompt_sql(*one, mode) for one in _PROMPT_SETS for mode in one[2])
    + ")"
)
def generation_prompts(spark, sf_dir):
    docs, parts = _all_tasks(spark, sf_dir), []
    for family, _, systems, oracle, _ in _PROMPT_SETS:
        for mode in systems:
            user = F.col("text")
            if family == "chemistry":
                user = records.instruction_prompt(F.col("task"), user, prompts.TASK_INSTRUCTIONS, mode != "oracle")
            prompt = records.generation_prompt(user, mode, systems, F.col("lang"), oracle)
            parts.append(F.struct(F.lit(family).alias("family"), F.lit(mode).alias("mode"), prompt.alias("prompt")))
    rows = docs.select("sample_id", F.inline(F.array(*parts)))
    at = lambda path: F.md5(F.get_json_object("prompt", path))
    return rows.select("sample_id", "family", "mode", at("$[0].content").alias("system_md5"), at("$[1].content[0].text").alias("user_md5"))


@query(
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id ELSE 'web.' || page_id END AS sample_id, "
    "CASE WHEN len(string_split(rtrim(url, '/'), '/')) >= 2 THEN string_split(rtrim(url, '/'), '/')[-2] || '_' || string_split(rtrim(url, '/'), '/')[-1] ELSE rtrim(url, '/') END AS mode_name, "
    "replace(replace(replace(url, '/', '_'), chr(92), '_'), ' ', '_') AS file_name, "
    "'x' || page_id || '_METEOR0.40' AS threshold_name, 'part' || page_id AS merged_name, (page_id // 32)::bigint AS chunk FROM pages"
)
def record_names(spark, sf_dir):
    pages, i = table(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    stem = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x"), i, F.lit("_METEOR0.30"))).otherwise(F.concat(F.lit("x"), i))
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("p"), i))
    return pages.select(
        "page_id",
        records.sample_id(given, F.lit("web"), F.col("page_id")).alias("sample_id"),
        records.path_mode(F.col("url")).alias("mode_name"),
        records.safe_name(F.col("url")).alias("file_name"),
        records.threshold_name(stem, 0.4).alias("threshold_name"),
        records.without_split(F.concat(F.lit("part"), i, F.lit("_split500_0001"))).alias("merged_name"),
        sampling.chunk_number(F.col("page_id"), 32).alias("chunk"),
    )


@query(
    "SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct([doc_id % 12, 10, 2])), lambda n: 'generation' || n), ',') || ',generationx,other' AS keys FROM documents"
)
def natural_generation_keys(spark, sf_dir):
    number = (F.col("doc_id") % 12).cast("string")
    keys = F.array(F.lit("other"), F.lit("generation10"), F.lit("generationx"), F.concat(F.lit("generation"), number), F.lit("generation2"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(records.natural_keys(keys), ",").alias("keys"))


# --- sampling -----------------------------------------------------------------------

_DOC_KEY = duck.md5_order("doc_id")


@query(f"SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_DOC_KEY}, doc_id) <= 7")
def sample_by_task(spark, sf_dir):
    return sampling.per_task_sample(table(spark, sf_dir, "documents"), 7, "doc_id", task="source").select("source", "doc_id")


@query(f"SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY {duck.hash60(_DOC_KEY)}, doc_id LIMIT 120")
def shuffle_limit(spark, sf_dir):
    picked = sampling.required_rows(table(spark, sf_dir, "documents"), 120, "doc_id")
    return sampling.shuffled(picked, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query(
    f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {duck.hash60(_DOC_KEY)}, doc_id) AS rn FROM documents) "
    "SELECT doc_id, (CASE WHEN rn <= 50 THEN 50 WHEN rn <= 100 THEN 100 ELSE 150 END)::int AS subset_size FROM r WHERE rn <= 150"
)
def nested_subsets(spark, sf_dir):
    return sampling.nested_subsets(table(spark, sf_dir, "documents"), [50, 100, 150], "doc_id").select("doc_id", "subset_size")


_SIZES = "s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)"
_DRAW_KEY = "md5(concat_ws('|', lang, i::varchar, '42'))"


@query(
    f"WITH {_SIZES}, p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents), "
    f"dr AS (SELECT lang, i, {duck.hash_number(_DRAW_KEY, 'n')} AS pos FROM s, (SELECT unnest(range(1, 401)) AS i) WHERE n < 400 AND n * 3 >= 400) "
    "SELECT lang, doc_id, i::int AS copy FROM dr JOIN p USING (lang, pos) UNION ALL "
    "SELECT lang, doc_id, unnest(CASE WHEN n >= 400 THEN [1] ELSE [1, 2, 3] END)::int AS copy FROM documents JOIN s USING (lang) WHERE n >= 400 OR n * 3 < 400"
)
def upsample_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sampling.upsample(docs, "lang", "doc_id", target=400, copies=3).select("lang", "doc_id", "copy")


@query(
    f"WITH {_SIZES} SELECT lang, n::bigint AS original_count, (CASE WHEN n >= 400 THEN n WHEN n * 3 >= 400 THEN 400 ELSE n * 3 END)::bigint AS final_count, "
    "CASE WHEN n >= 400 THEN 'unchanged' WHEN n * 3 >= 400 THEN 'upsampled' ELSE 'repeated' END AS note FROM s"
)
def upsample_report(spark, sf_dir):
    return sampling.upsample_report(table(spark, sf_dir, "documents"), "lang", 400, 3)


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def first_rows(spark, sf_dir):
    return sampling.first_rows(table(spark, sf_dir, "documents"), 25, "doc_id").select("doc_id", "lang")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 4")
def first_per_task(spark, sf_dir):
    return sampling.first_per_task(table(spark, sf_dir, "documents"), 4, "doc_id", "source").select("source", "doc_id")


# --- translation results ------------------------------------------------------------

_CHECKED = (
    views.TRANSLATION_SQL
    + f", s1 AS (SELECT *, {duck.strip('gtext')} AS st FROM g), "
    f"n AS (SELECT *, {duck.count('st', '<think>')} AS o, {duck.count('st', '</think>')} AS c, string_split(st, '</think>')[1] AS bef, string_split(st, '</think>')[2] AS aft FROM s1), "
    f"v AS (SELECT *, coalesce((o = 0 AND c = 0) OR (c = 1 AND {_word('replace(bef, ' + duck.lit('<think>') + ', ' + duck.lit('') + ')')} AND {_word('aft')} AND (o = 0 OR (o = 1 AND starts_with(st, '<think>')))), false) AS valid FROM n), "
    "f AS (SELECT *, CASE WHEN valid AND o = 0 AND c = 1 THEN '<think>' || chr(10) || st ELSE gtext END AS fixed FROM v), "
    "b AS (SELECT doc_id, sample_id, coalesce(max(CASE WHEN valid THEN score END), -1.0) AS best_spbleu, "
    "(list(gen_key ORDER BY score DESC, gen) FILTER (valid))[1] AS best_generation_key, (list(fixed ORDER BY score DESC, gen) FILTER (valid))[1] AS best_text, "
    "count_if(valid) > 0 AS think_tag_valid, count_if(valid AND fixed = gtext)::int AS ok, count_if(valid AND fixed <> gtext)::int AS fixed, count_if(NOT valid)::int AS invalid, "
    "any_value(text) AS text, any_value(answer) AS gold FROM f GROUP BY ALL), "
    "tot AS (SELECT count(*) AS total, count_if(think_tag_valid) AS nv FROM b), "
    "top AS (SELECT b.* FROM b, tot WHERE think_tag_valid QUALIFY row_number() OVER (ORDER BY best_spbleu DESC, doc_id) <= least(greatest(1, (total * 0.2)::double::int), nv)) "
)
_CHECKED = _CHECKED.replace("(total * 0.2)::double::int", "floor(total::double * 0.2)")


def _checked(spark, sf_dir) -> DataFrame:
    return translation.think_checked(views.translation_records(spark, sf_dir))


@query(_CHECKED + "SELECT sample_id, best_spbleu, best_generation_key, think_tag_valid, ok, fixed, invalid FROM b")
def translation_think_checked(spark, sf_dir):
    return _checked(spark, sf_dir).select(
        "sample_id", "best_spbleu", "best_generation_key", "think_tag_valid", "think_counts.*"
    )


@query(views.TRANSLATION_SQL + "SELECT sample_id, max(score) AS score, (list(gen_key ORDER BY score DESC, gen))[1] AS best_key FROM g GROUP BY ALL")
def best_generation(spark, sf_dir):
    best = views.translation_records(spark, sf_dir).withColumn("b", records.best_key(F.col("spbleu")))
    return best.select("sample_id", F.col("b.score").alias("score"), F.col("b.key").alias("best_key"))


@query(_CHECKED + "SELECT sample_id, best_spbleu FROM top")
def top_fraction_by_score(spark, sf_dir):
    kept = translation.top_share(_checked(spark, sf_dir), 0.2, "doc_id")
    return kept.select("sample_id", "best_spbleu")


_SUMMARY = "round(avg(best_spbleu), 6) AS avg, (list(best_spbleu ORDER BY best_spbleu))[count(*) // 2 + 1] AS median, min(best_spbleu) AS min, max(best_spbleu) AS max"


@query(_CHECKED + f"SELECT 'valid' AS part, {_SUMMARY} FROM b WHERE think_tag_valid UNION ALL SELECT 'kept', {_SUMMARY} FROM top")
def translation_share_report(spark, sf_dir):
    return _rounded(translation.share_summary(_checked(spark, sf_dir), 0.2, "doc_id"))


@query(
    _CHECKED
    + "SELECT sample_id, md5('Translate: ' || text) AS user_md5, md5(best_text) AS assistant_md5, md5('Be exact.') AS system_md5, md5(gold) AS gold_md5, best_spbleu, best_generation_key FROM top"
)
def translation_chats(spark, sf_dir):
    kept = translation.top_share(_checked(spark, sf_dir), 0.2, "doc_id")
    chats = translation.chats(kept, "Be exact.")
    said = lambda role: F.md5(records.last_content(F.col("messages"), role)).alias(f"{role}_md5")
    return chats.select(
        "sample_id", said("user"), said("assistant"), said("system"), F.md5("gold_answer").alias("gold_md5"), "best_spbleu", "best_generation_key"
    )


_TRANSLATED = duck.strip(
    "string_split(" + duck.strip("regexp_replace(gtext, '(?s)<think>.*?</think>', '', 'g')") + ", chr(10))[-1]"
)
_BLEU = (
    views.TRANSLATION_SQL
    + f", h0 AS (SELECT doc_id, gen, sample_id, gen_key, score, {_TRANSLATED} AS hyp, answer FROM g), "
    f"h AS (SELECT *, {duck.words('hyp')} AS ht, {duck.words('answer')} AS rt FROM h0 WHERE doc_id % 2 = 1), "
    "hn AS (SELECT doc_id, gen, n, gram, count(*) AS k FROM (SELECT doc_id, gen, n, unnest(list_transform(range(1, len(ht) - n + 2), lambda i: array_to_string(ht[i:i + n - 1], ' '))) AS gram FROM h, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL), "
    "rn AS (SELECT doc_id, n, gram, count(*) AS k FROM (SELECT doc_id, n, unnest(list_transform(range(1, len(rt) - n + 2), lambda i: array_to_string(rt[i:i + n - 1], ' '))) AS gram FROM (SELECT DISTINCT doc_id, rt FROM h), (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL), "
    "m AS (SELECT doc_id, gen, hn.n, sum(hn.k) AS total, sum(least(hn.k, coalesce(rn.k, 0))) AS hit FROM hn LEFT JOIN rn USING (doc_id, n, gram) GROUP BY ALL), "
    "z AS (SELECT *, sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, gen ORDER BY n) AS misses FROM m), "
    "l AS (SELECT doc_id, gen, sum(hit) AS hits, avg(ln(CASE WHEN hit > 0 THEN 100.0::double * hit / total ELSE 100.0::double / (pow(2, misses) * total) END)) AS lg FROM z GROUP BY ALL), "
    "e AS (SELECT h.*, CASE WHEN coalesce(l.hits, 0) = 0 THEN 0.0::double ELSE round(exp(least(0.0::double, 1 - len(rt)::double / len(ht)) + lg), 4) END AS bleu FROM h LEFT JOIN l USING (doc_id, gen)), "
    "u AS (SELECT sample_id, gen, gen_key, bleu FROM e), "
    "w AS (SELECT sample_id, max(bleu) AS best_spbleu, (list(gen_key ORDER BY bleu DESC, gen))[1] AS best_generation_key, round(sum(bleu), 4) AS score_sum FROM u GROUP BY ALL "
    "UNION ALL SELECT sample_id, 0.0::double, 'generation1', round(sum(score), 4) FROM g WHERE doc_id % 2 = 0 GROUP BY ALL) "
)


@query(_BLEU + "SELECT * FROM w")
def translation_scored(spark, sf_dir):
    """Sentence BLEU of unscored (odd) records; scored ones keep what they have."""
    todo = F.col("doc_id") % 2 == 1
    given = views.translation_records(spark, sf_dir).withColumns(
        {
            "extracted_translation": F.transform_values("generated", lambda k, t: translation_text(t)),
            "spbleu": F.when(~todo, F.col("spbleu")),
        }
    )
    done = translation.scored(given, scoring.bleu_scores("whitespace"))
    total = F.aggregate(F.map_values("spbleu"), F.lit(0.0), lambda a, v: a + v)
    return done.select("sample_id", "best_spbleu", "best_generation_key", F.round(total, 4).alias("score_sum"))


# --- matching -----------------------------------------------------------------------


def _conversations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "sample_id")


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumnRenamed("user_id", "sample_id")


_LAST_TURN = "c AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)"
_LAST_EVENT = "e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"


@query(f"WITH {_LAST_TURN}, {_LAST_EVENT} SELECT conv_id AS sample_id, turn, md5(text) AS text_md5, event_id, value FROM c JOIN e ON conv_id = user_id")
def paired_last_wins(spark, sf_dir):
    both = joins.paired(_conversations(spark, sf_dir), _events(spark, sf_dir), "sample_id", "turn", "event_id")
    return both.select(
        "sample_id", "from_file1.turn", F.md5("from_file1.text").alias("text_md5"), "from_file2.event_id", "from_file2.value"
    )


@query(f"WITH {_LAST_EVENT} SELECT user_id, event_id, event_type, value FROM e")
def last_record_per_key(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return joins.last_per_key(events, ["user_id"], "event_id").select("user_id", "event_id", "event_type", "value")


@query(f"WITH {_LAST_EVENT} SELECT conv_id AS sample_id, turn, md5(text) AS text_md5, event_id AS event_id_2 FROM conversations JOIN e ON conv_id = user_id")
def matched_samples(spark, sf_dir):
    out = joins.matched(_conversations(spark, sf_dir), _events(spark, sf_dir), "sample_id", "event_id")
    return out.select("sample_id", "turn", F.md5("text").alias("text_md5"), "event_id_2")


_DIFF = (
    "t AS (SELECT DISTINCT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE source <> 'src7'), "
    "df AS (SELECT * FROM documents WHERE source IN (SELECT source FROM t) AND (source, doc_id) NOT IN (SELECT (source, doc_id) FROM t))"
)


def _difference(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    # a group the second side lacks entirely (src7) is skipped
    taken = docs.join(labels, "doc_id").filter(F.col("source") != "src7")
    return joins.difference(docs, taken, "source", "doc_id")


@query(f"WITH {_DIFF} SELECT source, doc_id FROM df")
def diff_anti(spark, sf_dir):
    return _difference(spark, sf_dir).select("source", "doc_id")


@query(f"WITH {_DIFF} SELECT source, doc_id FROM df QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_DOC_KEY}, doc_id) <= 3")
def diff_sample(spark, sf_dir):
    return sampling.per_task_sample(_difference(spark, sf_dir), 3, "doc_id", task="source").select("source", "doc_id")


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, sf_dir):
    rest = joins.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return rest.select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def common_ids(spark, sf_dir):
    return joins.common_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT count(*)::bigint AS n_missing, (SELECT count(DISTINCT doc_id) FROM labels)::bigint AS n_labelled FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def missing_ids(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = labels.agg(F.count_distinct("doc_id")).scalar()
    return joins.missing_keys(docs, labels, "doc_id").agg(F.count(F.lit(1)).alias("n_missing")).withColumn("n_labelled", labelled)


@query(views.TRANSLATION_SQL + "SELECT sample_id, gen_key, length(gtext)::int AS n_chars, score FROM g")
def zip_generations(spark, sf_dir):
    """Parallel maps joined by generation key inside the record."""
    both = F.map_zip_with("generated", "spbleu", lambda k, t, s: F.struct(F.length(t).alias("n_chars"), s.alias("score")))
    rows = records.explode_generations(views.translation_records(spark, sf_dir).withColumn("z", both), "z", "sample_id", name="v")
    return rows.select("sample_id", "gen_key", "v.n_chars", "v.score")


_PAIR = (
    "(SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE lang END AS src_lg, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'en' END AS trg_lg, "
    "['news_en2fr', 'de2en_x', 'en-fra', 'corpus_fr-en', 'plain'][doc_id % 5 + 1] AS stem FROM documents)"
)


def _pairs(spark, sf_dir) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    return table(spark, sf_dir, "documents").withColumns(
        {
            "src_lg": F.when(even, "en").otherwise(F.col("lang")),
            "trg_lg": F.when(even, F.col("lang")).otherwise("en"),
            "stem": views._spot(("news_en2fr", "de2en_x", "en-fra", "corpus_fr-en", "plain")),
        }
    )


@query(
    "SELECT direction, count(*)::bigint AS n FROM (SELECT coalesce(CASE WHEN src_lg = 'en' AND trg_lg <> 'en' THEN 'en2xx' WHEN trg_lg = 'en' AND src_lg <> 'en' THEN 'xx2en' END, "
    "CASE WHEN regexp_matches(lower(stem), '(^|[_-])en2[a-z]{2,3}([_-]|$)') THEN 'en2xx' WHEN regexp_matches(lower(stem), '(^|[_-])[a-z]{2,3}2en([_-]|$)') THEN 'xx2en' "
    "WHEN regexp_matches(lower(stem), '(^|[_-])en[_-][a-z]{2,3}([_-]|$)') THEN 'en2xx' WHEN regexp_matches(lower(stem), '(^|[_-])[a-z]{2,3}[_-]en([_-]|$)') THEN 'xx2en' END) AS direction "
    f"FROM {_PAIR}) WHERE direction IS NOT NULL GROUP BY direction"
)
def direction_split_counts(spark, sf_dir):
    found = F.coalesce(records.direction(F.col("src_lg"), F.col("trg_lg")), records.direction_of_name(F.col("stem")))
    named = _pairs(spark, sf_dir).withColumn("direction", found).filter(F.col("direction").isNotNull())
    return named.groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT src_lg || '2' || trg_lg AS pair, count(*)::bigint AS n FROM {_PAIR} WHERE (src_lg = 'en' AND trg_lg IN ('fr', 'de')) OR (trg_lg = 'en' AND src_lg IN ('fr', 'de')) GROUP BY ALL")
def language_pair_counts(spark, sf_dir):
    return records.language_pairs(_pairs(spark, sf_dir), ("fr", "de")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT md5(text) AS text_md5, source FROM (SELECT text, 'documents' AS source FROM documents UNION ALL SELECT text, 'conversations' FROM conversations UNION ALL SELECT text, 'benchmark' FROM benchmark)")
def union_shuffle(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select("text", F.lit(t).alias("source")) for t in ("documents", "conversations", "benchmark")]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.orderBy(hash_key("source", "text")).select(F.md5("text").alias("text_md5"), "source")

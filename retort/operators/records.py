"""Record shaping: per-generation values, chat messages, ids and validation."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort import constants as K
from retort.functions.text import occurrences, remove_all, strip


def keep_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on costly derived columns without deriving them a second time.

    Catalyst pushes a plain filter below the projection and repeats the projection's
    expressions in it. A column it may not move (the task number) keeps the filter above.
    """
    marked = df.withColumn("_part", F.spark_partition_id())
    return marked.filter((F.col("_part") >= 0) & condition).drop("_part")


def explode_generations(df: DataFrame, values: str, *keep: str, name: str = "value") -> DataFrame:
    """One row per entry of a map column, in key order of the record (``pos``).

    The outer form is used because Catalyst guards a plain explode with a filter on the
    map, which it would push down and so derive a computed map twice.
    """
    rows = df.select(*keep, F.posexplode_outer(values).alias("pos", "gen_key", name))
    return rows.filter(F.col("pos").isNotNull())


def generation_number(key: Column) -> Column:
    """Sort key of ``generationN`` names: numbers by value, other names behind them."""
    digits = F.regexp_extract(key, r"^generation([0-9]+)$", 1).try_cast("bigint")
    rank = F.when(digits.isNotNull(), 0).when(F.startswith(key, F.lit("generation")), 1).otherwise(2)
    return F.struct(rank.alias("kind"), F.coalesce(digits, F.lit(0)).alias("number"), key.alias("name"))


def natural_keys(keys: Column) -> Column:
    """Distinct generation names in natural order."""
    ordered = F.array_sort(F.transform(F.array_distinct(keys), generation_number))
    return F.transform(ordered, lambda k: k["name"])


def best_key(scores: Column) -> Column:
    """STRUCT<score, key> of the highest map value; the first key wins a tie, NULL if empty."""
    entries = F.transform(
        F.map_entries(scores),
        lambda e, i: F.struct(e["value"].alias("score"), (-i).alias("_at"), e["key"].alias("key")),
    )
    return F.array_max(F.filter(entries, lambda e: e["score"].isNotNull()))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(user: Column, assistant: Column | None = None, system: str | None = None) -> Column:
    """Message array: optional system text, user, optional assistant."""
    turns = [message("system", F.lit(system))] if system else []
    turns.append(message("user", user))
    if assistant is not None:
        turns.append(message("assistant", assistant))
    return F.array(*turns)


def last_content(messages: Column, role: str) -> Column:
    """Content of the last message of a role; empty when there is none."""
    own = F.filter(messages, lambda m: m["role"] == role)
    return F.coalesce(F.try_element_at(own, F.lit(-1))["content"], F.lit(""))


def translation_request(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Chat record -> (uuid, user_content, gold_answer); the id is a hash of the key."""
    from retort.operators.ranking import hash_key

    asked = F.replace(last_content(F.col("messages"), "user"), F.lit(K.OUTPUT_ONLY_SENTENCE), F.lit(""))
    digest = hash_key(key, seed=seed)
    shape = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"
    return df.withColumns(
        {
            "uuid": F.regexp_replace(digest, shape, "$1-$2-$3-$4-$5"),
            "user_content": strip(asked),
            "gold_answer": strip(last_content(F.col("messages"), "assistant")),
        }
    )


def prompt_text(prompt: Column) -> Column:
    """User text of a VARIANT prompt whose contents are strings or lists of text parts."""

    def content(item: Column) -> Column:
        body = F.try_variant_get(item, "$.content", "variant")
        parts = F.coalesce(F.try_variant_get(body, "$", "array<variant>"), F.array().cast("array<variant>"))
        texts = F.transform(
            F.filter(parts, lambda p: F.try_variant_get(p, "$.type", "string") == "text"),
            lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")),
        )
        is_list = F.startswith(F.schema_of_variant(body), F.lit("ARRAY"))
        is_text = F.schema_of_variant(body) == "STRING"
        return F.when(is_list, F.array_join(texts, "")).when(
            is_text, F.try_variant_get(body, "$", "string")
        )

    items = F.try_variant_get(prompt, "$", "array<variant>")
    users = F.filter(items, lambda i: F.try_variant_get(i, "$.role", "string") == "user")
    return F.array_join(F.transform(users, content), "")


def to_sharegpt(df: DataFrame, user: Column, assistant: Column) -> DataFrame:
    """(user, assistant) messages with the five metadata fields of a source record."""
    meta = ["task", "sample_id", "ground_truth", "output_core_tag_left", "output_core_tag_right"]
    return df.select(
        chat(user, assistant).alias("messages"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in meta],
    )


def instruction_prompt(task: Column, text: Column, instructions: dict[str, str], answer: bool = True) -> Column:
    """Task instruction + input (+ ``\\nAnswer: ``); unknown tasks have no instruction."""
    pairs = [F.lit(x) for item in instructions.items() for x in item]
    lead = F.coalesce(F.try_element_at(F.create_map(*pairs), task), F.lit("")) if pairs else F.lit("")
    return F.concat(lead, text, F.lit("\nAnswer: ")) if answer else F.concat(lead, text)


def nothink_sharegpt(
    df: DataFrame, instructions: dict[str, str], system: str, stem: str | None = None
) -> DataFrame:
    """Source records -> (system, user, assistant) chats; ``input`` and ``output`` leave.

    With ``stem`` (the column of the file stem) only files of known tasks are read, and
    the stem stands in for a missing task when the instruction is chosen.
    """
    task = F.col("task")
    if stem:
        df = df.filter(F.col(stem).isin(*instructions))
        task = F.coalesce(F.nullif(task, F.lit("")), F.col(stem))
    user = instruction_prompt(task, F.col("input"), instructions)
    return df.withColumn("messages", chat(user, F.col("output"), system)).drop("input", "output")


def generation_prompt(
    user: Column,
    mode: str,
    systems: dict[str, str],
    truth: Column | None = None,
    oracle: tuple[str, str] | None = None,
) -> Column:
    """Chat prompt of one of the four request modes, user content as a list of text parts.

    ``mode`` is ``oracle``, ``answer_first``, ``thinking`` or ``direct``; in oracle mode
    the texts in ``oracle`` go before and after the reference answer.
    """
    if mode not in systems:
        raise ValueError(f"no system text for mode {mode!r}")
    if mode == "oracle":
        if truth is None or oracle is None:
            raise ValueError("oracle mode needs the reference answer and its texts")
        user = F.concat(user, F.lit(oracle[0]), truth, F.lit(oracle[1]))
    part = F.struct(F.lit("text").alias("type"), user.alias("text"))
    asked = F.struct(F.lit("user").alias("role"), F.array(part).alias("content"))
    return F.concat(
        F.lit("["), F.to_json(message("system", F.lit(systems[mode]))),
        F.lit(","), F.to_json(asked), F.lit("]"),
    )


def sample_id(given: Column, task: Column, position: Column) -> Column:
    return F.coalesce(given, F.concat_ws(".", task, position.cast("string")))


def path_mode(path: Column) -> Column:
    """Name of an inference folder: its last two path parts joined by ``_``."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    tail = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    return F.regexp_replace(F.array_join(tail, "_"), r"[/\\]", "_")


def safe_name(name: Column) -> Column:
    return F.translate(name, "/\\ ", "___")


def threshold_name(stem: Column, threshold: float) -> Column:
    """Output name of a re-thresholded file: an older threshold suffix is replaced."""
    base = F.substring_index(stem, "_METEOR", 1)
    kept = F.when(F.contains(stem, F.lit("METEOR")), base).otherwise(stem)
    return F.concat(kept, F.lit(f"_METEOR{threshold:.2f}"))


def without_split(name: Column) -> Column:
    return F.regexp_replace(name, "_split.*", "")


def strip_markers(messages: Column, markers: tuple[str, ...] = K.MARKERS_WITH_TAGS) -> Column:
    """Messages with special markers removed from assistant contents."""
    return F.transform(
        messages,
        lambda m: m.withField(
            "content",
            F.when(m["role"] == "assistant", remove_all(m["content"], markers)).otherwise(m["content"]),
        ),
    )


def marker_counts(messages: Column, markers: tuple[str, ...] = K.MARKERS_WITH_TAGS) -> Column:
    """STRUCT of assistant messages, changed messages and marker occurrences."""
    own = F.filter(messages, lambda m: m["role"] == "assistant")

    def found(m: Column) -> Column:
        total = reduce(operator.add, [occurrences(m["content"], marker) for marker in markers])
        return F.when(F.contains(m["content"], F.lit("<")), total).otherwise(F.lit(0))

    return F.struct(
        F.size(own).alias("assistant_messages"),
        F.size(F.filter(own, lambda m: remove_all(m["content"], markers) != m["content"])).alias("modified_messages"),
        F.aggregate(F.transform(own, found), F.lit(0), lambda a, x: a + x).alias("removed"),
    )


def sharegpt_error(record: Column) -> Column:
    """Why a VARIANT record is not a chat record; NULL if it is one.

    A null role or content is accepted, a missing one is not.
    """
    messages = F.try_variant_get(record, "$.messages", "variant")
    items = F.try_variant_get(record, "$.messages", "array<variant>")
    broken = F.exists(
        items,
        lambda m: F.try_variant_get(m, "$.role", "variant").isNull()
        | F.try_variant_get(m, "$.content", "variant").isNull(),
    )
    return (
        F.when(messages.isNull(), F.lit("missing messages"))
        .when(items.isNull(), F.lit("messages is not a list"))
        .when(broken, F.lit("message lacks role or content"))
    )


def direction(source: Column, target: Column) -> Column:
    """``en2xx`` / ``xx2en`` from two language codes, else NULL."""
    return F.when((source == "en") & (target != "en"), F.lit("en2xx")).when(
        (target == "en") & (source != "en"), F.lit("xx2en")
    )


def direction_of_name(stem: Column) -> Column:
    """Direction from a file name, by the first of four shapes that occurs in it."""
    name = F.lower(stem)
    # Shapes of direction-bearing file names, in order.
    shapes = (
        (r"(^|[_-])en2[a-z]{2,3}([_-]|$)", "en2xx"),
        (r"(^|[_-])[a-z]{2,3}2en([_-]|$)", "xx2en"),
        (r"(^|[_-])en[_-][a-z]{2,3}([_-]|$)", "en2xx"),
        (r"(^|[_-])[a-z]{2,3}[_-]en([_-]|$)", "xx2en"),
    )
    return F.coalesce(*[F.when(F.regexp_like(name, F.lit(p)), F.lit(d)) for p, d in shapes])


def language_of_name(stem: Column) -> Column:
    """Language code out of an ``en2xx`` or ``xx2en`` file name (the last place that has one), else NULL."""
    # Name patterns, in order.
    patterns = (r"^.*en2([A-Za-z]{2,3})", r"^.*([A-Za-z]{2,3})2en")
    return F.coalesce(*[F.nullif(F.regexp_extract(stem, p, 1), F.lit("")) for p in patterns])


def language_pairs(df: DataFrame, langs: tuple[str, ...] = K.LOW_RESOURCE_LANGS) -> DataFrame:
    """Records between English and one of ``langs``, with the pair as ``en2xx``-style name."""
    source, target = F.col("src_lg"), F.col("trg_lg")
    wanted = ((source == "en") & target.isin(*langs)) | ((target == "en") & source.isin(*langs))
    return df.filter(wanted).withColumn("pair", F.concat(source, F.lit("2"), target))

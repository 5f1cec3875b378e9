"""Reply-ordered conversations from quoted messages, in DataFrame operations only.

Lines that begin with one or more ``>`` are quoted, as deep as there are marks. Runs of lines of
one depth are passages; a passage's normalised text is hashed and joined to the messages whose own
text (the lines that aren't quoted) has the same hash. A message replies to the original of its
shallowest passage that has one; chains of replies are followed by doubling, so that a chain of n
messages takes log n rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.text import SPACE_PATTERN, saved

MARKS = r"^((?:[\x20\x09]*>)+)[\x20\x09]?"


def quote(text: Column) -> Column:
    """The text as a reply quotes it: one mark more before every line."""
    return F.regexp_replace(text, r"(?m)^", "> ")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE_PATTERN, " "))


def threads(
    messages: DataFrame, scope_col: str = "conv_id", id_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per input row: scope, id, role, parent_id, root_id, depth, n_quotes, text.

    ``parent_id`` is the earliest message of the scope (by id) whose own text a passage quotes, if
    it is earlier than the message itself; among a message's passages the shallowest one that has
    such an original counts, and of those the first. ``root_id`` and ``depth`` follow the replies up;
    ordering by root, depth and id gives the conversation. ``text`` has no quotes and no blank
    lines at its ends. Null texts count as empty, and an empty text is no original. Messages
    without an id reply to others but are no originals; a null scope is a scope. Repeated rows each
    have their row and are the same original. An empty table gives an empty result.
    """
    rows = messages.select(
        F.col(scope_col).alias("scope"), F.col(id_col).alias("id"), F.col(role_col).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = saved(rows.withColumn("uid", F.monotonically_increasing_id()), "quotes-rows")

    lines = rows.select("uid", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    lines = lines.select("uid", "pos", F.regexp_count(marks, F.lit(">")).alias("level"), F.regexp_replace("line", MARKS, "").alias("line"))
    in_text = Window.partitionBy("uid").orderBy("pos")
    turned = F.coalesce(F.col("level") != F.lag("level").over(in_text), F.lit(False))
    runs = lines.withColumn("turned", turned).withColumn("run", F.sum(F.col("turned").cast("int")).over(in_text))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    passages = saved(runs.groupBy("uid", "run", "level").agg(joined.alias("part")), "quotes-passages")

    own = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("run", "part"))))
    clean = F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["part"]), "\n"), r"\A\s+|\s+\z", "")
    texts = passages.groupBy("uid").agg(own.alias("parts"), F.count_if(F.col("level") > 0).alias("n_quotes"))
    rows = rows.drop("text").join(texts.select("uid", clean.alias("text"), "n_quotes"), "uid")
    rows = saved(rows.withColumn("digest", F.md5(normalised(F.col("text")))), "quotes-texts")

    # one original per text and scope: the earliest
    originals = rows.filter("id IS NOT NULL AND text != ''").groupBy("scope", "digest").agg(F.min(F.struct("id", "uid")).alias("first"))
    originals = originals.select(F.col("scope").alias("o_scope"), F.col("digest").alias("o_digest"), "first")
    quoted = passages.filter("level > 0").select("uid", "level", "run", F.md5(normalised(F.col("part"))).alias("digest"))
    quoted = quoted.join(rows.select("uid", "scope", "id"), "uid")
    found = quoted.join(originals, F.col("scope").eqNullSafe(F.col("o_scope")) & (F.col("digest") == F.col("o_digest")))
    found = found.filter(F.col("id").isNull() | (F.col("first.id") < F.col("id")))
    parents = found.groupBy("uid").agg(F.min(F.struct("level", "run", "first")).alias("best"))
    parents = parents.select("uid", F.col("best.first.uid").alias("parent"), F.col("best.first.id").alias("parent_id"))

    rows = rows.join(parents, "uid", "left")
    ups = saved(rows.select("uid", F.coalesce("parent", "uid").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth")), "quotes-ups")
    total = None
    while True:
        now = ups.agg(F.sum("depth")).first()[0]
        if now == total:
            break
        total = now
        above = ups.select(F.col("uid").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        ups = saved(ups.join(above, "up").select("uid", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth")), "quotes-ups")
    roots = rows.select(F.col("uid").alias("up"), F.col("id").alias("root_id"))
    return rows.join(ups.join(roots, "up"), "uid").select("scope", "id", "role", "parent_id", "root_id", "depth", "n_quotes", "text")

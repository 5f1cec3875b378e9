"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets share the total by weight; a source never gets more than ``max_epochs`` times its size.
What a capped source can't take goes to the others by weight, until none is above its cap. The
sources in order of cap / weight make this one pass: a source is capped exactly if its share of
what the earlier capped sources left is more than its cap.

A source's documents are then taken a whole number of times each, and the fractional rest by a
seeded order: documents from the front of that order once more, up to the target. The order is
cut without sorting a source: hash buckets are summed first, and only the bucket in which the
target falls is put in order row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.text import WORD_PATTERN, saved
from retort.operators.stored import fresh

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Target per source, from (source, source_size), one row per source.

    The catalogue of sources is ranked in one window: its rows are sources, not documents.
    Sources of size 0 get 0.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(cycle, (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ranked = sizes.withColumns({"rank": rank, "weight": weight}).withColumn("cap", cap)
    order = [F.col("cap") / F.col("weight"), F.col("rank")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("weight").over(onward))
    # the first source that isn't capped fixes the level of all that follow it
    open_level = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    first = F.first(open_level, ignorenulls=True).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.when(first.isNull(), F.col("cap")).otherwise(first * F.col("weight"))
    return level.select("source", "source_size", target.alias("target"))


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, whole, part, taken.

    The mix takes a row's text ``whole`` times and a ``part`` (0 to 1) of it once more; ``taken``
    is the words of both. In each source all rows have part 0 or 1 but those of one identifier,
    at which the target is met to the word. Null texts and texts without words have size 0 and
    take 0; a null source is a source; rows with one identifier (null too) are taken alike.
    Equal input gives equal output, whatever the partitioning. An empty table gives an empty
    result; other columns are not read.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")
    )
    rows = saved(rows.withColumn("bucket", F.left("key", F.lit(4))), "mix-rows")

    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = saved(targets, "mix-targets")

    def crossing(sums: DataFrame, by: str) -> DataFrame:
        """The first ``by`` of each source at which the running size passes the rest."""
        upto = F.sum("size").over(Window.partitionBy("source").orderBy(by))
        at = sums.withColumn("upto", upto).join(_named(targets.select("source", "rest"), "t_"), F.col("source").eqNullSafe(F.col("t_source")))
        at = at.filter(F.col("upto") > F.col("t_rest"))
        return at.groupBy("source").agg(F.min(F.struct(by, "upto", "size")).alias("at")).select("source", "at.*")

    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    at_bucket = saved(crossing(buckets, "bucket"), "mix-buckets")
    inside = rows.join(
        _named(at_bucket, "b_"), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))
    ).withColumn("before", F.col("b_upto") - F.col("b_size"))
    keys = inside.groupBy("source", "key", "before").agg(F.sum("size").alias("size"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key"))
    at_key = keys.withColumn("upto", upto).join(_named(targets.select("source", "rest"), "t_"), F.col("source").eqNullSafe(F.col("t_source")))
    at_key = at_key.filter(F.col("upto") > F.col("t_rest")).groupBy("source").agg(F.min(F.struct("key", "upto", "size")).alias("at"))
    cuts = targets.join(_named(at_key.select("source", "at.*"), "c_"), F.col("source").eqNullSafe(F.col("c_source")), "left")
    cuts = cuts.withColumn("c_part", (F.col("rest") - (F.col("c_upto") - F.col("c_size"))) / F.col("c_size"))

    cuts = cuts.select(F.col("source").alias("s_source"), "source_size", "target", "whole", "c_key", "c_part")
    mixed = rows.join(cuts, F.col("source").eqNullSafe(F.col("s_source")))
    part = (
        F.when((F.col("size") == 0) | F.col("c_key").isNull() | (F.col("key") > F.col("c_key")), F.lit(0.0))
        .when(F.col("key") < F.col("c_key"), F.lit(1.0))
        .otherwise(F.col("c_part"))
    )
    mixed = mixed.withColumn("part", part)
    taken = F.col("whole") * F.col("size") + F.floor(F.col("part") * F.col("size"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "whole", "part", taken.cast("long").alias("taken"))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``, in its columns, each repeated as often as it is taken.

    The one partly taken identifier of a source is taken whole if the part is a half or more,
    so that no text is cut. Rows that share an identifier and a source are taken alike.
    """
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    times = mixture(docs, **options).groupBy("doc_id", "source").agg(F.max(F.col("whole") + F.round("part").cast("long")).alias("times"))
    own_id, own_source, n, copy = fresh(docs, "_mix_id", "_mix_source", "_mix_times", "_mix_copy")
    times = times.filter("times > 0").select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("times").alias(n))
    taken = docs.join(times, F.col(id_col).eqNullSafe(F.col(own_id)) & F.col(source_col).eqNullSafe(F.col(own_source)))
    copies = F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))
    return taken.select(*docs.columns, copies.alias(copy)).drop(copy)

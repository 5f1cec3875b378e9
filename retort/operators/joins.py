"""Key-based matching of record sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salted_join(df: DataFrame, few: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """Join with a frame of one row per group, so that no group's rows gather in one task.

    Rows are dealt out by group and a hash of ``by`` (columns that tell rows of a group apart);
    ``few`` is repeated once per salt, and there are as many salts as shuffle partitions.
    """
    salts = shuffle_width(df)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    every = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(every, [*keys, "_salt"], how).drop("_salt")


def last_per_key(df: DataFrame, keys: list[str], ordinal: str | Column) -> DataFrame:
    """Last record per key by ``ordinal`` (unique within a key); records without a key are dropped.

    The last ordinals are found on the keys alone (a hash aggregate), and records are only
    filtered by them, so whole records are never aggregated and a hot key is spread.
    """
    present = df.dropna(subset=keys).withColumn("_last", F.col(ordinal) if isinstance(ordinal, str) else ordinal)
    latest = present.groupBy(*keys).agg(F.max("_last").alias("_last"))
    return present.join(latest, [*keys, "_last"]).select(*df.columns)


def paired(
    left: DataFrame, right: DataFrame, key: str, left_ordinal: str, right_ordinal: str
) -> DataFrame:
    """Records of both sides with the same key, each side last-wins, nested whole."""

    def nested(df: DataFrame, ordinal: str, name: str) -> DataFrame:
        return last_per_key(df, [key], ordinal).select(key, F.struct(*df.columns).alias(name))

    return nested(left, left_ordinal, "from_file1").join(
        nested(right, right_ordinal, "from_file2"), key
    )


def matched(left: DataFrame, right: DataFrame, key: str, right_ordinal: str) -> DataFrame:
    """Every left record with the last right record of its key (left duplicates stay)."""
    renamed = last_per_key(right, [key], right_ordinal)
    renamed = renamed.select(
        key, *[F.col(c).alias(f"{c}_2") for c in right.columns if c != key]
    )
    return left.join(renamed, key)


def difference(full: DataFrame, taken: DataFrame, group: str, key: str) -> DataFrame:
    """Records of ``full`` whose key is not in ``taken``, group by group.

    Groups ``taken`` does not know at all are skipped; duplicates in ``full`` stay.
    """
    ids = taken.select(group, key).distinct()
    known = ids.select(group).distinct()
    return salted_join(full.join(ids, [group, key], "left_anti"), known, [group], [key], "left_semi")


def pending(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests without a saved result."""
    return requests.join(done.select(key).dropna().distinct(), key, "left_anti")


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).dropna().intersect(right.select(key).dropna())


def missing_keys(wanted: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti")

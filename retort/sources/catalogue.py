"""One planned list of input files: what is read, in which order, and where its result goes.

Paths come from Spark's own listing, so any store it reads will do; files are not opened. The
list is as long as the number of files, which the planner of a read holds in any case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retort.sources.files import nearest_folders


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return reader.load(root).select("path", "length")


def plain(path: str) -> str:
    """A path without the marks of the local scheme, so that spellings of one file compare equal."""
    for scheme in ("file://", "file:"):
        if path.startswith(scheme):
            path = path[len(scheme) :]
            break
    return path.rstrip("/")


def catalogue(
    spark: SparkSession,
    root: str,
    patterns: tuple[str, ...] = ("*.jsonl",),
    output: str | None = None,
    skip_root_level: bool = False,
    nearest: bool = False,
) -> DataFrame:
    """path, folder, name, length, ordinal of the files below ``root`` to read, each path once.

    ``output``, a file or folder that a job is about to write, is never read, however it is
    spelled. ``skip_root_level`` leaves out files that lie in ``root`` itself. ``nearest`` keeps
    the root's own files if it has any, else those of the nearest folders below it that have
    some. ``ordinal`` counts files from 1 in path order. Spark does not
    list files without content.
    """
    found = _listed(spark, root, patterns[0])
    for pattern in patterns[1:]:
        found = found.unionByName(_listed(spark, root, pattern))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    found = found.dropDuplicates(["path"]).withColumns({"folder": folder, "name": F.element_at(F.split("path", "/"), -1)})
    local = F.regexp_replace("path", "^file:(//)?", "")
    if output:
        taken = plain(output)
        found = found.filter((local != taken) & ~F.startswith(local, F.lit(f"{taken}/")))
    if skip_root_level:
        found = found.filter(F.regexp_replace("folder", "^file:(//)?", "") != plain(root))
    if nearest:
        found = found.join(nearest_folders(found.select("path"), plain(root)), "folder", "left_semi")
    order = Window.orderBy("path")  # a row per file
    return found.select("path", "folder", "name", "length", F.row_number().over(order).alias("ordinal"))


def planned_outputs(files: DataFrame, folder: str | None = None, name: str | None = None) -> DataFrame:
    """Adds ``output``, the file that each file's folder is merged into.

    It is named after the folder without ``_split`` and what follows, and lies beside it or in
    ``folder``. One ``name`` for several folders is an error, as they would overwrite each other.
    """
    if name is not None:
        folders = files.select("folder").distinct().limit(2).count()
        if folders > 1:
            raise ValueError(f"one output name ({name}) for several folders")
    stem = F.regexp_replace(F.element_at(F.split("folder", "/"), -1), "_split.*$", "")
    target = F.lit(folder.rstrip("/")) if folder else F.regexp_replace("folder", "/[^/]*$", "")
    return files.withColumn("output", F.concat(target, F.lit("/"), F.lit(name) if name else F.concat(stem, F.lit(".jsonl"))))

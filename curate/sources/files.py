"""Finding result files below a root folder, and writing many sets there in one job."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTED = {"quote": '"', "escape": '"', "multiLine": True}
"""Options of standard CSV: a quote inside a field is doubled, and fields may hold line breaks."""


def dataset_paths(spark: SparkSession, root: str, ending: str) -> list[str]:
    """Sorted paths below ``root`` whose name matches the regular expression ``ending``.

    A match is a file, or a folder of part files written by Spark. Only the listing is read.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name = rf"^.*?/[^/]*{ending}(?=$|/part-[^/]*$)"
    found = listing.selectExpr(f"regexp_extract(path, r'{name}', 0) AS path").where("path <> ''").distinct()
    return sorted(r.path for r in found.collect())


def folder_and_stem(path: str) -> tuple[str, str]:
    """Name of the parent folder and file name without its extension."""
    folder, name = path.rstrip("/").split("/")[-2:]
    return folder, re.sub(r"\.[^.]*$", "", name)


def write_routed(
    df: DataFrame, root: str, by: Sequence[str], target: Callable[..., str], format: str, options: dict | None = None
) -> list[tuple[str, ...]]:
    """Write the rows of every value of ``by`` to ``{root}/{target(*value)}`` and return the values.

    One job writes all sets into a folder below the root that readers do not see; then each set is put in its
    place by a rename, instead of a set of that name from before. A job that fails leaves the old sets alone.
    The columns ``by`` are not in the files, and rows keep their order: tasks are files in the order of their names.
    A row without a name (NULL or empty) fails the write. Hadoop cannot list names with a colon; make them
    safe first (:func:`curate.functions.naming.safe_name`).
    """
    spark, names = df.sparkSession, list(by)
    fold = spark._jvm.org.apache.hadoop.fs.Path
    unescaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    staged = fold(f"{root.rstrip('/')}/_staged-{uuid.uuid4().hex}")
    files = staged.getFileSystem(spark._jsc.hadoopConfiguration())
    named = {c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.raise_error(F.lit(f"{c} is empty"))) for c in names}
    ordered = df.withColumns(named).withColumn("__order", F.monotonically_increasing_id())
    ordered = ordered.sortWithinPartitions(*names, "__order").drop("__order")
    try:
        ordered.write.partitionBy(*names).options(**(options or {})).format(format).save(staged.toString())
        found = files.globStatus(fold(staged, "/".join(f"{c}=*" for c in names)))
        values = []
        for folder in sorted(f.getPath().toString() for f in found):
            parts = folder.split("/")[-len(names) :]
            value = tuple(unescaped(part.split("=", 1)[1]) for part in parts)
            place = fold(f"{root.rstrip('/')}/{target(*value)}")
            files.mkdirs(place.getParent())
            files.delete(place, True)
            if not files.rename(fold(folder), place):
                raise OSError(f"cannot put {place.toString()} in its place")
            values.append(value)
        return values
    finally:
        files.delete(staged, True)

"""Prediction tables on disk: one set per system, one column per class probability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.constants import CLASS_NAMES
from curate.operators.order_index import rank_by_order
from curate.sources.files import QUOTED, dataset_paths, folder_and_stem, write_routed

SUFFIX = "_predictions"


def wide(preds: DataFrame, class_names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """``probs`` as one column per class."""
    others = [c for c in preds.columns if c != "probs"]
    return preds.select(*others, *[F.col("probs")[i].alias(f"prob_{n}") for i, n in enumerate(class_names)])


def write_predictions(
    preds: DataFrame, root: str, systems: Sequence[str], format: str = "parquet", class_names: Sequence[str] = CLASS_NAMES
) -> None:
    """One set ``{root}/{system}_predictions.{format}`` per system; a system may be ``folder/name``.

    One job writes the sets of all systems (:func:`curate.sources.files.write_routed`); a listed system
    without rows gets an empty set, and those not listed are left out.
    """
    options = {"header": True, **(QUOTED if format == "csv" else {})}
    mine = wide(preds.where(F.col("system").isin(*systems)), class_names)
    written = write_routed(mine, root, ["system"], lambda system: f"{system}{SUFFIX}.{format}", format, options)
    for system in set(systems) - {name for name, in written}:
        mine.drop("system").limit(0).write.mode("overwrite").options(**options).format(format).save(f"{root}/{system}{SUFFIX}.{format}")


def _positioned(df: DataFrame) -> DataFrame:
    """Number the rows of a set from 0: files by path, blocks of a file by offset, rows of a block by their place.

    The rows of a block are read in order by one task, so ids made there keep their order.
    """
    where = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    ordered = where.withColumn("__order", F.monotonically_increasing_id())
    numbered = rank_by_order(ordered, [], ["__file", "__block", "__order"], "row_id")
    return numbered.withColumn("row_id", F.col("row_id") - 1).drop("__file", "__block", "__order", "row_id_size")


def read_predictions(
    spark: SparkSession, root: str, class_names: Sequence[str] = CLASS_NAMES
) -> DataFrame:
    """``(system, row_id, text, true_label, pred_label, probs)`` of all sets below ``root``.

    A system is named ``folder/stem``, or ``stem`` directly in the root. Sets without predicted
    labels are skipped, absent columns read NULL. The rows of a set
    without ``row_id`` are numbered by their position, over all of its files in the order of their names.
    """
    base = root.rstrip("/").split("/")[-1]
    parts = []
    for path in dataset_paths(spark, root, rf"{SUFFIX}\.(csv|parquet)"):
        folder, stem = folder_and_stem(path)
        stem = stem.replace(SUFFIX, "")
        kind = path.rsplit(".", 1)[1]
        df = spark.read.options(header=True, **(QUOTED if kind == "csv" else {})).format(kind).load(path)
        if "pred_label" not in df.columns:
            continue
        if "row_id" not in df.columns:
            df = _positioned(df)

        def column(name: str, kind: str, df=df):
            return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)

        probs = F.array(*[column(f"prob_{n}", "double") for n in class_names])
        has_probs = all(f"prob_{n}" in df.columns for n in class_names)
        parts.append(
            df.select(
                F.lit(stem if folder == base else f"{folder}/{stem}").alias("system"),
                column("row_id", "bigint"),
                column("text", "string"),
                column("true_label", "int"),
                column("pred_label", "int"),
                (probs if has_probs else F.lit(None).cast("array<double>")).alias("probs"),
            )
        )
    if not parts:
        raise FileNotFoundError(f"no prediction sets below {root}")
    return reduce(DataFrame.unionByName, parts)


def truth(preds: DataFrame) -> DataFrame:
    """``(row_id, true_label)`` of the first system, by name, that carries labels."""
    labelled = preds.where("true_label IS NOT NULL")
    first = labelled.agg(F.min("system")).scalar()
    return labelled.where(F.col("system") == first).select("row_id", "true_label")


def consolidated(scenarios: Mapping[str, DataFrame]) -> DataFrame:
    """All scenarios in one table, systems prefixed with their scenario."""
    parts = [
        df.withColumn("system", F.concat_ws("_", F.lit(name), F.col("system"))) for name, df in scenarios.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def registered(preds: DataFrame, registry: Mapping[str, str]) -> DataFrame:
    """The rows of registered systems, under their registry key (``registry`` maps key to system).

    A system with several keys gives its rows once under each.
    """
    keys: dict[str, list[str]] = {}
    for key, system in registry.items():
        keys.setdefault(system, []).append(key)
    entries = [x for system, own in keys.items() for x in (F.lit(system), F.array(*map(F.lit, own)))]
    known = F.create_map(*entries).cast("map<string, array<string>>")
    return preds.withColumn("key", F.explode(F.try_element_at(known, F.col("system"))))


def missing_systems(preds: DataFrame, registry: Mapping[str, str]) -> DataFrame:
    """``(key, system)`` of the registered systems without rows."""
    listed = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(s).alias("system")) for k, s in registry.items()])
    wanted = preds.sparkSession.range(1).select(F.inline(listed))
    return wanted.join(preds.select("system").distinct(), "system", "left_anti").select("key", "system")

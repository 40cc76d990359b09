"""Metric records, reports, test summaries and training histories as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.constants import ALPHA, MAIN_METRICS, focus_metrics
from curate.sources.files import dataset_paths, write_routed

DEFAULT_METRICS = tuple(m for m, _ in (*MAIN_METRICS, *focus_metrics()))


def no_nan(df: DataFrame) -> DataFrame:
    """NaN as NULL, which JSON can hold."""
    return df.select(
        *[F.nanvl(c, F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def write_metrics(metrics: DataFrame, root: str, name: Sequence[str] = ("folder", "stem")) -> None:
    """One ``{folder}/{stem}_metrics.json`` per row, all by one job."""
    write_routed(no_nan(metrics), root, name, lambda folder, stem: f"{folder}/{stem}_metrics.json", "json", {"ignoreNullFields": False})


def read_metrics(spark: SparkSession, root: str, metrics: Sequence[str] = DEFAULT_METRICS) -> DataFrame:
    """``(folder, stem, metrics…)`` of every metric record below ``root``.

    Aggregates (``all_…``), test summaries, unreadable files and records without any top-level
    metric are left out; a metric that is missing reads NULL.
    """
    paths = [
        p
        for p in dataset_paths(spark, root, r"_metrics\.json")
        if not p.rsplit("/", 1)[1].startswith("all_") and "statistical" not in p.rsplit("/", 1)[1]
    ]
    if not paths:
        raise FileNotFoundError(f"no metric records below {root}")
    schema = ", ".join(f"{m} DOUBLE" for m in metrics) + ", _corrupt_record STRING"
    raw = spark.read.schema(schema).option("multiLine", True).json(paths)
    name = r"([^/]+)/([^/]+)\.json(/part-[^/]*)?$"
    # File paths come as in an address: %20 for a space, but + for itself.
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    place = raw.select("*", decoded.alias("__path"))
    usable = place.where(F.col("_corrupt_record").isNull() & F.coalesce(*metrics).isNotNull())
    return usable.select(
        F.regexp_extract("__path", name, 1).alias("folder"), F.regexp_extract("__path", name, 2).alias("stem"), *metrics
    )


def write_aggregate(metrics: DataFrame, path: str, name: str = "system") -> None:
    """One JSON record that maps every system to its metrics, NaN as NULL; a row per system comes in."""
    clean = no_nan(metrics)
    values = F.struct(*[c for c in clean.columns if c != name])
    entry = F.struct(F.col(name).cast("string").alias("name"), values.alias("metrics"))
    record = clean.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("record"))
    record.select(F.to_json("record", {"ignoreNullFields": "false"})).write.mode("overwrite").text(path)


def read_aggregate(spark: SparkSession, path: str, metrics: Sequence[str] = DEFAULT_METRICS, name: str = "system") -> DataFrame:
    """``(system, metrics…)`` of a record of :func:`write_aggregate`; a metric that is missing reads NULL."""
    shape = "MAP<STRING, STRUCT<" + ", ".join(f"{m}: DOUBLE" for m in metrics) + ">>"
    rows = spark.read.text(path).select(F.explode(F.from_json("value", shape)).alias(name, "m"))
    return rows.select(name, "m.*")


def write_report(table: DataFrame, path: str, format: str = "csv") -> None:
    """A report or result table with a header."""
    table.write.mode("overwrite").option("header", True).format(format).save(path)


def test_summary(tests: DataFrame, systems: Sequence[str] | Column, alpha: float = ALPHA) -> DataFrame:
    """One row with the JSON text of a pairwise-test summary (a record per pair of systems)."""
    names = systems if isinstance(systems, Column) else F.array(*[F.lit(s) for s in systems])
    records = F.array_sort(F.collect_list(F.struct(*tests.columns)))
    one = tests.agg(F.count("*").alias("n_pairs"), records.alias("results"))
    summary = F.struct(
        F.lit(alpha).alias("alpha"),
        F.size(names).alias("n_systems"),
        names.alias("systems"),
        F.col("n_pairs"),
        F.col("results"),
    )
    return one.select(F.to_json(summary, {"ignoreNullFields": "false"}).alias("value"))


def write_histories(history: DataFrame, path: str) -> None:
    """Per run one JSON record with the history arrays in epoch order.

    A run has as many entries as epochs, so the arrays stay short.
    """
    rows = F.array_sort(F.collect_list(F.struct("epoch", "train_loss", "val_loss", "val_f1_macro")))
    runs = history.groupBy("run").agg(rows.alias("rows"))

    def array_of(name: str) -> Column:
        return F.transform("rows", lambda r: r[name]).alias(name)

    arrays = [array_of(c) for c in ("train_loss", "val_loss", "val_f1_macro")]
    runs.select("run", F.struct(*arrays).alias("history")).write.mode("overwrite").json(path)


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """``(run, epoch, train_loss, val_loss, val_f1_macro)`` from history records."""
    arrays = "train_loss ARRAY<DOUBLE>, val_loss ARRAY<DOUBLE>, val_f1_macro ARRAY<DOUBLE>"
    raw = spark.read.schema(f"run BIGINT, history STRUCT<{arrays.replace(' ARRAY', ': ARRAY')}>").json(path)
    zipped = F.arrays_zip("history.train_loss", "history.val_loss", "history.val_f1_macro")
    return raw.select("run", F.posexplode(zipped).alias("pos", "e")).select(
        "run", (F.col("pos") + 1).cast("bigint").alias("epoch"), "e.train_loss", "e.val_loss", "e.val_f1_macro"
    )

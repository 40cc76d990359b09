"""Result tables: scenario lookup, projection, formatting, ranking, flags, chart data.

The tables here have one row per evaluated system, so ungrouped windows are over a handful of
rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.constants import MAIN_METRICS, focus_metrics
from curate.functions.naming import heading, metric_cell, stem_key

Entry = tuple[str, str, str]
ID_COLUMNS = ("scenario", "method", "group")


def scenario_of(
    stem: Column,
    folder: Column,
    by_folder: Mapping[str, Mapping[str, Entry]],
    flat: Mapping[str, Entry],
    folder_groups: Mapping[str, str],
    unknown: str = "Unknown",
) -> Column:
    """Struct ``(scenario, method, group, match_kind)`` of a metrics file.

    Looked up as: exact in the folder, registered name inside the key in the folder, exact in the
    flat registry, registered name inside the key in the flat registry, else the title-cased key.
    The registry is a short caller argument, so the lookup is one CASE expression.
    """
    key, where = stem_key(stem), F.lower(folder)

    def found(entry: Entry, kind: str) -> Column:
        names = (*ID_COLUMNS, "match_kind")
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (*entry, kind))])

    rules: list[tuple[Column, Column]] = []
    for name, entries in by_folder.items():
        here = where == name
        rules += [(here & (key == k), found(e, "folder_exact")) for k, e in entries.items()]
        rules += [(here & key.contains(k), found(e, "folder_part")) for k, e in entries.items()]
    rules += [(key == k, found(e, "flat_exact")) for k, e in flat.items()]
    rules += [(key.contains(k), found(e, "flat_part")) for k, e in flat.items()]
    groups = F.lit(unknown)
    for name, group in folder_groups.items():
        groups = F.when(where == name, F.lit(group)).otherwise(groups)
    fallback = F.struct(
        F.lit("??").alias("scenario"), heading(key).alias("method"), groups.alias("group"), F.lit("none").alias("match_kind")
    )
    chain = F.when(*rules[0])
    for rule in rules[1:]:
        chain = chain.when(*rule)
    return chain.otherwise(fallback)


def with_scenario(metrics: DataFrame, **registry) -> DataFrame:
    """Add the scenario columns to a table with ``folder`` and ``stem``."""
    found = scenario_of(F.col("stem"), F.col("folder"), **registry)
    return metrics.withColumn("__found", found).select("*", "__found.*").drop("__found")


def _project(metrics: DataFrame, columns) -> DataFrame:
    present = [(m, title) for m, title in columns if m in metrics.columns]
    return metrics.select(*ID_COLUMNS, *[F.col(m).alias(title) for m, title in present])


def main_table(metrics: DataFrame) -> DataFrame:
    """Identifying columns and the nine main metrics under their headings."""
    return _project(metrics, MAIN_METRICS)


def focus_table(metrics: DataFrame, name: str | None = None, suffix: str | None = None) -> DataFrame:
    """The first four main metrics and the metrics of one class."""
    chosen = focus_metrics(name, suffix or name) if name else focus_metrics()
    return _project(metrics, (*MAIN_METRICS[:4], *chosen))


def in_table_order(table: DataFrame) -> DataFrame:
    """Rows sorted by group and scenario, with their position and whether a new group starts."""
    order = Window.orderBy("group", "scenario", "method")
    return table.withColumns(
        {
            "position": F.row_number().over(order),
            "new_group": F.coalesce(F.lag("group").over(order) != F.col("group"), F.lit(False)),
        }
    ).orderBy("position")


def melted(metrics: DataFrame, ids: Sequence[str], names: Sequence[str], missing: float | None = None) -> DataFrame:
    """Long form ``(ids…, metric, value)``; ``missing`` replaces NULL and NaN."""
    value = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    long = metrics.unpivot(list(ids), list(names), "metric", "value")
    filled = value if missing is None else F.coalesce(value, F.lit(missing))
    return long.withColumn("value", filled)


def best_flags(metrics: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mark every value that equals the best of its metric; a missing value never is."""
    top = F.max("value").over(Window.partitionBy("metric"))
    long = melted(metrics, ids, names)
    return long.withColumns(
        {"cell": metric_cell(F.col("value")), "is_best": F.coalesce(F.col("value") == top, F.lit(False))}
    )


def comparison_table(metrics: DataFrame, names: Sequence[str], system: str = "system") -> DataFrame:
    """One row per system with formatted cells; missing values read N/A."""
    return metrics.select(
        F.col(system).alias("model"), *[metric_cell(F.col(m), "N/A").alias(m) for m in names]
    )


def rank_models(metrics: DataFrame, system: str = "system") -> DataFrame:
    """Position by macro F1, then weighted F1, then name."""
    order = Window.orderBy(F.desc("f1_macro"), F.desc("f1_weighted"), F.asc(system))
    return metrics.withColumn("position", F.row_number().over(order))

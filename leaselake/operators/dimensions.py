"""Dimension upkeep: membership, newest change per key, upsert and delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake import schemas as S
from leaselake.operators.projections import pruned, row_image


def row_changes(changes: DataFrame) -> DataFrame:
    """Changes without the markers that open and close a bootstrap."""
    return changes.where(~F.col("type").isin(*S.BOOTSTRAP_MARKERS))


def dimension_changes(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes of configured tables with their configuration: ``sink_table``,
    ``sink_row_key`` and ``row`` cut to the configured columns. A join that filters
    and supplies at once; the optimizer broadcasts the configuration by its size."""
    found = row_changes(changes).join(config, F.col("table") == F.col("source_table"))
    return pruned(row_image(found)).select("sink_table", "sink_row_key", "type", *S.POSITION, "row")


def newest_per_key(changes: DataFrame) -> DataFrame:
    """The last change of each key of each target, in log order. Changes whose row
    has no key are dropped, since nothing could be written for them."""
    keyed = changes.withColumn("key", F.col("row")[F.col("sink_row_key")]).where(F.col("key").isNotNull())
    last = F.max_by(F.struct("type", "row"), F.struct(*S.POSITION)).alias("e")
    return keyed.groupBy("sink_table", "key").agg(last).select("sink_table", "key", "e.type", "e.row")


def dimension_rows(changes: DataFrame, columns: str) -> DataFrame:
    """``newest_per_key`` of one target as plain columns, nulls as empty strings,
    with ``key`` and ``deleted``."""
    names = [c.strip() for c in columns.split(",")]
    cells = [F.coalesce(F.col("row")[c], F.lit("")).alias(c) for c in names]
    return changes.select("key", (F.col("type") == "delete").alias("deleted"), *cells)


def applied(current: DataFrame, changed: DataFrame) -> DataFrame:
    """The dimension table after ``changed`` (``key``, ``deleted``, columns): the
    changed keys leave, those not deleted come back with their new row."""
    keys = changed.select(F.col("key").alias("_changed"))
    kept = current.join(keys, current["key"] == keys["_changed"], "left_anti")
    return kept.unionByName(changed.where(~F.col("deleted")).drop("deleted"))


def column_names(sink_columns: str) -> list[str]:
    names = [c.strip() for c in (sink_columns or "").split(",") if c.strip()]
    if not names:
        raise ValueError("a dimension table needs columns")
    return names


def config_actions(changes: DataFrame) -> list[tuple[str, list[str] | None, bool]]:
    """What a batch of configuration changes comes to, by target: (table, columns,
    whether it was dropped before), columns None if it is gone at the end. r and c
    create, d drops, u creates the new one and drops the old one if the target's name
    changed. Changes of one time: deletes first, then by their text. The configuration
    is a handful of rows."""
    last: dict[str, tuple[list[str] | None, bool]] = {}
    for e in changes.orderBy("ts_ms", F.col("op") != "d", F.to_json(F.struct("before", "after"))).select("op", "before", "after").toLocalIterator():
        if e["op"] in ("r", "c", "u"):
            new = e["after"]["sink_table"]
            last[new] = (column_names(e["after"]["sink_columns"]), last.get(new, (None, False))[1])
        gone = e["before"]["sink_table"] if e["before"] is not None else None
        if gone and (e["op"] == "d" or (e["op"] == "u" and gone != e["after"]["sink_table"])):
            last[gone] = (None, True)
    return [(table, *found) for table, found in last.items()]


def flattened(tree: DataFrame, name: str, parent: str, prefix: str, levels: int = 3) -> DataFrame:
    """Each node with its ancestors: ``{prefix}3_id, {prefix}3_name, {prefix}2_id,
    ...`` up to level 1. A missing parent leaves null names above it, and a parent
    that is named but not there keeps its id."""
    own = tree.select(F.col("id").alias(f"{prefix}{levels}_id"), F.col(name).alias(f"{prefix}{levels}_name"), F.col(parent).alias("_up"))
    for level in range(levels - 1, 0, -1):
        above = tree.select(F.col("id").alias("_id"), F.col(name).alias(f"{prefix}{level}_name"), F.col(parent).alias("_next"))
        own = own.join(above, own["_up"] == above["_id"], "left").withColumn(f"{prefix}{level}_id", F.col("_up")).drop("_up", "_id").withColumnRenamed("_next", "_up")
    order = [f"{prefix}{n}_{x}" for n in range(levels, 0, -1) for x in ("id", "name")]
    return own.select(*order)


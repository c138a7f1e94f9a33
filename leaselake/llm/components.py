"""Connected components of a link table, by alternating star contraction.

Each round joins every node to the smallest node of its neighbourhood, first
towards larger neighbours and then towards smaller ones, until the link table is
a set of stars. The rounds are logarithmic in the length of the longest chain;
each one is written to the shared folder, so lineage stays short and lost
executors cost one re-read. Keys that very many rows share (the centre of a large
star, the root of a giant component) are joined by a broadcast of those few keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake.llm.staging import drop_staged, stage

#: Rows of one key that a single task may join.
ROWS_PER_KEY = 1000
#: Most keys that ``join_spread`` broadcasts.
KEYS_BROADCAST = 100_000


def join_spread(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``values``, which has one row a key and says in
    ``n_rows`` how many of the ``total`` rows carry it.

    The values of a key of more than ``ROWS_PER_KEY`` and more than one in
    ``KEYS_BROADCAST`` of all rows are broadcast; there are at most
    ``KEYS_BROADCAST`` such keys, whatever the size. Rows of such a key are dealt
    by a hash of all their columns, the others by their key.
    """
    if total <= ROWS_PER_KEY:  # no key can be over it
        return rows.join(values.drop("n_rows"), key)
    names = [c for c in values.columns if c not in (key, "n_rows")]
    often = F.col("n_rows") > max(ROWS_PER_KEY, total // KEYS_BROADCAST)
    hot = values.where(often).select(F.col(key).alias("_hot"), F.struct(*names).alias("_early"))
    rest = values.where(~often).select(F.col(key).alias("_rest"), F.lit(-1).cast("long").alias("_deal"), F.struct(*names).alias("_late"))
    known = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left")
    found = F.col("_hot").isNotNull()
    known = known.withColumns({"_key": F.when(~found, F.col(key)), "_deal": F.when(found, F.abs(F.xxhash64(*rows.columns) % 1_000_003)).otherwise(-1)})
    both = known.join(rest, known["_deal"].eqNullSafe(rest["_deal"]) & known["_key"].eqNullSafe(rest["_rest"]), "left")
    value = F.coalesce("_early", "_late")
    return both.where(value.isNotNull()).select(*rows.columns, *[value[n].alias(n) for n in names])


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` to ``(node, root)``: root is the smallest node reachable.

    Only nodes that have a link and are not themselves a root are returned; a
    node that is absent is its own root. Loops, repeated links and links with a
    null end are ignored; an empty table gives an empty result.
    """
    links = (
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    current = stage(links, "cc")
    state = _state(current)
    while state[0]:
        after = stage(_small_star(_large_star(current, state[0]), state[0]), "cc")
        drop_staged(current)
        current, before, state = after, state, _state(after)
        if state == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def name_components(classes: DataFrame, links: DataFrame, class_col: str = "class", id_col: str = "least") -> DataFrame:
    """``classes`` with ``component_id``, the smallest ``id_col`` among the classes
    reachable through ``links(u, v)``, and ``component_size``, how many these are;
    null ids are passed over. ``classes`` is a written table with one row a class."""
    roots = stage(connected_components(links).select(F.col("node").alias(class_col), F.col("root").alias("_root")), "cc-roots")
    total = roots.count()
    if not total:
        return classes.withColumns({"component_id": F.col(id_col), "component_size": F.lit(1).cast("long")})
    tops = roots.select(F.col("_root").alias(class_col)).distinct().withColumn("_root", F.col(class_col))
    rooted = stage(classes.select(class_col, id_col).join(roots.unionByName(tops), class_col), "cc-rooted")
    smallest = rooted.groupBy("_root").agg(F.min(id_col).alias("_smallest"), F.count(F.lit(1)).alias("_size"), F.count(F.lit(1)).alias("n_rows"))
    named = join_spread(rooted.select(class_col, "_root"), smallest, "_root", total).select(class_col, "_smallest", "_size")
    component = F.when(F.col("_size").isNotNull(), F.col("_smallest")).otherwise(F.col(id_col))
    sized = {"component_id": component, "component_size": F.coalesce("_size", F.lit(1).cast("long"))}
    return classes.join(named, class_col, "left").withColumns(sized).drop("_smallest", "_size")


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"), F.count(F.lit(1)).alias("n_rows"))
    return (
        join_spread(both, low, "u", total)
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .distinct()
    )


def _small_star(links: DataFrame, total: int) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n_rows"))
    moved = join_spread(links, low, "u", total).where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    # links are distinct, so the hashes do not cancel out; unlike a sum, no count of them overflows
    row = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]

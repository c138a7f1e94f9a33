"""Bounded samples of labelled texts, for models that are fitted in one process."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fitting(sizes: pd.DataFrame, group: str, chars: int) -> pd.DataFrame:
    """Rows of ``sizes(_id, group, _h, n, copies)`` whose texts fit, with ``_take``,
    the characters to take of each: all of them, in order of ``_h``, a text that does
    not fit being passed over. A group whose texts are all too long keeps the
    beginning of its shortest one, so that no group is lost."""
    kept = []
    for _, rows in sizes.sort_values([group, "_h", "_id"]).groupby(group, sort=False):
        used, fits = 0, []
        for i, n in zip(rows.index, rows["n"], strict=True):
            if used + n <= chars:
                used += n
                fits.append(i)
        take = rows.loc[fits].assign(_take=chars)
        if not fits:
            shortest = rows.sort_values(["n", "_h", "_id"]).iloc[:1]
            take = shortest.assign(_take=chars // shortest["copies"])
        kept.append(take)
    return pd.concat(kept) if kept else sizes.assign(_take=0)


def bounded_texts(texts: DataFrame, picks: DataFrame, group: str, chars: int, on: list[str] | None = None) -> DataFrame:
    """Rows of ``texts(_id, text, ...)`` that ``picks(_id, group, _h)`` names (by the
    columns ``on``), as ``fitting`` says, at most ``chars`` characters a group.

    ``picks`` is bounded by the caller and broadcast; lengths alone come to the
    driver, and the result holds the texts that fit.
    """
    on = on or ["_id"]
    size = F.coalesce(F.length("text"), F.lit(0))
    found = texts.join(F.broadcast(picks), on).groupBy("_id", group, "_h").agg(F.sum(size).alias("n"), F.count(F.lit(1)).alias("copies")).toPandas()
    few = fitting(found, group, chars)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picks.select("_id", group).schema) + ", _take int"
    rows = texts.sparkSession.createDataFrame(list(few[["_id", group, "_take"]].itertuples(index=False, name=None)), kinds)
    return texts.join(F.broadcast(rows), on).withColumn("text", F.substring("text", F.lit(1), F.col("_take"))).drop("_take")

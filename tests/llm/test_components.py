"""Connected components of link tables of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaselake.llm.components import _state, name_components


def test_state_of_many_links(spark):
    """A sum of 40-bit hashes left a bigint at about 16.8 million links."""
    links = spark.range(17_600_000).select((F.col("id") + 1).alias("u"), F.lit(0).cast("long").alias("v"))
    n, h = _state(links)
    assert n == 17_600_000 and (n, h) == _state(links.repartition(3))
    assert _state(links.limit(0)) == (0, 0) and _state(links.where("u < 9")) != _state(links.where("u BETWEEN 2 AND 9"))


def test_large_star_and_names(spark):
    """The centre of a star and the root of a giant component go by broadcast."""
    edges = spark.range(1, 5000).select(F.col("id").alias("u"), F.when(F.col("id") < 4950, 0).otherwise(F.col("id") - 1).alias("v"))
    classes = spark.range(-3, 5000).select(F.col("id").alias("class"), F.when(F.col("id") != 0, F.col("id") + 10_000).alias("least"))
    named = {r["class"]: r["component_id"] for r in name_components(classes, edges).collect()}
    assert named == {c: 10_001 if c >= 0 else c + 10_000 for c in range(-3, 5000)}

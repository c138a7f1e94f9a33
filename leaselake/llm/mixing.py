"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every source gets a target number of words: its share, by weight, of
``fraction`` times all words, but at most ``max_repeat`` times its own words; what
is cut off there goes to the other sources by weight, until none is above.

A document of source s is expected ``target(s) / words(s)`` times. Expected copies
are summed along the source's documents, one offset in [0, 1) is added, and a
document is taken once for each whole number that its step crosses. The documents
stand in order of size, so the words taken come near the target even where sizes
differ widely. The running sum is built from three levels (size class and salt
within source, then rows within that group), so no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaselake.llm.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SALTS = 64
#: Offsets are multiples of this, so that adding one to a whole number is exact.
OFFSETS = 1 << 20


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, fraction: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)``, one row a source, plus ``target``.

    Weights repeat along the sources in code point order, null last. With caps
    ``c`` and weights ``w``, the level at which the shares settle caps exactly the
    sources of smallest ``c / w``, so one sorted pass replaces the rounds.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    ranked = sizes.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(fraction)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", left / weight_left)
    # before the first uncapped source the level rises, after it falls: its own is the largest
    settled = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(everything)
    return leveled.select(
        "source",
        "source_size",
        F.when(settled.isNull() | (F.col("ratio") <= settled), F.col("cap")).otherwise(settled * F.col("w")).alias("target"),
    )


def _unit(key: Column, seed: int) -> Column:
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(OFFSETS)) / F.lit(float(OFFSETS))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    fraction: float = 1.5,
    max_repeat: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """One row per document: ``id_col``, ``source``, ``size`` (words),
    ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size).

    Null is a source of its own, and so is the empty string. Null or wordless
    texts have size 0 and take nothing. Rows with a null or repeated id are rows
    like any other. A source without words has target 0. Reruns give the same
    rows; an empty table gives an empty result; other columns are ignored.
    """
    # one pass over the texts; all that follows works on four narrow columns
    sized = stage(
        docs.select(F.col(id_col).alias("_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
        .withColumn("bin", _size_class(F.col("size")))
        .withColumn("salt", F.pmod(F.coalesce(F.conv(F.substring(F.md5(F.col("_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(0)), F.lit(SALTS)).cast("int")),
        "mix-sizes",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source, weights, fraction, max_repeat)
    groups = sized.groupBy("source", "bin", "salt").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("source").orderBy("bin", "salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source", "bin", "salt", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("earlier"))
    planned = groups.join(targets, groups["source"].eqNullSafe(targets["source"])).select(
        groups["source"].alias("g_source"), F.col("bin").alias("g_bin"), F.col("salt").alias("g_salt"), "earlier", "source_size", "target"
    )
    within = Window.partitionBy("source", "bin", "salt").orderBy("_id", "size")
    placed = sized.withColumn("k", F.row_number().over(within)).join(
        planned,
        F.col("source").eqNullSafe(F.col("g_source")) & (F.col("bin") == F.col("g_bin")) & (F.col("salt") == F.col("g_salt")),
    )
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")), seed)
    end = F.col("earlier") + F.col("k")
    crossed = F.floor(expected * end + offset) - F.floor(expected * (end - 1) + offset)
    return placed.withColumn("copies", crossed.cast("long")).select(
        F.col("_id").alias(id_col),
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def _size_class(size: Column) -> Column:
    """16 classes for each doubling of the size: its bit length and leading bits."""
    more = size + F.lit(1)
    bits = F.length(F.bin(more))
    return bits * F.lit(32) + F.call_function("shiftright", more * F.lit(32), bits).cast("int")


def expand_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row repeated as often as ``mixed`` takes it: rows of no
    copies go. ``id_col`` must name a row; where an id is repeated, its rows take
    the largest number of copies any of them has. Null ids are matched too."""
    copies = mixed.groupBy(F.col(id_col).alias("_id")).agg(F.max("copies").alias("_copies")).where(F.col("_copies") > 0)
    joined = docs.join(copies, docs[id_col].eqNullSafe(copies["_id"]))
    row = F.struct(*[docs[c] for c in docs.columns])
    return joined.select(F.explode(F.array_repeat(row, copies["_copies"].cast("int"))).alias("row")).select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), placed AS (
  SELECT *, CAST(length(bin(size + 1)) * 32 + ((size + 1) * 32 >> length(bin(size + 1))) AS INT) AS bin,
    CAST(coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT), 0) % 64 AS INT) AS salt FROM sized
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
    source_size * 2.0::DOUBLE AS cap FROM per_source
), leveled AS (
  SELECT *, cap / w AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), settled AS (
  SELECT *, max(CASE WHEN level < ratio THEN level END) OVER () AS level_kept FROM leveled
), targets AS (
  SELECT source, source_size, CASE WHEN level_kept IS NULL OR ratio <= level_kept THEN cap ELSE level_kept * w END AS target FROM settled
), numbered AS (
  SELECT p.doc_id, p.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY p.source ORDER BY p.bin, p.salt, p.doc_id NULLS FIRST, p.size) AS place,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS expected,
    (CAST('0x' || substr(md5('7:' || coalesce('s' || p.source, 'null')), 1, 8) AS BIGINT) % 1048576) / 1048576.0::DOUBLE AS u
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(expected * place + u) - floor(expected * (place - 1) + u)) * size AS BIGINT) AS taken
FROM numbered
"""

"""Hard negatives by angular triangle filtering.

Vectors become whole numbers, ``floor(256 * x)``, and a score is the inner product
with an anchor, a whole number too. For each anchor the nearest rows of its label
are its positives, and for each positive the negatives are the best rows of other
labels whose score lies in a window below the positive's.

Every vector is stored with its norm and its angles to a few reference directions.
Two vectors with angles s and t to one direction stand at an angle between
``|s - t|`` and ``min(s + t, 2 pi - s - t)``; the tightest of these over all
directions, as cosines times both norms and rounded outwards, bound their score.
Only rows whose bounds overlap what an anchor still looks for are scored. The
bounds are used twice: for a group of rows with near angles at once, and then row
by row. Directions are fitted on a bounded sample; they change the work, never
the result.

Anchors are a stated set of queries and run against all rows in blocks: a block is
broadcast, each task keeps the best few per anchor and window, and a window over
these few makes the result. So nothing depends on how many rows share a label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaselake.llm.staging import new_path, stage

SCALE = 256
#: Anchors are rows whose id is divisible by the first; the second picks relabelled rows.
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
#: A negative's score is this many hundredths of its positive's at least.
LEAST_PERCENT = 80
REFERENCES = 8
#: Rows that the directions are fitted on, and the longest vector among them.
SAMPLE, SAMPLE_LENGTH = 2000, 4096
#: Bytes of one block of anchors, and anchors in it.
BLOCK_BYTES, BLOCK = 16 << 20, 4096
#: Rows whose angles are bounded together, and rows read at once.
GROUP, ROWS = 64, 1024
#: Squares of norms up to which all scores fit a long, and a double exactly.
LONG_SQUARE, DOUBLE_SQUARE = 2.0**62, 2.0**52
SLACK = 1e-6
STORED = "vec_id long, label long, q array<long>, norm double, angles array<double>"


def quantised(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE)


def fitted_directions(sample: list[np.ndarray], count: int = REFERENCES, seed: int = 11) -> dict[int, np.ndarray]:
    """Unit directions by length of vector: centres of a spherical k-means over a
    bounded sample, made up to ``count`` by directions drawn at random."""
    found = {}
    for dim in sorted({len(x) for x in sample}):
        rows = np.array([x for x in sample if len(x) == dim], float)
        rows = rows[np.linalg.norm(rows, axis=1) > 0]
        drawn = drawn_directions(dim, count, seed)
        if dim and len(rows):
            rows /= np.linalg.norm(rows, axis=1)[:, None]
            k = min(count, len(rows))
            centres = rows[np.random.default_rng(seed).permutation(len(rows))[:k]]
            for _ in range(8):
                nearest = np.argmax(rows @ centres.T, axis=1)
                sums = np.zeros_like(centres)
                np.add.at(sums, nearest, rows)
                norms = np.linalg.norm(sums, axis=1)
                centres = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], centres)
            drawn[:k] = centres
        found[dim] = drawn
    return found


def drawn_directions(dim: int, count: int, seed: int) -> np.ndarray:
    out = np.random.default_rng(seed + dim).normal(size=(count, dim))
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None] if dim else out


def angles_to(q: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of rows to directions; a zero row stands at a right angle to all."""
    cosines = (q @ directions.T) / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def prepared(vectors: DataFrame, id_col: str, vector: str, label: str, directions: dict[int, np.ndarray], count: int) -> DataFrame:
    """Rows that take part, as ``STORED``: whole numbers, norm and angles."""
    value = F.col("_v")
    odd = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # whole-number labels wrap at LABELS where the id says so
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") % LABELS + 1) % LABELS).otherwise(F.col("label"))
    whole = (
        vectors.select(vectors[id_col].try_cast("long").alias("vec_id"), vectors[label].try_cast("long").alias("label"), vectors[vector].cast("array<double>").alias("_v"))
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & value.isNotNull() & ~odd)
        .select("vec_id", moved.alias("label"), F.transform(value, lambda x: F.floor(x * SCALE)).alias("q"))
    )

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q")
            sizes = np.diff(q.offsets.to_numpy())
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                rows = rows_of(q.take(pa.array(at)), dim).astype(np.float64)
                norms = np.sqrt((rows * rows).sum(axis=1))
                fits = norms * norms <= LONG_SQUARE
                at, rows, norms = at[fits], rows[fits], norms[fits]
                to = directions.get(int(dim))
                angles = angles_to(rows, norms, to if to is not None else drawn_directions(int(dim), count, 11))
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), kept.column("q"), pa.array(norms), lists(angles)], ["vec_id", "label", "q", "norm", "angles"])

    # magnitudes beyond a long would wrap when floored: such rows cannot fit either
    small = F.forall(F.col("q"), lambda x: F.abs(x) < (1 << 31))
    return whole.where(small).mapInArrow(stored, STORED)


def rows_of(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


@dataclass
class Anchors:
    """A block of anchors of one length, sorted by nothing in particular; a row's
    place in it is the anchor's number."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    norms: np.ndarray
    angles: np.ndarray


def score_bounds(norms: np.ndarray, angles: np.ndarray, row_norms: tuple[np.ndarray, np.ndarray], row_angles: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each anchor with rows, or groups of rows, whose
    norms and angles lie between the first and the second of each pair."""
    (short, long), (least, most) = row_norms, row_angles
    near = np.zeros((len(norms), len(long)))
    far = np.full_like(near, np.pi)
    for k in range(angles.shape[1]):
        a, lo, hi = angles[:, k, None], least[None, :, k], most[None, :, k]
        np.maximum(near, np.maximum(a - hi, lo - a), out=near)
        # a + t peaks at pi: a group that spans pi - a can reach the whole half turn
        np.minimum(far, np.where(a + hi <= np.pi, a + hi, np.where(a + lo >= np.pi, 2 * np.pi - a - lo, np.pi)), out=far)
    low, high = np.cos(np.minimum(far + SLACK, np.pi)), np.cos(np.maximum(near - SLACK, 0.0))
    low = np.where(low < 0, low * long, low * short) * norms[:, None]
    high = np.where(high > 0, high * long, high * short) * norms[:, None]
    return low - np.abs(low) * 1e-9 - 1, high + np.abs(high) * 1e-9 + 1


def exact_scores(anchors: np.ndarray, rows: np.ndarray, bound: float) -> np.ndarray:
    """Whole-number inner products: in doubles where every sum is exact in them."""
    if bound <= DOUBLE_SQUARE:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


class Best:
    """The best few (score, id) of each key, by score descending and then id."""

    def __init__(self, keys: int, few: int):
        self.few, self.held = few, np.zeros((0, 3), np.int64)
        self.least = np.full(keys, np.iinfo(np.int64).min)

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        wanted = scores >= self.least[keys]
        if not wanted.any():
            return
        rows = np.vstack([self.held, np.column_stack([keys[wanted], scores[wanted], ids[wanted]])])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        self.held = rows[place < self.few]
        full = rows[place == self.few - 1]
        self.least[full[:, 0]] = full[:, 1]


def _search(block: Anchors, windows: np.ndarray | None, few: int):
    """A function over batches of stored rows. Without ``windows`` it finds rows of
    the anchor's label, else (anchors, windows, 2) scores from and to, of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, dim = block.q.shape
        slots = 1 if windows is None else windows.shape[1]
        best = Best(n * slots, few)
        top = np.full(n, np.iinfo(np.int64).max) if windows is None else windows[:, :, 1].max(axis=1)
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(np.diff(batch.column("q").offsets.to_numpy()) == dim)))
            step = max(1, min(ROWS, BLOCK_BYTES // (8 * max(dim, 1))))
            for start in range(0, batch.num_rows, step):
                _tile(block, windows, best, top, batch.slice(start, step))
        held = best.held
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0] // slots), pa.array(held[:, 0] % slots), pa.array(held[:, 1]), pa.array(held[:, 2])], ["anchor", "slot", "score", "id"])

    return run


def _tile(block: Anchors, windows: np.ndarray | None, best: Best, top: np.ndarray, batch: pa.RecordBatch) -> None:
    angles = rows_of(batch.column("angles"), block.angles.shape[1])
    order = np.lexsort((angles.min(axis=1), np.argmin(angles, axis=1)))  # near rows side by side
    angles, q = angles[order], rows_of(batch.column("q"), block.q.shape[1])[order]
    ids, labels, norms = (batch.column(c).to_numpy(zero_copy_only=False)[order] for c in ("vec_id", "label", "norm"))
    least = best.least if windows is None else np.maximum(best.least.reshape(windows.shape[:2]), windows[:, :, 0]).min(axis=1)
    starts = np.arange(0, len(ids), GROUP)
    ends = [(np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)) for x in (norms, angles)]
    low, high = score_bounds(block.norms, block.angles, *ends)
    near = (high >= least[:, None]) & (low <= top[:, None])
    for g, start in enumerate(starts):
        some = np.flatnonzero(near[:, g])
        part = slice(start, start + GROUP)
        low, high = score_bounds(block.norms[some], block.angles[some], (norms[part], norms[part]), (angles[part], angles[part]))
        overlap = (high >= least[some, None]) & (low <= top[some, None])
        same = block.labels[some, None] == labels[None, part]
        overlap &= (same if windows is None else ~same) & (block.ids[some, None] != ids[None, part])
        rows = np.flatnonzero(overlap.any(axis=0))
        used = np.flatnonzero(overlap.any(axis=1))
        if not len(rows):
            continue
        scores = exact_scores(block.q[some[used]], q[part][rows], float(block.norms[some[used]].max() * norms[part][rows].max()))
        hits = overlap[np.ix_(used, rows)] & (scores >= least[some[used], None]) & (scores <= top[some[used], None])
        a, r = np.nonzero(hits)
        number, score, row_id = some[used][a], scores[a, r], ids[part][rows][r]
        if windows is None:
            best.add(number, score, row_id)
            least = best.least
            continue
        slots = windows.shape[1]
        inside = (windows[number, :, 0] <= score[:, None]) & (score[:, None] <= windows[number, :, 1])
        k, slot = np.nonzero(inside)
        best.add(number[k] * slots + slot, score[k], row_id[k])
        least = np.maximum(best.least.reshape(windows.shape[:2]), windows[:, :, 0]).min(axis=1)


def _ranked(found: DataFrame, few: int) -> DataFrame:
    by = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= few)


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = LEAST_PERCENT,
    references: int = REFERENCES,
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null id, a null label, a null vector, or any null or non-finite
    component take no part; nor do vectors whose squared norm, as whole numbers,
    passes 2**62, since their scores need not fit a long. A row's score is defined
    with rows of the same length only; a vector without components scores 0. Rows
    that carry the anchor's id are not its positives or negatives; a row that is
    there twice is two rows (and two anchors), and ties go to the smaller id. A
    positive of negative score has no window. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    sample = vectors.select(vectors[id_col].try_cast("long").alias("i"), vectors[vector].cast("array<double>").alias("v")).where(f"size(v) <= {SAMPLE_LENGTH} AND forall(v, x -> x IS NOT NULL AND abs(x) < 1e6)")
    picked = [np.array(r["v"]) for r in sample.orderBy(F.xxhash64("i"), "i").limit(SAMPLE).collect()]
    stored = stage(prepared(vectors, id_col, vector, label, fitted_directions(picked, references), references), "hn-vectors")
    asking = stored.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    lengths = {r["d"]: r["n"] for r in asking.groupBy(F.size("q").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()}
    path, out = new_path(spark, "hn-found"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], out).write.parquet(path)
    for dim, count in lengths.items():
        blocks = -(-count // max(1, min(block, BLOCK_BYTES // (8 * max(dim, 1)))))
        for b in range(blocks):
            mine = asking.where((F.size("q") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b))
            found = _block_negatives(stored, _anchors(mine.toPandas(), dim, references), positives, negatives, least_percent)
            if found is not None:
                found.write.mode("append").parquet(path)
    return spark.read.schema(out).parquet(path)


def _anchors(rows: pd.DataFrame, dim: int, references: int) -> Anchors:
    q = np.array([np.asarray(x, np.int64) for x in rows["q"]], np.int64).reshape(len(rows), dim)
    angles = np.array([np.asarray(x, float) for x in rows["angles"]]).reshape(len(rows), references)
    return Anchors(rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), q, rows["norm"].to_numpy(float), angles)


FOUND = "anchor long, slot long, score long, id long"


def _block_negatives(stored: DataFrame, anchors: Anchors, positives: int, negatives: int, least_percent: int) -> DataFrame | None:
    """The result of one block of anchors."""
    if not len(anchors.ids):
        return None
    spark = stored.sparkSession
    near = _ranked(stored.mapInArrow(_search(anchors, None, positives), FOUND), positives).toPandas()
    if near.empty:
        return None
    windows = np.empty((len(anchors.ids), positives, 2), np.int64)
    windows[:, :, 0], windows[:, :, 1] = np.iinfo(np.int64).max, np.iinfo(np.int64).min  # a slot without a positive
    number, slot, score = (near[c].to_numpy(np.int64) for c in ("anchor", "rank", "score"))
    slot = slot - 1
    lowest = [-(-least_percent * int(s) // 100) for s in score]  # whole numbers of any size
    windows[number, slot, 0], windows[number, slot, 1] = lowest, score
    found = _ranked(stored.mapInArrow(_search(anchors, windows, negatives), FOUND), negatives)
    pairs = pd.DataFrame({"anchor": number, "slot": slot, "anchor_id": anchors.ids[number], "positive_id": near["id"], "positive_score": score})
    known = spark.createDataFrame(pairs, "anchor long, slot long, anchor_id long, positive_id long, positive_score long")
    named = found.join(F.broadcast(known), ["anchor", "slot"])  # at most a block of anchors times its positives
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label % 10 + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INT) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""

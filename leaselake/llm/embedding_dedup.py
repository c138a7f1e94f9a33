"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables,
and a rerank with the original vectors.

Rotations are learned (on a bounded sample) so that the signs of the rotated
vectors are balanced codes close to the vectors. Each table of the index looks at
one short substring of the code; vectors that agree on it meet in a bucket. The
substring length follows from the number of vectors, so that buckets stay small,
and the number of tables from that length, so that two vectors at the threshold
meet in at least one table with the wanted probability.

Only codes go through the tables. In a bucket, codes within a Hamming budget (three
deviations above the mean of pairs at the threshold) make their vectors candidates;
the vectors of candidates alone are fetched, and cosines are computed in double
precision. Equal vectors are one class before anything is compared. A pair that
meets in several tables counts in the first of them only, so link counts are sums
and no pair is ever emitted; links leave a bucket as a spanning forest. A bucket
over ``block`` rows is dealt out as pairs of blocks, each a task's piece of work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake.llm.components import join_spread, name_components
from leaselake.llm.staging import stage

FOUND = "class long, other long, links long"


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 50, seed: int = 5) -> np.ndarray:
    """Iterative quantisation of unit vectors: projection to ``bits`` numbers.

    Principal directions first, then alternate between signs and the orthogonal
    rotation that brings the projections closest to them. Nothing is centred: the
    planes go through the origin, so that bits differ with the angle, as cosines
    do, also where all vectors lie close together.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    values, vectors = np.linalg.eigh(sample.T @ sample + 1e-12 * np.eye(dim))
    main = vectors[:, np.argsort(-values)[: min(bits, dim)]]
    v = sample @ main
    rotation = np.linalg.qr(rng.normal(size=(main.shape[1], main.shape[1])))[0]
    for _ in range(rounds if len(sample) else 0):
        signs = np.where(v @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ v)
        rotation = (left @ right).T
    return main @ rotation


def learn_projection(sample: np.ndarray, bits: int, seed: int = 5) -> np.ndarray:
    """Rotations side by side until they give ``bits`` numbers; vectors that are
    shorter than that need several, from different starts."""
    parts, have = [], 0
    while have < bits:
        # later ones stop early: after many rounds all starts end alike
        parts.append(learn_rotation(sample, bits - have, 50 if not parts else 3, seed + len(parts)))
        have += parts[-1].shape[1]
    return np.hstack(parts)


def hamming_budget(bits: int, threshold: float) -> int:
    """Differing bits that a pair at the threshold stays under, but for one in 700."""
    share = math.acos(min(1.0, threshold)) / math.pi
    return math.ceil(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


def encode(unit: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes of unit vectors, 64 bits to a column of unsigned numbers, bit 0 first."""
    on = (unit @ projection >= 0).astype(np.uint64)
    places = np.arange(64, dtype=np.uint64)
    return np.column_stack([(on[:, at : at + 64] << places[: on.shape[1] - at]).sum(axis=1, dtype=np.uint64) for at in range(0, on.shape[1], 64)])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of codes, along the last axis."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def tables_needed(bits: int, length: int, threshold: float, miss: float) -> int:
    """Tables of which two vectors at the threshold meet in none with probability
    ``miss``. The number of bits in which they differ varies from pair to pair, so
    the chance is that over all such numbers."""
    share = math.acos(min(1.0, threshold)) / math.pi
    chance = [math.comb(bits, d) * share**d * (1 - share) ** (bits - d) for d in range(bits + 1)]
    meet = [math.comb(bits - d, length) / math.comb(bits, length) for d in range(bits + 1)]
    low, high = 1, 1 << 20
    while low < high:
        tables = (low + high) // 2
        missed = sum(c * (1 - m) ** tables for c, m in zip(chance, meet, strict=True))
        low, high = (low, tables) if missed <= miss else (tables + 1, high)
    return low


def table_masks(n: int, bits: int, threshold: float, miss: float = 0.04, bucket: int = 512, seed: int = 11) -> list[tuple[int, ...]]:
    """Bit masks of the tables, one number for 64 bits: substrings of permuted codes."""
    b = min(bits, max(8, math.ceil(math.log2(max(2, n) / bucket))))
    rng, masks, order = np.random.default_rng(seed), [], []
    while len(masks) < tables_needed(bits, b, threshold, miss):
        if len(order) < b:  # a permutation gives disjoint substrings
            order = rng.permutation(bits).tolist()
        mine = [order.pop() for _ in range(b)]
        masks.append(tuple(sum(1 << x - at for x in mine if at <= x < at + 64) for at in range(0, bits, 64)))
    return masks


def _agree(differ: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    return (differ & np.array(mask, np.uint64) == 0).all(axis=-1)


def links_within(ids: np.ndarray, codes: np.ndarray, unit: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, earlier: list[tuple[int, ...]], threshold: float, budget: int = 128, step: int = 1024):
    """(class, other, links): for each class how many vectors of other classes it
    links to, and a spanning forest of the links (``other``), over pairs of rows
    from ``left`` x ``right`` (row numbers; the same array: each pair once).
    Pairs whose codes differ in more than ``budget`` bits do not count, and those
    that met in an earlier table (equal on its mask) do not count again."""
    links = np.zeros(len(ids), np.int64)
    label = np.arange(len(ids))
    own = left is right
    for a in range(0, len(left), step):
        rows = left[a : a + step]
        for b in range(a if own else 0, len(right), step):
            cols = right[b : b + step]
            near = unit[rows] @ unit[cols].T >= threshold
            if own and a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = rows[i], cols[j]
            differ = codes[i] ^ codes[j]
            first = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= budget
            for mask in earlier:
                first &= ~_agree(differ, mask)
            i, j = i[first], j[first]
            np.add.at(links, i, sizes[j])
            np.add.at(links, j, sizes[i])
            while len(i):
                low = np.minimum(label[i], label[j])
                np.minimum.at(label, label[i], low)
                np.minimum.at(label, label[j], low)
                while (label[label] != label).any():
                    label = label[label]
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
    rows = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
    return ids[rows], ids[label[rows]], links[rows]


def near_codes(codes: np.ndarray, left: np.ndarray, right: np.ndarray, budget: int, step: int = 1024) -> np.ndarray:
    """Which rows have another one within the budget, over pairs from ``left`` x ``right``."""
    near = np.zeros(len(codes), bool)
    own = left is right
    for a in range(0, len(left), step):
        rows = left[a : a + step]
        for b in range(a if own else 0, len(right), step):
            cols = right[b : b + step]
            close = apart(codes[rows][:, None], codes[cols][None, :]) <= budget
            if own and a == b:
                np.fill_diagonal(close, False)
            near[rows] |= close.any(axis=1)
            near[cols] |= close.any(axis=0)
    return near


def _hash(vector):
    return F.xxhash64(vector)


def _valid(vector):
    numbers = F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
    finite = F.forall(numbers, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(numbers, lambda x: x != 0)


def embedding_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.9,
    bits: int = 128,
    sample_rows: int = 20_000,
    sample_bytes: int = 64 << 20,
    block: int = 4096,
    seed: int = 5,
) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links`` (other vectors at cosine of at
    least ``threshold``), ``component_id`` (smallest id reachable) and ``kept``.

    Null or zero vectors, and those with null or non-finite components, link with
    nothing and stand alone. Vectors of different lengths never link. Equal
    vectors always do. Rows with a null id count as vectors; their component is
    the smallest id in it, or null, and they are not kept unless alone and null.
    Repeated rows are copies. An empty table gives an empty result. The rotation is
    learned on at most ``sample_rows`` vectors of at most ``sample_bytes`` in all.
    """
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    given = vectors.select(F.col(id_col).alias("_id"), F.col(vector).cast(kind).alias("_v"))
    keyed = given.withColumn("_h", F.when(_valid(F.col("_v")), _hash(F.col("_v"))))
    classes = stage(
        # vectors of one class are equal, not only their hashes
        keyed.where(F.col("_h").isNotNull()).groupBy("_h", "_v").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n_rows")).withColumn("class", F.monotonically_increasing_id()),
        "embedding-classes",
    )
    # a table has one length, or a few
    dims = [r["d"] for r in classes.select(F.size("_v").alias("d")).distinct().collect()]
    found = None
    for dim in sorted(dims):
        sample = min(sample_rows, max(1, sample_bytes // (8 * max(1, dim))))
        part = _links_of_length(classes.where(F.size("_v") == dim), dim, threshold, bits, sample, block, seed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return keyed.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    links = stage(found, "embedding-links")
    counts = links.groupBy("class").agg(F.sum("links").alias("links"))
    named = name_components(classes.select("class", "least"), links.select(F.col("class").alias("u"), F.col("other").alias("v")))
    total = classes.agg(F.sum("n_rows")).first()[0]
    same = classes.select("_h", "_v", "class", "n_rows").join(named.join(counts, "class", "left"), "class")
    linked = (F.coalesce("links", F.lit(0)) + F.col("n_rows") - 1).alias("n_links")
    # a row finds its class by hash, and by the vector itself only if two classes share one
    clash = not classes.groupBy("_h").count().where("count > 1").isEmpty()
    key = F.struct("_h", "_v") if clash else F.col("_h")
    values = same.select(key.alias("_key"), linked, "component_id", F.col("n_rows"))
    rows = keyed.where(F.col("_h").isNotNull()).select("_id", key.alias("_key"))
    good = join_spread(rows, values, "_key", total).select("_id", "n_links", "component_id")
    alone = keyed.where(F.col("_h").isNull()).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return good.unionByName(alone).select(F.col("_id").alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links_of_length(classes: DataFrame, dim: int, threshold: float, bits: int, sample_rows: int, block: int, seed: int) -> DataFrame:
    spark = classes.sparkSession
    n = classes.count()
    # bounded by the caller, in rows and bytes; picked by hash
    sample = classes.orderBy("_h", "class").limit(sample_rows).select("_v").toPandas()["_v"]
    x = np.array(sample.tolist(), np.float64).reshape(-1, dim)
    projection = learn_projection(_unit(x), bits, seed)
    masks, words = table_masks(n, bits, threshold), _words(bits)
    sent = spark.sparkContext.broadcast(projection)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(2).flatten(), np.float64).reshape(-1, dim)
            code = encode(_unit(v), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, code.view(np.int64).T.copy())], names=["class", "size", *words])

    rows = stage(classes.select("class", F.col("n_rows").alias("size"), "_v").mapInArrow(coded, "class long, size long, " + ", ".join(f"{w} long" for w in words)), "embedding-codes")
    fixed = [F.struct(F.lit(t).alias("t"), *[F.lit(_signed(m)).cast("long").alias(w) for w, m in zip(words, mask, strict=True)]) for t, mask in enumerate(masks)]
    key = F.xxhash64(*[F.col(w).bitwiseAND(F.col(f"at.{w}")) for w in words])
    entries = rows.withColumn("at", F.explode(F.array(*fixed))).select("class", "size", *words, "at.t", key.alias("key"))
    shared = entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    dealt = entries.withColumns({"p": F.lit(0), "q": F.lit(0), "own": F.lit(0)})
    crowded = stage(shared, "embedding-crowded")
    if not crowded.isEmpty():
        blocks = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
        mine = F.pmod(F.xxhash64("class", F.lit(1)), blocks).cast("int")
        # a row goes to the pairs of blocks that hold its own
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(b, mine).alias("p"), F.greatest(b, mine).alias("q")))
        marked = entries.join(crowded, ["t", "key"], "left").withColumn("own", mine).withColumn("pair", F.explode(pairs))
        dealt = marked.select("class", "size", *words, "t", "key", "pair.p", "pair.q", "own")
    group, budget = ["t", "key", "p", "q"], hamming_budget(bits, threshold)
    kinds = f"class long, size long, {', '.join(f'{w} long' for w in words)}, t int, key long, p int, q int, own int"
    near = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_bucket_work(_near_rows(words, budget)), kinds)
    with_vectors = near.join(classes.select("class", "_v"), "class")
    work = _bucket_work(_linked_rows(dim, words, masks, threshold, budget))
    return with_vectors.repartition(*group).sortWithinPartitions(*group).mapInArrow(work, FOUND)


def _sides(group: pa.Table):
    """Rows of the two blocks that meet in this part of a bucket; one block meets itself."""
    p, q, own = (group[c].to_numpy() for c in ("p", "q", "own"))
    rows = np.arange(len(group))
    left = rows[own == p]
    return left, left if p[0] == q[0] else rows[own == q]


def _words(bits: int) -> list[str]:
    """Columns that hold a code."""
    return [f"code{at}" for at in range(-(-bits // 64))]


def _codes(group: pa.Table, words: list[str]) -> np.ndarray:
    return np.column_stack([group[w].to_numpy().astype(np.int64).view(np.uint64) for w in words])


def _near_rows(words: list[str], budget: int):
    def work(group: pa.Table) -> pa.Table:
        return group.filter(pa.array(near_codes(_codes(group, words), *_sides(group), budget)))

    return work


def _linked_rows(dim: int, words: list[str], masks: list[tuple[int, ...]], threshold: float, budget: int):
    def work(group: pa.Table) -> pa.Table:
        unit = _unit(group["_v"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim))
        left, right = _sides(group)
        earlier = masks[: group["t"][0].as_py()]
        found = links_within(group["class"].to_numpy(), _codes(group, words), unit, group["size"].to_numpy(), left, right, earlier, threshold, budget)
        return pa.table(list(map(pa.array, found)), names=["class", "other", "links"])

    return work


def _bucket_work(work):
    """Task: ``work`` on each bucket (or part of one) of more than one row."""
    names = ["t", "key", "p", "q"]

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if not len(held):
                continue
            keys = np.column_stack([held[c].to_numpy() for c in names])
            starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1]
            out = [work(held.slice(a, b - a).combine_chunks()) for a, b in zip(starts[:-1], starts[1:], strict=True) if b - a > 1]
            for table in out:
                yield from table.to_batches()
            held = held.slice(starts[-1])
        if held is not None and len(held) > 1:
            yield from work(held.combine_chunks()).to_batches()

    return done


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x

"""SimHash near-duplicate detection with a binary-trie self-join.

Fingerprints are 64-bit majority votes over XXH64 hashes of word shingles.
Distinct fingerprints within ``budget`` differing bits are linked; documents
that share a fingerprint are one class from the start, so a group of copies of
any size is one trie leaf.

Distribution. The 64 bits are cut into six blocks; two fingerprints that differ
in at most four bits agree on at least two whole blocks, so each of the 15 ways
to fix two blocks gives a table in which every link meets in some bucket (a trie
below one fixed prefix of permuted bits). Inside a bucket the trie is joined with
itself: node pairs go down together, differing bits add up, and a pair is pruned
once the budget is exceeded. A bucket over ``bucket_limit`` is not capped: it is
dealt out as pairs of parts, and every pair of its members meets in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake.llm.components import join_spread, name_components
from leaselake.llm.staging import stage

ALL_BITS = (1 << 64) - 1
#: Pairs of leaves that one step of the self-join may hold at once.
PAIRS_AT_ONCE = 8_000_000
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of one text; 0 for null or wordless text."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    n = max(1, len(words) - k + 1)
    ends = ends[k - 1 :] if len(words) >= k else ends[-1:]
    votes = np.zeros(64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        spans = zip(starts[at : min(n, at + SHINGLES_AT_ONCE)].tolist(), ends[at : at + SHINGLES_AT_ONCE].tolist())
        h = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in spans], repeat(seed)), ">u8")
        # a sum of at most 2**16 ones is exact in single precision
        votes += np.ones(len(h), np.float32) @ np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
    return int(np.packbits(2 * votes > n).view(">i8")[0])


def simhash_fingerprints(docs: DataFrame, text: str = "text", k: int = 4, seed: int = 42, to: str = "fingerprint") -> DataFrame:
    """Adds column ``to`` (bigint). Null and wordless texts get 0. ``k`` words a
    shingle; a shorter text is one shingle."""

    @F.pandas_udf("long")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(x, k, seed) for x in batch], dtype="int64")

    return docs.withColumn(to, hashed(F.col(text).cast("string")))


def table_masks(budget: int) -> list[int]:
    """Masks that fix two of ``budget + 2`` blocks of the 64 bits: by the
    pigeonhole principle every pair within the budget agrees on one of them."""
    blocks = [sum(1 << int(b) for b in c) for c in np.array_split(np.arange(64), budget + 2)]
    return [sum(c) for c in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def trie_links(fps: DataFrame, budget: int = 4, bucket_limit: int = 4096) -> DataFrame:
    """Distinct ``fps(fp)`` to links ``(u, v)`` that connect exactly what pairs
    within ``budget`` differing bits connect (a spanning forest per bucket, so
    that a dense group of n gives n - 1 links a bucket and not n²)."""
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in table_masks(budget)])).alias("mask"))
    rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    large = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_limit)
    large = stage(large, "simhash-large")
    if large.isEmpty():
        dealt = rows.withColumns({"p": F.lit(0), "q": F.lit(0)})
    else:
        parts = F.ceil(F.coalesce("n", F.lit(1)) / bucket_limit).cast("int")
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.struct(F.least(x, own).alias("p"), F.greatest(x, own).alias("q")))
        dealt = rows.join(large, ["mask", "key"], "left").select("fp", "mask", "key", F.explode(pairs).alias("at")).select("fp", "mask", "key", "at.p", "at.q")
    return dealt.repartition("mask", "key", "p", "q").sortWithinPartitions("mask", "p", "q", "key").mapInPandas(_bucket_links(budget), "u long, v long")


def _bucket_links(budget: int):
    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: pd.DataFrame | None = None
        for batch in batches:
            if carry is not None:
                batch = pd.concat([carry, batch], ignore_index=True)
            if not len(batch):
                continue
            same = (batch[["mask", "p", "q", "key"]].to_numpy() == batch[["mask", "p", "q", "key"]].iloc[-1].to_numpy()).all(axis=1)
            cut = len(batch) - int(same.sum())
            carry = batch.iloc[cut:]
            if cut:
                yield _links_of(batch.iloc[:cut], budget)
        if carry is not None and len(carry):
            yield _links_of(carry, budget)

    return joined


def _links_of(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    us, vs = [], []
    for (mask, _, _), mine in rows.groupby(["mask", "p", "q"], sort=False):
        u, v = forest(mine["fp"].to_numpy().view(np.uint64), int(mask) & ALL_BITS, budget)
        us.append(u)
        vs.append(v)
    u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
    return pd.DataFrame({"u": u, "v": v})


def permuted(fps: np.ndarray, mask: int) -> np.ndarray:
    """The same bits with those of ``mask`` first, each part in its order."""
    order = [b for b in range(63, -1, -1) if mask >> b & 1] + [b for b in range(63, -1, -1) if not mask >> b & 1]
    out, at = np.zeros_like(fps), 0
    while at < 64:  # runs of neighbouring bits move together
        n = 1
        while at + n < 64 and order[at + n] == order[at] - n:
            n += 1
        low = order[at] - n + 1
        run = (fps >> np.uint64(low)) & np.uint64((1 << n) - 1)
        out |= run << np.uint64(64 - at - n)
        at += n
    return out


def forest(fps: np.ndarray, mask: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs that agree on ``mask`` and differ
    in at most ``budget`` bits in all; ``fps`` is distinct within a bucket."""
    depth = mask.bit_count()
    perm = permuted(fps, mask)
    order = np.argsort(perm)
    perm, fps = perm[order], fps[order]
    top = perm >> np.uint64(64 - depth) if depth else np.zeros_like(perm)
    lo = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(top) else np.zeros(0, np.int64)
    hi = np.r_[lo[1:], len(top)]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    label = np.arange(len(perm))
    work = np.cumsum((hi - lo) ** 2)
    at = 0
    while at < len(lo):
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        i, j = _descend(perm, lo[at:end], hi[at:end], depth, budget)
        label = _merge(label, i, j)
        at = end
    child = np.flatnonzero(label != np.arange(len(label)))
    return fps[child], fps[label[child]]


def _descend(perm, lo, hi, depth, budget):
    """Leaf pairs below the nodes ``[lo, hi)``: the self-join of the trie."""
    al, ah, bl, bh = lo, hi, lo, hi
    diff = np.zeros(len(lo), np.int64)
    found_i, found_j = [], []
    while len(al) and depth < 64:
        one = np.r_[0, np.cumsum((perm >> np.uint64(63 - depth)) & np.uint64(1))].astype(np.int64)
        am, bm = ah - (one[ah] - one[al]), bh - (one[bh] - one[bl])
        own = al == bl
        parts = [
            (al, am, bl, bm, diff, slice(None)),
            (am, ah, bm, bh, diff, slice(None)),
            (al, am, bm, bh, diff + 1, slice(None)),
            (am, ah, bl, bm, diff + 1, ~own),
        ]
        al, ah, bl, bh, diff = (np.concatenate([p[c][p[5]] for p in parts]) for c in range(5))
        depth += 1
        live = (ah > al) & (bh > bl) & (diff <= budget) & ~((al == bl) & (ah - al == 1))
        al, ah, bl, bh, diff = al[live], ah[live], bl[live], bh[live], diff[live]
        leaf = (ah - al == 1) & (bh - bl == 1)
        i, j = al[leaf], bl[leaf]
        near = np.bitwise_count(perm[i] ^ perm[j]) <= budget
        found_i.append(i[near])
        found_j.append(j[near])
        al, ah, bl, bh, diff = al[~leaf], ah[~leaf], bl[~leaf], bh[~leaf], diff[~leaf]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _merge(label, i, j):
    """Smallest index reachable, by repeated minimum and pointer jumping."""
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        differ = label[i] != label[j]
        i, j = i[differ], j[differ]
    return label


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 4, seed: int = 42, budget: int = 4, bucket_limit: int = 4096
) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable through links of at most
    ``budget`` differing bits.

    Null or wordless texts have fingerprint zero and link like any other. A row
    with a null id keeps its row; it takes the smallest id of its component, or
    null if there is none. Repeated rows stay repeated; an empty table gives an
    empty result; other columns of ``docs`` are ignored.
    """
    hashed = simhash_fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text", k, seed, "fp")
    rows = stage(hashed.select("_id", "fp"), "simhash-fp")
    total = rows.count()
    classes = stage(rows.groupBy(F.col("fp").alias("class")).agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n_rows")), "simhash-classes")
    links = trie_links(classes.select(F.col("class").alias("fp")), budget, bucket_limit)
    named = name_components(classes, links).select(F.col("class").alias("fp"), "component_id", "n_rows")
    return join_spread(rows, named, "fp", total).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """``docs`` without the later members of each near-duplicate group: rows whose
    id is their component's smallest stay (rows with a null id stay too, since
    nothing names them). All columns are kept."""
    groups = simhash_components(docs, id_col, **params)
    later = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(later, docs[id_col] == later["_gone"], "left_anti")

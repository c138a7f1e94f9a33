"""SimHash near-duplicates by similarity: fingerprints find pairs, sets decide.

Two documents are linked if the sets of their ``k``-word shingles have a Jaccard
similarity of at least ``threshold``. A similarity of 0.8 is an angle at which a
fingerprint bit differs in about 15 of 100 cases, so fingerprints have 128 bits
here, the error budget is wide, and links are confirmed on the whole sets.

Distribution. At such a budget no pair of blocks of bits must agree, so tables
fix a few bits each, drawn from permutations of all 128, and their number follows
from the number of documents so that a pair at the threshold is missed by all of
them with probability ``miss``. A bucket is a trie below its fixed bits. Equal sets
are one class from the start. Then, in two steps:

1. Neighbours. In each bucket a leaf is held against the leaves just before it in
   the trie's order; of those within the budget the nearest one of each document
   is confirmed. Groups of near copies become components at a cost of one
   comparison a document.
2. The trie is joined with itself: node pairs go down together, differing bits add
   up, and a pair is pruned once the budget is exceeded, or if all leaves below it
   are in one component already. In each table, each document that is left with
   a larger component in its reach proposes the nearest leaves of such, which are
   confirmed, and components grow. A round lets a document propose so many leaves a
   table (``WIDTHS``); the next, wider round is run if any document had more, and
   the last one proposes all that are left. So a dense group of n documents that
   do link gives a few proposals a document, and in the end every pair that a
   table and the budget reach is either in one component or confirmed or refused.

A bucket of more than ``bucket_limit`` rows is dealt out as pairs of parts; a
component that fills a part by itself is not paired with itself. Pairs are confirmed
bucket by bucket, so that a text moves once for all its pairs there. What is
missed are pairs that no table holds in one bucket (``miss``) or whose fingerprints
differ in more bits than the budget (one in 80 at the threshold, fewer above it).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake.llm.components import join_spread, name_components
from leaselake.llm.staging import drop_staged, stage

BITS = 128
#: Leaf pairs of the trie that are compared at once.
PAIRS_AT_ONCE = 4_000_000
#: Node pairs with no more leaf pairs than this are compared leaf by leaf.
LEAF_PAIRS = 1 << 18
#: Node pairs with more are a table of distances each; smaller ones go together.
TABLE_PAIRS = 2048
#: Leaves before a leaf that the first round looks at.
NEIGHBOURS = 3
#: Leaves that a document proposes in one table, round by round; at last all.
WIDTHS = (8, 64, None)
#: Shingles of the sets, and pairs, that are confirmed together.
SHINGLES_KEPT = 8_000_000
PAIRS_TOGETHER = 1_000_000
SLACK = 1e-9


def shingle_set(text: str | None, k: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, ascending; none for null or
    wordless text. A text of fewer than ``k`` words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: max(1, len(words) - k + 1)].tolist()
    ends = (ends[k - 1 :] if len(words) >= k else ends[-1:]).tolist()
    spans = [joined[a:b] for a, b in zip(starts, ends, strict=True)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(seed)), np.uint64, len(spans)))


def wide_fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits as two signed halves; a bit is 1 if set in over half the hashes."""
    second = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    second ^= second >> np.uint64(29)
    halves = []
    for h in (shingles, second * np.uint64(0x94D049BB133111EB)):
        votes = np.zeros(64)
        for at in range(0, len(h), 1 << 16):
            part = h[at : at + (1 << 16)].astype(">u8")
            # a sum of at most 2**16 ones is exact in single precision
            votes += np.ones(len(part), np.float32) @ np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
        halves.append(int(np.packbits(2 * votes > len(h)).view(">i8")[0]))
    return halves[0], halves[1]


def share_apart(threshold: float) -> float:
    """Share of bits in which two sets of this similarity differ, when as many of
    each set are missing from the other."""
    return math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi


def error_budget(threshold: float) -> int:
    """Differing bits up to which a pair is confirmed: 2.25 deviations above the mean
    of pairs at the threshold, of which one in 80 has more."""
    share = share_apart(threshold)
    return math.ceil(BITS * share + 2.25 * math.sqrt(BITS * share * (1 - share)))


def table_bits(n: int, threshold: float = 0.8, bucket: int = 512, miss: float = 0.01, seed: int = 11) -> list[list[int]]:
    """Bits that each table fixes: about ``log2(n / bucket)`` of a permutation. Sets
    of a few shingles differ in more bits, so the share has some room."""
    b = max(4, math.ceil(math.log2(max(2, n) / bucket)))
    tables = math.ceil(math.log(miss) / math.log1p(-((1 - share_apart(threshold) - 0.025) ** b)))
    rng, found, order = np.random.default_rng(seed), [], []
    while len(found) < tables:
        if len(order) < b:
            order = rng.permutation(BITS).tolist()
        found.append([order.pop() for _ in range(b)])
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rows(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """``docs(_id, _text)`` to ``_id``, ``packed`` (the text), ``class`` (hash of
    the set), ``size`` of the set, and the fingerprint ``hi``, ``lo``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, cells = [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, k, seed)
                packed.append(zlib.compress((text or "").encode("utf-8", "surrogatepass"), 1))
                cells.append((_signed(xxhash.xxh3_64_intdigest(own.tobytes(), seed)), len(own), *wide_fingerprint(own)))
            columns = np.array(cells, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), *map(pa.array, columns.T)], names=["_id", "packed", "class", "size", "hi", "lo"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(made, f"_id {kind}, packed binary, class long, size long, hi long, lo long")


def _entries(nodes: DataFrame, tables: list[list[int]]) -> DataFrame:
    """Each node once a table, with the bucket's ``key``."""
    masks = [[t, *(_signed(sum(1 << b % 64 for b in bits if b // 64 == half)) for half in (0, 1))] for t, bits in enumerate(tables)]
    fixed = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(high).cast("long").alias("high"), F.lit(low).cast("long").alias("low")) for t, high, low in masks])
    key = F.xxhash64("at.t", F.col("hi").bitwiseAND(F.col("at.high")), F.col("lo").bitwiseAND(F.col("at.low")))
    return nodes.withColumn("at", F.explode(fixed)).select(*nodes.columns, "at.t", key.alias("key"))


def _distance(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(c["hi"][i] ^ c["hi"][j]).astype(np.int64) + np.bitwise_count(c["lo"][i] ^ c["lo"][j])


def _sizes_fit(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    a, b = c["size"][i], c["size"][j]
    return np.minimum(a, b) >= threshold * np.maximum(a, b) - SLACK


def _columns(batch: pd.DataFrame | pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    out = {n: batch[n].to_numpy() for n in names}
    return out | {n: out[n].astype(np.int64).view(np.uint64) for n in ("hi", "lo")}


def _trie_order(c: dict[str, np.ndarray]) -> np.ndarray:
    """Leaves of each bucket in the order of its bits; half and first bit of a
    table's trie vary, so that neighbours in one are not those of all."""
    turn = (c["t"] * 7 % 64).astype(np.uint64)
    odd = (c["t"] % 2).astype(bool)

    def turned(x: np.ndarray) -> np.ndarray:
        return (x << turn) | (x >> (np.uint64(63) - turn) >> np.uint64(1))

    first, second = turned(np.where(odd, c["lo"], c["hi"])), turned(np.where(odd, c["hi"], c["lo"]))
    c["trie"] = first
    return np.lexsort((second, first, c["key"]))


def _neighbours(threshold: float):
    """Task: entries to (u, v, distance, group) of leaves near one another in the
    order; the group is their bucket."""
    names, budget = ["node", "size", "hi", "lo", "t", "key"], error_budget(threshold)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_buckets(batches, ["key"]):
            c = _columns(group, names)
            order = _trie_order(c)
            for gap in range(1, NEIGHBOURS + 1):
                i, j = order[gap:], order[:-gap]
                both = c["key"][i] == c["key"][j]
                i, j = i[both], j[both]
                distance = _distance(c, i, j)
                near = (distance <= budget) & _sizes_fit(c, i, j, threshold)
                u, v = c["node"][i[near]], c["node"][j[near]]
                yield pa.record_batch({"u": np.maximum(u, v), "v": np.minimum(u, v), "distance": distance[near], "group": c["key"][i[near]]})

    return found


def _whole_buckets(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by ``by`` in tables that hold buckets whole."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if held.num_rows < 1 << 16:
            continue
        keys = np.column_stack([held[c].to_numpy() for c in by])
        other = np.flatnonzero((keys != keys[-1]).any(axis=1))
        if len(other):
            yield held.slice(0, other[-1] + 1)
            held = held.slice(other[-1] + 1)
    if held is not None and held.num_rows:
        yield held


def near_leaves(c: dict[str, np.ndarray], lo: np.ndarray, hi: np.ndarray, threshold: float, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves within the budget below the nodes ``[lo, hi)`` whose labels
    differ: the self-join of the trie. ``c`` is in trie order; rows of a bucket that
    was dealt out as parts ``p`` and ``q`` say in ``own`` which of them is theirs."""
    trie, label = c["trie"], c["label"]
    change = np.r_[0, np.cumsum(label[1:] != label[:-1])] if len(label) else np.zeros(0, np.int64)
    al, ah, bl, bh = lo, hi, lo, hi
    diff = np.zeros(len(lo), np.int64)
    depth = 0
    while len(al):
        same = (label[al] == label[bl]) & (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl])
        live = ~same & (diff <= budget)
        al, ah, bl, bh, diff = al[live], ah[live], bl[live], bh[live], diff[live]
        small = ((ah - al) * (bh - bl) <= LEAF_PAIRS) | (depth == 64)
        yield from _compared(c, al[small], ah[small], bl[small], bh[small], threshold, budget)
        al, ah, bl, bh, diff = al[~small], ah[~small], bl[~small], bh[~small], diff[~small]
        if depth == 64 or not len(al):
            return
        one = np.r_[0, np.cumsum((trie >> np.uint64(63 - depth)) & np.uint64(1))].astype(np.int64)
        am, bm = ah - (one[ah] - one[al]), bh - (one[bh] - one[bl])
        apart = al != bl
        parts = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1), tuple(x[apart] for x in (am, ah, bl, bm, diff + 1))]
        al, ah, bl, bh, diff = (np.concatenate([p[k] for p in parts]) for k in range(5))
        full = (ah > al) & (bh > bl)
        al, ah, bl, bh, diff = al[full], ah[full], bl[full], bh[full], diff[full]
        depth += 1


def _compared(c, al, ah, bl, bh, threshold, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs of the given node pairs that are within the budget."""

    def checked(i, j, same_node):
        wanted = (c["label"][i] != c["label"][j]) & (~same_node | (i < j)) & _sizes_fit(c, i, j, threshold)
        if "own" in c:  # pairs of parts compare across, a part with itself once
            wanted &= (c["own"][i] != c["own"][j]) | (c["p"][i] == c["q"][i])
        return i[wanted], j[wanted]

    many = (ah - al) * (bh - bl)
    for n in np.flatnonzero(many > TABLE_PAIRS).tolist():
        a, b = slice(al[n], ah[n]), slice(bl[n], bh[n])
        apart = np.bitwise_count(c["hi"][a, None] ^ c["hi"][None, b]) + np.bitwise_count(c["lo"][a, None] ^ c["lo"][None, b])
        i, j = np.nonzero(apart <= budget)
        yield checked(i + al[n], j + bl[n], np.bool_(al[n] == bl[n]))
    few = np.flatnonzero(many <= TABLE_PAIRS)
    al, bl, width, many = al[few], bl[few], (bh - bl)[few], many[few]
    ends = np.cumsum(many)
    at = 0
    while at < len(many):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        n = many[at:stop]
        node = np.repeat(np.arange(at, stop), n)
        step = np.arange(len(node)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        i, j = al[node] + step // width[node], bl[node] + step % width[node]
        near = _distance(c, i, j) <= budget
        i, j, node = i[near], j[near], node[near]
        yield checked(i, j, al[node] == bl[node])
        at = stop


def _proposals(threshold: float, width: int | None):
    """Task: entries with their component's label and size to (u, v, group): of each
    leaf the ``width`` nearest ones of larger components (of equal size, larger label),
    or all of them, and (u, u, group) for a leaf that had more."""
    names, budget = ["node", "label", "members", "size", "hi", "lo", "t", "key", "p", "q", "own"], error_budget(threshold)

    def nearest(i: np.ndarray, j: np.ndarray, far: np.ndarray):
        order = np.lexsort((j, far, i))
        own = i[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        first = order[rank <= width]  # one more tells that some are left out
        return i[first], j[first], far[first]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_buckets(batches, ["key", "p", "q"]):
            c = _columns(group, names)
            c["key"] = c["key"] ^ (c["p"].astype(np.int64) * 0x9E3779B1 + c["q"])  # a dealt bucket's pairs of parts are buckets
            order = _trie_order(c)
            c = {n: x[order] for n, x in c.items()}
            lo = np.flatnonzero(np.r_[True, c["key"][1:] != c["key"][:-1]])
            hi = np.r_[lo[1:], len(order)]
            lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
            none = np.zeros(0, np.int64)
            held, n = [(none, none, none)], 0
            for i, j in near_leaves(c, lo, hi, threshold, budget):
                up = (c["members"][i] < c["members"][j]) | ((c["members"][i] == c["members"][j]) & (c["label"][i] < c["label"][j]))
                i, j = np.where(up, i, j), np.where(up, j, i)
                if width is None:
                    yield pa.record_batch({"u": c["node"][i], "v": c["node"][j], "group": c["key"][i]})
                    continue
                held.append(nearest(i, j, _distance(c, i, j)))
                n += len(held[-1][0])
                if n > PAIRS_AT_ONCE:
                    held = [nearest(*map(np.concatenate, zip(*held, strict=True)))]
                    n = 0
            if width is None:
                continue
            i, j, _ = nearest(*map(np.concatenate, zip(*held, strict=True)))
            more = np.arange(len(i)) - np.searchsorted(i, i) == width
            yield pa.record_batch({"u": c["node"][i], "v": np.where(more, c["node"][i], c["node"][j]), "group": c["key"][i]})

    return found


def _dealt(entries: DataFrame, bucket_limit: int) -> DataFrame:
    """Entries with ``label`` to ``p``, ``q``, ``own``: small buckets are one part,
    large ones go out as pairs of parts. A component with more rows in a bucket
    than fit a part has parts of its own, which are not paired with each other."""
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_limit)
    large = stage(sizes, "near-large")
    if large.isEmpty():
        return entries.withColumns({"p": F.lit(0), "q": F.lit(0), "own": F.lit(0)})
    keys = large.select("key")  # few; Catalyst broadcasts them while they are small
    big = entries.join(keys, "key", "left_semi")
    kinds = big.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") > bucket_limit, F.col("label")).alias("kind")
    parts = kinds.groupBy("key", kind).agg(F.sum("n").alias("n")).withColumn("parts", F.ceil(F.col("n") / bucket_limit).cast("int"))
    # parts of a bucket are numbered; each knows the component that fills it, or null
    listed = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("kind", "parts"))).alias("kinds"))
    flat = F.flatten(F.transform("kinds", lambda k: F.array_repeat(k["kind"], k["parts"])))
    listed = stage(listed.select("key", "kinds", flat.alias("of")), "near-parts")
    owner = kinds.where(F.col("n") > bucket_limit).select("key", "label", F.lit(True).alias("giant"))
    marked = big.join(owner, ["key", "label"], "left").join(listed, "key")
    mine = F.when(F.col("giant"), F.col("label"))
    before = F.aggregate("kinds", F.lit(0), lambda total, k: total + F.when(F.coalesce(k["kind"] < mine, F.col("giant") & k["kind"].isNull(), F.lit(False)), k["parts"]).otherwise(0))
    count = F.aggregate("kinds", F.lit(0), lambda total, k: total + F.when(k["kind"].eqNullSafe(mine), k["parts"]).otherwise(0))
    marked = marked.withColumn("own", before + F.pmod(F.xxhash64("node"), count).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.size("of") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("p"), F.greatest(x, F.col("own")).alias("q"), F.get(F.col("of"), x).alias("kind")))
    pairs = F.filter(others, lambda x: mine.isNull() | ~x["kind"].eqNullSafe(mine))
    out = marked.withColumn("pair", F.explode(pairs)).select(*entries.columns, "pair.p", "pair.q", "own")
    rest = entries.join(keys, "key", "left_anti").withColumns({"p": F.lit(0), "q": F.lit(0), "own": F.lit(0)})
    return rest.unionByName(out)


def _blocks(pairs: DataFrame, ends: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs(u, v, group)`` and their ``ends(group, node)`` with the ``block`` that
    confirms them. A group whose sets or pairs are too many for one task is cut by
    hashes of both ends into blocks, in each of which a text stands once."""
    weight = ends.join(nodes.select("node", "size"), "node").groupBy("group").agg(F.sum("size").alias("shingles"))
    many = pairs.groupBy("group").agg(F.count(F.lit(1)).alias("n_pairs"))
    parts = F.ceil(F.greatest(2 * F.col("shingles") / SHINGLES_KEPT, F.sqrt(F.col("n_pairs") / PAIRS_TOGETHER))).cast("int")
    heavy = stage(weight.join(many, "group").withColumn("parts", parts).where("parts > 1").select("group", "parts"), "near-heavy")

    def part(node: str):
        return F.pmod(F.xxhash64(F.lit("part"), node), F.coalesce("parts", F.lit(1))).cast("int")

    if heavy.isEmpty():
        return pairs.withColumnRenamed("group", "block"), ends.withColumnRenamed("group", "block")
    cut = pairs.join(heavy, "group", "left").select("u", "v", F.xxhash64("group", part("u"), part("v")).alias("block"))
    return cut, cut.select("block", F.explode(F.array("u", "v")).alias("node")).distinct()


def _confirmed(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, seed: int, threshold: float) -> DataFrame:
    """Those written ``pairs(u, v, group)`` whose whole sets are similar."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known = None, {}
        for batch in batches:
            near = ([], [])
            for own, u, v, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if own != block:
                    block, known = own, {}
                if v is None:  # the block's texts come first
                    known[u] = shingle_set(zlib.decompress(text).decode("utf-8", "surrogatepass"), k, seed)
                    continue
                x, y = known[u], known[v]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both) - SLACK:
                    near[0].append(u)
                    near[1].append(v)
            yield pa.record_batch({"u": pa.array(near[0], pa.int64()), "v": pa.array(near[1], pa.int64())})

    ends = stage(pairs.select("group", F.explode(F.array("u", "v")).alias("node")).distinct(), "near-ends")
    blocks, wanted = _blocks(pairs, ends, nodes)
    texts = wanted.join(rows.select("node", "packed"), "node").select("block", F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), "packed")
    both = texts.unionByName(blocks.select("block", "u", "v", F.lit(None).cast("binary").alias("packed")))
    dealt = both.repartition("block").sortWithinPartitions("block", F.col("v").isNotNull(), "u")
    found = stage(dealt.mapInArrow(compared, "u long, v long"), "near-links")
    drop_staged(ends)
    return found


def similar_links(
    nodes: DataFrame, rows: DataFrame, k: int, seed: int, threshold: float, bucket_limit: int = 4096, bucket: int = 512, miss: float = 0.01, widths: tuple[int | None, ...] = WIDTHS
) -> DataFrame:
    """Confirmed links ``(u, v)`` between written ``nodes(node, size, hi, lo)``, which
    connect what all pairs of similar sets connect that tables and budget reach."""
    tables = table_bits(nodes.count(), threshold, bucket, miss)
    named = nodes.where("size > 0").select("node", "size", "hi", "lo")
    entries = _entries(named, tables).repartition("key").sortWithinPartitions("key")
    near = entries.mapInArrow(_neighbours(threshold), "u long, v long, distance long, group long")
    # the nearest; of equally near ones any, so that no document is the choice of very many
    nearest = near.groupBy("u").agg(F.min(F.struct("distance", F.xxhash64("u", "v").alias("h"), "v", "group")).alias("best")).select("u", "best.v", "best.group")
    tried = [stage(nearest, "near-first")]
    links = [_confirmed(tried[0], rows, nodes, k, seed, threshold)]
    labelled = None
    for width in widths:
        if labelled is None:
            labels = name_components(named.select(F.col("node").alias("class"), F.col("node").alias("least")), reduce(DataFrame.unionByName, links))
            labels = labels.select(F.col("class").alias("node"), F.col("component_id").alias("label"), F.col("component_size").alias("members"))
            labelled = stage(named.join(labels, "node"), "near-labelled")
        dealt = _dealt(_entries(labelled, tables), bucket_limit)
        proposed = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_proposals(threshold, width), "u long, v long, group long")
        pairs = proposed.groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.min("group").alias("group"))
        known = reduce(DataFrame.unionByName, [t.select("u", "v") for t in tried])
        found = stage(pairs.join(known, ["u", "v"], "left_anti"), "near-proposed")
        new = found.where("u != v")
        if not new.isEmpty():
            tried.append(new)
            more = _confirmed(new, rows, nodes, k, seed, threshold)
            if not more.isEmpty():
                links.append(more)
                drop_staged(labelled)
                labelled = None
        if found.where("u = v").isEmpty():  # no document had more than it could propose
            break
    drop_staged(labelled)
    return reduce(DataFrame.unionByName, links)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8, seed: int = 42, **params) -> DataFrame:
    """One row per document: ``id_col`` and ``component_id``, the smallest id
    reachable through links of at least ``threshold`` similarity.

    Null and wordless texts have an empty set; they are copies of one another and
    link with nothing else. A row with a null id keeps its row; it takes the
    smallest id of its component, or null if there is none. Repeated rows stay
    repeated; an empty table gives an empty result.
    """
    given = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = stage(_rows(given, k, seed).withColumn("node", F.monotonically_increasing_id()), "near-rows")
    total = rows.count()
    # equal sets: their hash, size and fingerprint are equal
    same = ["class", "size", "hi", "lo"]
    nodes = stage(rows.groupBy(*same).agg(F.min("node").alias("node"), F.min("_id").alias("least"), F.count(F.lit(1)).alias("n_rows")), "near-nodes")
    links = similar_links(nodes, rows, k, seed, threshold, **params)
    named = name_components(nodes, links, "node").select(F.struct(*same).alias("same"), "component_id", "n_rows")
    members = rows.select("_id", F.struct(*same).alias("same"))
    return join_spread(members, named, "same", total).select(F.col("_id").alias(id_col), "component_id")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """``docs`` without the later members of each group of near copies: rows whose
    id is their component's smallest stay, and rows with a null id. All columns
    are kept."""
    groups = similar_components(docs, id_col, **params)
    gone = stage(groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct(), "near-later")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")

"""A trie of conversation prefixes by vertical bitmaps.

Conversations are dealt by range of their id and cut into shards of bounded size.
A shard is an index from (position, turn) to a bitset of its conversations, a
turn being the SHA-256 of role and text. A node is a bitset and a depth: its first
open member names a turn, the intersection of the bitset with that turn's
posting is a child, and so on until no member is open; popcounts are the members,
and those whose last turn this is are the end list. One intersection is made per
child, depth first.

Nodes of several shards are one node if their chains of turns are equal; the chain
is 128 bits of a SHA-256 over the parent's chain and the turn. What needs whole
subtrees is a sum over shards: each distinct node is owned by the first shard that
has it, so a second pass up each shard's trie adds what is counted once (words of
a node, leaves) beside what is counted per member. The number of shuffles does not
depend on the depth, and a node that all shards share gives one row a shard.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaselake.llm.components import join_spread
from leaselake.llm.mixing import word_count
from leaselake.llm.staging import stage

#: Conversations of a shard (bits of a bitset), and turns held at once.
SHARD_CONVERSATIONS, SHARD_TURNS = 1024, 65_536
#: Most turns that a rebuilt conversation takes from another.
HEADS = 3
FAMILY = 20
NODES = "shard long, place long, depth long, key binary, parent binary, n long, low long, words long, ends string"
TOTALS = "key binary, spent long, once long, leaves long"
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos`` (from 1), ``turn`` (its digest) and ``words``. Texts become
    digests before anything is shuffled. Turns of equal number, null first, stand in
    the order of their digests."""
    said = rows.select(
        rows[id_col].try_cast("long").alias("conv_id"),
        rows[turn].alias("_n"),
        F.coalesce(rows[role].cast("string"), F.lit("")).alias("_r"),
        F.coalesce(rows[text].cast("string"), F.lit("")).alias("_t"),
    ).where(F.col("conv_id").isNotNull())
    digest = F.unhex(F.sha2(F.concat(F.length("_r").cast("string"), F.lit(":"), F.col("_r"), F.col("_t")), 256))
    narrow = said.select("conv_id", "_n", digest.alias("turn"), word_count(F.col("_t")).alias("words"))
    along = Window.partitionBy("conv_id").orderBy("_n", "turn")
    return narrow.select("conv_id", F.row_number().over(along).cast("long").alias("pos"), "turn", "words")


def own_turns(numbered: DataFrame) -> DataFrame:
    """Conversations as they are: each row ``conv_id, pos, turn, words``, and a row of
    position 0 for each conversation."""
    starts = numbered.where("pos = 1").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words"))
    return numbered.unionByName(starts)


def heads_taken(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % (HEADS + 1)


def rebuilt_turns(numbered: DataFrame) -> DataFrame:
    """Each conversation with its first turns, 0 to ``HEADS`` by its id, taken from
    the first of its family; as ``own_turns``, so a conversation that is left without
    turns stays."""
    taken = heads_taken(F.col("conv_id"))
    starts = own_turns(numbered).where("pos = 0")
    first = numbered.where(F.col("pos") <= HEADS).select(F.col("conv_id").alias("_first"), "pos", "turn", "words")
    asking = starts.select("conv_id", taken.alias("_h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("_base")).where("_h > 0")
    heads = asking.join(first, (F.col("_base") == F.col("_first")) & (F.col("pos") <= F.col("_h"))).select("conv_id", "pos", "turn", "words")
    return starts.unionByName(numbered.where(F.col("pos") > taken)).unionByName(heads)


class _Shards:
    """Cuts a stream of turns, in order of conversation and position, into shards
    and gives the rows of their nodes. A conversation that alone passes the turns of
    a shard is a shard of its own: a chain, given out as it comes."""

    def __init__(self, first: int, conversations: int, turns: int):
        self.shard, self.most, self.turns = first, conversations, turns
        self.ids: list[int] = []
        self.said: list[list[tuple[bytes, int]]] = []
        self.held = 0
        self.chain: list | None = None  # [place, conversation, node not yet given out]

    def start(self, conv_id: int) -> Iterator[tuple]:
        yield from self.end_chain()
        if len(self.ids) >= self.most or self.held >= self.turns:
            yield from self.flush()
        self.ids.append(conv_id)
        self.said.append([])

    def turn(self, digest: bytes, words: int) -> Iterator[tuple]:
        if self.chain is not None:
            yield from self.grow(digest, words)
            return
        self.said[-1].append((digest, words))
        self.held += 1
        if len(self.said[-1]) > self.turns:
            conv_id, own = self.ids.pop(), self.said.pop()
            yield from self.flush()
            self.chain = [0, conv_id, (0, ROOT, None, 0)]
            for x in own:
                yield from self.grow(*x)

    def grow(self, digest: bytes, words: int) -> Iterator[tuple]:
        place, conv_id, (depth, key, parent, own) = self.chain
        yield self.shard, place, depth, key, parent, 1, conv_id, own, None
        self.chain = [place + 1, conv_id, (depth + 1, _chained(key, digest), key, words)]

    def end_chain(self) -> Iterator[tuple]:
        if self.chain is not None:
            place, conv_id, (depth, key, parent, words) = self.chain
            yield self.shard, place, depth, key, parent, 1, conv_id, words, str(conv_id)
            self.chain = None
            self.shard += 1

    def flush(self) -> Iterator[tuple]:
        """The shard's trie in pre-order."""
        if not self.ids:
            return
        ids, said = self.ids, self.said
        postings: list[dict[bytes, int]] = [defaultdict(int) for _ in range(max(map(len, said)))]
        ending: dict[int, int] = defaultdict(int)
        for n, own in enumerate(said):
            for posting, (digest, _) in zip(postings, own, strict=False):
                posting[digest] |= 1 << n
            ending[len(own)] |= 1 << n
        stack = [((1 << len(ids)) - 1, 0, ROOT, None, 0)]
        place = 0
        while stack:
            bits, depth, key, parent, words = stack.pop()
            done = bits & ending[depth]
            ends = ",".join(str(ids[n]) for n in _ones(done)) if done else None
            yield self.shard, place, depth, key, parent, bits.bit_count(), ids[_lowest(bits)], words, ends
            place += 1
            open_, children = bits & ~done, []
            while open_:
                digest, own = said[_lowest(open_)][depth]
                child = bits & postings[depth][digest]
                children.append((child, depth + 1, _chained(key, digest), key, own))
                open_ &= ~child
            stack.extend(reversed(children))
        self.shard += 1
        self.ids, self.said, self.held = [], [], 0


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _ones(bits: int) -> Iterator[int]:
    while bits:
        n = _lowest(bits)
        yield n
        bits &= bits - 1


def _chained(key: bytes, digest: bytes) -> bytes:
    return hashlib.sha256(key + digest).digest()[:16]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[k]) for n, k in (x.split() for x in schema.split(", "))])


def shard_nodes(turns: DataFrame, conversations: int = SHARD_CONVERSATIONS, held: int = SHARD_TURNS) -> DataFrame:
    """``NODES`` of each shard of ``turns`` (see ``own_turns``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(TaskContext.get().partitionId() << 32, conversations, held)

        def nodes() -> Iterator[tuple]:
            for conv_id, pos, digest, words in _rows(batches):
                yield from shards.turn(digest, words) if pos else shards.start(conv_id)
            yield from shards.end_chain()
            yield from shards.flush()

        yield from _batches(nodes(), _arrow(NODES))

    ordered = turns.select("conv_id", "pos", "turn", "words").repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(run, NODES)


def _subtree_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``shard, place, depth, key, spent, once, leaf``, each shard's backwards: a
    node comes after all below it, and open sums are kept by depth."""

    def totals() -> Iterator[tuple]:
        shard, below = None, {}
        for own_shard, _, depth, key, *own in _rows(batches):
            if own_shard != shard:
                shard, below = own_shard, {}
            under = below.pop(depth + 1, (0, 0, 0))
            mine = tuple(a + b for a, b in zip(own, under, strict=True))
            below[depth] = tuple(a + b for a, b in zip(mine, below.get(depth, (0, 0, 0)), strict=True))
            yield key, *mine

    yield from _batches(totals(), _arrow(TOTALS))


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, shard, ends`` in order to the SHA-256 of each key's joined list."""

    def digests() -> Iterator[tuple]:
        key, digest = None, None
        for own, _, ends in _rows(batches):
            if own != key:
                if digest is not None:
                    yield key, digest.hexdigest()
                key, digest = own, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.encode())
        if digest is not None:
            yield key, digest.hexdigest()

    yield from _batches(digests(), _arrow("key binary, ends_sha256 string"))


def prefix_trie(turns: DataFrame, conversations: int = SHARD_CONVERSATIONS, held: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``turns`` (see ``own_turns``, ``rebuilt_turns``):
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` and ``key``, the chain of its turns.

    The root has depth 0 and no parent. Null roles and texts are empty. Rows of a
    null id, or one that is no number, take no part. A conversation is one task's
    stream, however long; a node's end list is one too, in pieces of a shard. An
    empty table gives an empty result; other columns are ignored.
    """
    nodes = stage(shard_nodes(turns, conversations, held), "trie-nodes")
    one = nodes.groupBy("key").agg(
        F.min("low").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.sum("n").alias("n_convs"), F.max("words").alias("words"), F.min("shard").alias("owner")
    )
    merged = stage(one, "trie-merged")
    below = merged.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    known = stage(merged.join(below, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-known")

    owned = known.select("key", F.col("owner").alias("shard"), (F.col("n_children") == 0).cast("long").alias("_leaf"))
    own = F.col("_leaf").isNotNull()
    counted = nodes.join(owned, ["key", "shard"], "left").select(
        "shard", "place", "depth", "key", (F.col("n") * F.col("words")).alias("spent"), F.when(own, F.col("words")).otherwise(0).cast("long").alias("once"), F.coalesce("_leaf", F.lit(0)).cast("long").alias("leaf")
    )
    totals = counted.repartition("shard").sortWithinPartitions("shard", F.desc("place")).mapInArrow(_subtree_totals, TOTALS)
    sums = totals.groupBy("key").agg((F.sum("spent") - F.sum("once")).alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    lists = nodes.where(F.col("ends").isNotNull()).select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    digests = lists.mapInArrow(_end_digests, "key binary, ends_sha256 string")
    full = known.join(sums, "key").join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).drop("words", "owner")

    total = known.count()
    parents = known.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_rows"))
    inner = join_spread(full.where(F.col("parent").isNotNull()), parents, "parent", total)
    root = full.where(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long"))
    return inner.unionByName(root).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key")


SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos, d, words FROM (
    SELECT conv_id, turn, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
), convs AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns)
), rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS pos, d, words FROM (
    SELECT c, pos, d, words FROM convs JOIN turns ON conv_id = c - c % 20 AND pos <= h UNION ALL SELECT c, pos, d, words FROM convs JOIN turns ON conv_id = c AND pos > h)
), paths AS (
  SELECT c, pos AS depth, string_agg(d, '') OVER (PARTITION BY c ORDER BY pos) AS path, words FROM rebuilt UNION ALL SELECT c, 0, '', 0 FROM convs
), nodes AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = last), '') AS ends
  FROM (SELECT *, max(depth) OVER (PARTITION BY c) AS last FROM paths) GROUP BY path, depth
), kids AS (
  SELECT path[:64 * (depth - 1)] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), known AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)
), subtree AS (
  SELECT path[:64 * k] AS path, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM known) GROUP BY 1
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM known f JOIN subtree s USING (path) LEFT JOIN known p ON f.depth > 0 AND p.path = f.path[:64 * (f.depth - 1)]
"""

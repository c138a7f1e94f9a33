"""Token-ID output: documents tokenised and packed into fixed-length rows.

Each task tokenises its own documents and packs them in windows of bounded size,
so nothing is shuffled and a hot source or a very long document changes nothing.
Documents longer than a row are cut into whole rows and a rest, without loss.
Packing is best-fit decreasing: longest piece first, each into the fullest row
that still has room, found by a segment tree over remaining capacities.

A packed row carries its ids as little-endian unsigned integers (16 bits where
the vocabulary and the padding id fit, else 32), the cumulative segment lengths,
the positions at which position ids restart, and which part of which document
each segment is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
PACKED = (
    "bin_id string, doc_ids array<long>, part_offsets array<long>, doc_tokens array<long>, cu_seqlens array<int>, "
    "position_resets array<int>, n_tokens int, token_ids binary"
)

_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
ARROW = pa.schema(
    [
        ("bin_id", pa.string()),
        ("doc_ids", _LONGS),
        ("part_offsets", _LONGS),
        ("doc_tokens", _LONGS),
        ("cu_seqlens", _INTS),
        ("position_resets", _INTS),
        ("n_tokens", pa.int32()),
        ("token_ids", pa.binary()),
    ]
)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def encoder(path: str):
    """A tiktoken encoding of the rank file at ``path``; texts hold no specials."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space (the pattern's, which is Unicode's) that are cut out of a
#: text before the pattern sees it: the pattern's recursion fails on very long ones.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN = 2000
_RUNS = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")


def token_ids(enc, text: str) -> list[int]:
    """The ids of a whole text, whatever its length. The pattern makes one piece of a
    run of white space, less its last character where something follows it; long
    runs are encoded as that piece, and the text between them by the pattern, which
    ends a piece at either end of such a run."""
    out, at = [], 0
    for run in _RUNS.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._core_bpe.encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + enc.encode_ordinary(text[at:])


class CapacityTree:
    """Rows by remaining capacity, in a segment tree over capacities 0 to ``top``.

    A node holds how many rows stand below it; ``fit(size)`` walks down to the
    smallest capacity of at least ``size`` that has a row.
    """

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def fit(self, size: int) -> tuple[int, int] | None:
        """Takes out and returns (row, capacity), the tightest fit, or None."""
        node = size + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(sizes: list[int], top: int) -> list[list[int]]:
    """Row contents as lists of indexes into ``sizes`` (each 1 to ``top``)."""
    tree, rows = CapacityTree(top), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if sizes[i] == top:
            rows.append([i])
            continue
        found = tree.fit(sizes[i])
        if found is None:
            rows.append([i])
            left = top - sizes[i]
            row = len(rows) - 1
        else:
            row, left = found[0], found[1] - sizes[i]
            rows[row].append(i)
        if left:
            tree.add(left, row)
    return rows


def pack_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    seq_len: int = 2048,
    vocabulary: str | None = None,
    end_id: int = END_OF_TEXT,
    window_tokens: int = 4_000_000,
) -> DataFrame:
    """Packed rows (see ``PACKED``) of all documents.

    Every document ends with ``end_id``; a null text is an empty one and gives
    that id alone, so no document is missing. ``part_offsets`` are the places of
    the segments in their documents' ids and ``doc_tokens`` the documents' whole
    lengths: segments of one document, ordered by offset, are its ids again. Rows
    shorter than ``seq_len`` are padded with ``end_id`` beyond ``n_tokens``. Null
    and repeated ids are carried as they are. An empty table gives no rows.
    """
    path = vocabulary or vocabulary_path()
    size_limit = max(end_id, max_id(path))
    dtype = "<u2" if size_limit < 1 << 16 else "<u4"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, n = encoder(path), TaskContext.get(), 0
        where = task.partitionId() if task else 0
        ids, offsets, lengths, pieces, held = [], [], [], [], 0
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.array([*token_ids(enc, body or ""), end_id], dtype)
                for at in range(0, len(tokens), seq_len):
                    ids.append(doc)
                    offsets.append(at)
                    lengths.append(len(tokens))
                    pieces.append(tokens[at : at + seq_len])
                held += len(tokens)
                if held >= window_tokens:
                    for frame in _rows(ids, offsets, lengths, pieces, seq_len, end_id, dtype, where, n):
                        n += frame.num_rows
                        yield frame
                    ids, offsets, lengths, pieces, held = [], [], [], [], 0
        if pieces:
            yield from _rows(ids, offsets, lengths, pieces, seq_len, end_id, dtype, where, n)

    chosen = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    return chosen.mapInArrow(packed, PACKED)


@lru_cache(maxsize=4)
def max_id(path: str) -> int:
    return encoder(path).max_token_value


def _rows(ids, offsets, lengths, pieces, seq_len, end_id, dtype, where, first) -> Iterator[pa.RecordBatch]:
    sizes = [len(x) for x in pieces]
    rows = best_fit_decreasing(sizes, seq_len)
    for at in range(0, len(rows), 1000):
        out = []
        for n, row in enumerate(rows[at : at + 1000]):
            cells = np.full(seq_len, end_id, dtype)
            ends = np.cumsum([sizes[i] for i in row])
            cells[: ends[-1]] = np.concatenate([pieces[i] for i in row])
            cu = [0, *ends.tolist()]
            out.append(
                (
                    f"{where}-{first + at + n}",
                    [ids[i] for i in row],
                    [offsets[i] for i in row],
                    [lengths[i] for i in row],
                    cu,
                    cu[:-1],
                    cu[-1],
                    cells.tobytes(),
                )
            )
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW.types, strict=True)], schema=ARROW)


def position_ids(cu_seqlens: list[int], seq_len: int) -> np.ndarray:
    """Position ids of one packed row: they restart with each segment, and the
    padding after the last segment restarts too."""
    out = np.arange(seq_len)
    for a, b in zip(cu_seqlens, [*cu_seqlens[1:], seq_len], strict=True):
        out[a:b] -= a
    return out


def write_matrices(packed: DataFrame, path: str, rows_per_file: int = 65536) -> None:
    """Write packed rows as Parquet files of at most ``rows_per_file`` rows: one
    fixed-width binary cell a row, which a loader maps to an id matrix."""
    packed.write.option("maxRecordsPerFile", rows_per_file).parquet(path)

"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``length`` (100) bytes that covers it also starts
earlier: in a document before, or in the same one further to the left; so it goes
if a suffix before it has a longest previous factor of ``length`` or more that
reaches it (``factors.py``: suffix order, previous and next smaller positions).

Sorting every suffix of the corpus is not possible within bounds. What is sorted:

1. Anchors. Each window of ``length`` bytes has an anchor, its rightmost k-gram of
   least hash; equal windows have equal anchors at equal places. Windows in a row
   with one anchor form a run. Per run one record (hash of the anchor, hash of the
   run's bytes, place) is dealt by the anchor's hash, about one for 39 bytes.
2. A run whose anchor is met nowhere else has no earlier factor of this length. Runs
   that equal an earlier run, by two 64-bit hashes, are covered whole. Runs whose
   anchor is met with other bytes, too, are open.
3. Open runs are cut out of the texts and dealt by anchor. Each bucket's runs are put
   one behind the other, and their suffixes in suffix order; where the longest
   previous factor reaches ``length`` it is covered.
4. Covered stretches go back to their documents, where they are united.

Before records are dealt, each task keeps only the earliest of equal runs it met,
so a passage that a third of all documents share arrives once per task. An anchor
with very many different runs would still be one task's work; its runs, from the
task that met too many of them or from step 2 on, go out as windows instead (two
64-bit hashes and a place each), dealt by hash, where the earliest of equal ones
stays. Data moves as packed arrays, one row per task and bucket, since a row per
record would cost more than its work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake.llm.factors import longest_previous_factors, packed_bytes
from leaselake.llm.staging import stage

LENGTH = 100
#: Bytes that are hashed in one piece; places in a piece take 20 bits.
PIECE = 1 << 20
#: Bytes of text after which a task deals out what it has met.
WINDOW_BYTES = 32 << 20
#: Bytes of open runs after which a task deals them out.
OPEN_BYTES = 16 << 20
#: Bytes of runs that are hashed window by window at a time.
WIDE_BYTES = 1 << 20
#: Different runs of one anchor above which they are dealt as windows.
RUNS_PER_ANCHOR = 500
#: The same within one task's ``WINDOW_BYTES``; less where there are very many tasks.
RUNS_PER_TASK = 64
#: Runs of one anchor that may come together from all tasks.
RUNS_TOGETHER = 4_000_000
#: Windows that are sorted together.
WINDOWS_AT_ONCE = 200_000
NO_ID = np.iinfo(np.int64).max

_rng = np.random.default_rng(1234)
BYTE_CODES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OTHER_CODES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64 for the places of a piece."""
    if base not in _POWERS:
        step = np.full(PIECE + 1, base, np.uint64)
        step[0] = 1
        _POWERS[base] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[base]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by running minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(right[:m], left[width - 1 : width - 1 + m])


def runs_of(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """Runs of the pieces ``[start, end)`` of a byte buffer of at most ``PIECE``:
    (anchor hash, hash of the run's bytes, first byte, end), ends exclusive."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    long_enough = ends - starts >= length
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return none
    n, k = len(buffer), min(24, length)
    up, down = _powers(BASE), _powers(_inverse(BASE))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[buffer] * up[:n], out=sums[1:])
    grams = _mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])
    place = np.arange(n - k + 1, dtype=np.uint64)
    low = np.uint64(PIECE - 1)
    keys = (grams & ~low) | (low - place)  # of equal hashes the rightmost is least
    anchor = (low - (_sliding_min(keys, length - k + 1) & low)).astype(np.int64)
    change = np.zeros(n + 1, np.int8)
    change[starts] += 1
    change[ends - length + 1] -= 1
    valid = np.cumsum(change, dtype=np.int8)[: n - length + 1].astype(bool)
    joined = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(valid & ~np.r_[False, joined])
    last = np.flatnonzero(valid & ~np.r_[joined, False])
    end = last + length
    size = (end - first).astype(np.uint64)
    body = _mixed((sums[end] - sums[first]) * down[first] + size * np.uint64(0x94D049BB133111EB))
    return grams[anchor[first]], body, first, end


def united(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping or touching stretches of each document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    far = int(end.max()) + 1  # documents one after the other on one line
    reach = np.maximum.accumulate(end + doc * far)
    new = np.r_[True, (start[1:] + doc[1:] * far > reach[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.r_[at[1:] - 1, len(doc) - 1]] - doc[at] * far


def covered_runs(anchor, body, doc, start, end):
    """Split runs, of documents numbered in their order, into
    (kept, covered): indexes of the earliest of equal runs, and of the others."""
    order = np.lexsort((start, doc, body, anchor))
    if not len(order):
        return order, order
    same = np.r_[False, (anchor[order][1:] == anchor[order][:-1]) & (body[order][1:] == body[order][:-1])]
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    moved = (doc[order] != doc[lead]) | (start[order] != start[lead])
    return order[~same], order[same & moved]


def covered_factors(content: np.ndarray, sizes: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int = LENGTH):
    """Stretches (doc, start, end) of the pieces of ``content`` that an earlier
    factor of at least ``length`` bytes covers. Pieces stand at ``start`` of their
    documents, which are numbered in order.

    Suffixes are worked on in groups by a hash of their first ``length`` bytes, so
    that no sort holds more than about ``WINDOWS_AT_ONCE`` of them.
    """
    many = np.maximum(sizes.astype(np.int64) - length + 1, 0)
    piece = np.repeat(np.arange(len(sizes), dtype=np.int32), many)
    step = (np.arange(len(piece)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)).astype(np.int32) if len(piece) else piece
    # earlier suffixes get smaller numbers
    order = np.lexsort((step, start.astype(np.int64)[piece] + step, doc.astype(np.int32)[piece])).astype(np.int32)
    piece, step = piece[order], step[order]
    del order
    own, place = doc.astype(np.int32)[piece], start.astype(np.int64)[piece] + step
    new = np.r_[True, (own[1:] != own[:-1]) | (place[1:] != place[:-1])] if len(own) else np.zeros(0, bool)
    piece, step, place, own = piece[new], step[new], place[new], own[new]  # a row that repeats is one document
    first = np.r_[0, np.cumsum(sizes.astype(np.int64))[:-1]]
    at, ends = first[piece] + step, (first + sizes)[piece]
    del piece, step, new
    packed = packed_bytes(content)
    groups = -(-len(at) // WINDOWS_AT_ONCE)
    if groups > 1:
        head = np.zeros(len(at), np.uint64)
        for k in range(0, length - 6, 7):  # equal beginnings have equal sums
            head = (head + packed[at + k]) * np.uint64(BASE)
        group = (_mixed(head) % np.uint64(groups)).astype(np.int32)
        dealt = np.argsort(group, kind="stable").astype(np.int32)
        del head
        parts = np.split(dealt, np.searchsorted(group[dealt], np.arange(1, groups)))
    else:
        parts = [np.arange(len(at))]
    reach = np.zeros(len(at), np.int64)
    for rows in parts:
        if len(rows) > 1:
            reach[rows] = longest_previous_factors(packed, at[rows], ends[rows], length)
    hit = np.flatnonzero(reach)
    return own[hit], place[hit], place[hit] + reach[hit]


def window_hashes(content: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each of the strings ``content[at : at + length]``."""
    out = []
    for codes, base in ((BYTE_CODES, BASE), (OTHER_CODES, OTHER_BASE)):
        step = np.uint64(base)
        found = np.zeros(len(at), np.uint64)
        for k in range(length):
            found = found * step + codes[content[at + k]]
        out.append(_mixed(found))
    return out[0], out[1]


def repeated_windows(w1: np.ndarray, w2: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """(kept, again): indexes of the earliest of equal windows, and of the others."""
    order = np.lexsort((start, doc, w2, w1))
    if not len(order):
        return order, order
    same = np.r_[False, (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])]
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    moved = (doc[order] != doc[lead]) | (start[order] != start[lead])
    return order[~same], order[same & moved]


# Packed rows -----------------------------------------------------------------

#: Columns of a packed row: documents, then groups of records that refer to them.
GROUPS = {
    "doc": ["anchor", "body", "start", "size"],  # runs
    "wdoc": ["w1", "w2", "wstart"],  # windows of anchors with very many runs
    "cdoc": ["cstart", "cend"],  # covered stretches
    "odoc": ["oanchor", "ostart", "oend", "omany"],  # open runs
    "bdoc": ["bstart", "bsize"],  # open runs' bytes, in ``content``
}
PACKED = ["part", "d1", "d2", *[n for d, own in GROUPS.items() for n in (d, *own)], "content", "hot"]
TYPES = {"d1": np.int64, "d2": np.int64, "content": np.uint8} | {n: np.uint64 for n in ("anchor", "body", "w1", "w2", "oanchor", "hot")}


SCHEMA = ", ".join(f"{n} {'int' if n == 'part' else 'binary'}" for n in PACKED)


def _is_doc(name: str) -> bool:
    return name in GROUPS


def _unpacked(batches: Iterator[pa.RecordBatch], names: list[str]) -> dict[str, np.ndarray]:
    """Columns of all rows put together, documents renumbered to one table that is
    in document order."""
    parts: dict[str, list[np.ndarray]] = {n: [] for n in ("d1", "d2", *names)}
    base = 0
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in parts), strict=True):
            cells = {n: np.frombuffer(x, TYPES.get(n, np.int32)) for n, x in zip(parts, row, strict=True)}
            for n, x in cells.items():
                parts[n].append(x.astype(np.int64) + base if _is_doc(n) else x)
            base += len(cells["d1"])
    return _ordered({n: np.concatenate([np.zeros(0, np.int64 if _is_doc(n) else TYPES.get(n, np.int32)), *x]) for n, x in parts.items()})


def _ordered(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Documents sorted and made distinct; what refers to them follows."""
    docs = np.empty(len(columns["d1"]), [("d1", np.int64), ("d2", np.int64)])
    docs["d1"], docs["d2"] = columns["d1"], columns["d2"]
    docs, number = np.unique(docs, return_inverse=True)
    out = {n: number.ravel()[x] if _is_doc(n) else x for n, x in columns.items()}
    out["d1"], out["d2"] = docs["d1"].copy(), docs["d2"].copy()
    return out


def _deal(c: dict[str, np.ndarray], target: dict[str, np.ndarray], parts: int, bodies: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """One packed row per bucket. ``target`` maps each document column (and ``hot``)
    that ``c`` holds to the bucket of each of its entries; ``bodies`` are the bytes
    of the entries of ``bdoc``."""
    orders = {d: np.argsort(t, kind="stable") for d, t in target.items()}
    cuts = {d: np.searchsorted(target[d][orders[d]], np.arange(parts + 1)) for d in target}
    for part in np.unique(np.concatenate([np.zeros(0, np.int64), *target.values()])).tolist():
        rows = {d: orders[d][cuts[d][part] : cuts[d][part + 1]] for d in target}
        docs = [d for d in rows if _is_doc(d)]
        used, number = np.unique(np.concatenate([np.zeros(0, np.int64), *[c[d][rows[d]] for d in docs]]), return_inverse=True)
        cells, at = {"d1": c["d1"][used], "d2": c["d2"][used]}, 0
        for d in docs:
            cells[d] = number[at : at + len(rows[d])]
            at += len(rows[d])
            for n in GROUPS[d]:
                cells[n] = c[n][rows[d]]
        if "hot" in rows:
            cells["hot"] = c["hot"][rows["hot"]]
        out = [pa.array([part], pa.int32())]
        for n in PACKED[1:]:
            if n == "content" and bodies is not None:
                cell = b"".join([bodies[i] for i in rows["bdoc"].tolist()])
            else:
                cell = np.ascontiguousarray(cells[n], TYPES.get(n, np.int32)).tobytes() if n in cells else b""
            out.append(pa.array([cell], pa.binary()))
        yield pa.RecordBatch.from_arrays(out, names=PACKED)


def _bucket(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes % np.uint64(parts)).astype(np.int64)


def _doc_part(columns: dict[str, np.ndarray], docs: np.ndarray, parts: int) -> np.ndarray:
    return (columns["d1"][docs] ^ columns["d2"][docs]) % parts


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)


def _split(rows: Iterator[tuple[int, int, bytes]], length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(d1, d2, offset, bytes): long texts in pieces that share length - 1 bytes."""
    for d1, d2, body in rows:
        for at in range(0, max(1, len(body) - length + 1), PIECE - length + 1):
            yield d1, d2, at, body[at : at + PIECE]


def _as_windows(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, length: int):
    """Columns ``wdoc, wstart, w1, w2`` of all windows of the pieces, but for those
    that repeat an earlier one among them, and (doc, start) of the latter."""
    sizes = np.array([len(x) for x in pieces], np.int64)
    many = np.maximum(sizes - length + 1, 0)
    piece = np.repeat(np.arange(len(sizes)), many)
    step = np.arange(len(piece)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
    at = np.r_[0, np.cumsum(sizes)[:-1]][piece] + step
    w1, w2 = window_hashes(np.frombuffer(b"".join(pieces), np.uint8), at, length)
    own, place = doc[piece], start[piece] + step
    kept, again = repeated_windows(w1, w2, own, place)
    return {"wdoc": own[kept], "wstart": place[kept], "w1": w1[kept], "w2": w2[kept]}, own[again], place[again]


def _run_records(length: int, parts: int, per_task: int):
    """Task: texts to packed runs, dealt by anchor. Runs of an anchor that the task
    met with more than ``per_task`` bodies go as windows, and mark the anchor."""

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        columns = {n: np.concatenate([h[n] for h in held]) for n in ("d1", "d2", "anchor", "body", "start", "size")}
        base = np.r_[0, np.cumsum([len(h["d1"]) for h in held])[:-1]]
        columns["doc"] = np.concatenate([h["doc"] + b for h, b in zip(held, base, strict=True)])
        texts, offsets = [x for h in held for x in h["texts"]], np.concatenate([h["offsets"] for h in held])
        given = columns["doc"]  # the piece of each run
        c = _ordered(columns)
        end = c["start"] + c["size"]
        kept, gone = covered_runs(c["anchor"], c["body"], c["doc"], c["start"], end)
        c["cdoc"], c["cstart"], c["cend"] = united(c["doc"][gone], c["start"][gone], end[gone])
        _, which, count = np.unique(c["anchor"][kept], return_inverse=True, return_counts=True)
        busy = count[which] > per_task
        wide, kept = kept[busy], kept[~busy]
        step = max(1, WIDE_BYTES // (2 * length))
        for part in (wide[i : i + step] for i in range(0, len(wide), step)):
            at = c["start"][part] - offsets[given[part]]
            pieces = [texts[p][a : a + n] for p, a, n in zip(given[part].tolist(), at.tolist(), c["size"][part].tolist(), strict=True)]
            windows, doc, place = _as_windows(pieces, c["doc"][part], c["start"][part], length)
            found = {"d1": c["d1"], "d2": c["d2"], "hot": np.unique(c["anchor"][part])} | windows
            found["cdoc"], found["cstart"], found["cend"] = united(doc, place, place + length)
            yield from _deal(found, {"wdoc": _bucket(found["w1"], parts), "hot": _bucket(found["hot"], parts), "cdoc": _doc_part(c, found["cdoc"], parts)}, parts)
        for n in ("anchor", "body", "doc", "start", "size"):
            c[n] = c[n][kept]
        yield from _deal(c, {"doc": _bucket(c["anchor"], parts), "cdoc": _doc_part(c, c["cdoc"], parts)}, parts)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, piece, filled = [], 0, [], 0

        def hashed() -> dict:
            sizes = np.array([len(x[3]) for x in piece])
            ends = np.cumsum(sizes)
            anchor, body, first, end = runs_of(np.frombuffer(b"".join(x[3] for x in piece), np.uint8), ends - sizes, ends, length)
            doc = np.searchsorted(ends, first, "right")
            offsets = np.array([x[2] for x in piece], np.int64)
            return {
                "d1": np.array([x[0] for x in piece], np.int64),
                "d2": np.array([x[1] for x in piece], np.int64),
                "texts": [x[3] for x in piece],
                "offsets": offsets,
                "anchor": anchor,
                "body": body,
                "doc": doc,
                "start": first + (offsets - (ends - sizes))[doc],
                "size": end - first,
            }

        for part in _split(_texts(batches), length):
            if len(part[3]) < length:
                continue
            if filled + len(part[3]) > PIECE:
                held.append(hashed())
                size += filled
                piece, filled = [], 0
                if size >= WINDOW_BYTES:
                    yield from emit(held)
                    held, size = [], 0
            piece.append(part)
            filled += len(part[3])
        if piece:
            held.append(hashed())
        if held:
            yield from emit(held)

    return runs


def _match_runs(parts: int):
    """Task: the runs of one bucket of anchors to covered stretches and open runs,
    dealt by document. Windows pass through, in their bucket."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for d in ("doc", "cdoc", "wdoc") for n in (d, *GROUPS[d])]
        c = _unpacked(batches, [*names, "hot"])
        if not len(c["d1"]):
            return
        end = c["start"].astype(np.int64) + c["size"]
        kept, gone = covered_runs(c["anchor"], c["body"], c["doc"], c["start"], end)
        stretches = [np.concatenate([c[n], x[gone]]) for n, x in (("cdoc", c["doc"]), ("cstart", c["start"]), ("cend", end))]
        c["cdoc"], c["cstart"], c["cend"] = united(*stretches)
        # kept is sorted by anchor: those met with different bytes are open
        _, which, count = np.unique(c["anchor"][kept], return_inverse=True, return_counts=True)
        hot = np.isin(c["anchor"][kept], c["hot"]) | (count[which] > RUNS_PER_ANCHOR)
        still = kept[(count[which] > 1) | hot]
        c["odoc"], c["ostart"], c["oend"], c["oanchor"] = c["doc"][still], c["start"][still], end[still], c["anchor"][still]
        c["omany"] = hot[(count[which] > 1) | hot]
        target = {d: _doc_part(c, c[d], parts) for d in ("cdoc", "odoc")} | {"wdoc": _bucket(c["w1"], parts)}
        yield from _deal(c, target, parts)

    return matched


def _read_found(blobs: list[pa.RecordBatch]):
    """Covered stretches and open runs by document: (d1, d2) to a slice of each."""
    c = _unpacked(iter(blobs), [n for d in ("cdoc", "odoc") for n in (d, *GROUPS[d])])
    out = {}
    for d in ("cdoc", "odoc"):
        order = np.argsort(c[d], kind="stable")
        cut = np.searchsorted(c[d][order], np.arange(len(c["d1"]) + 1))
        out[d] = cut, [c[n][order] for n in GROUPS[d]]
    return {k: i for i, k in enumerate(zip(c["d1"].tolist(), c["d2"].tolist(), strict=True))}, out


def _with_found(batches: Iterator[pa.RecordBatch], each):
    """Rows of one bucket of documents: packed rows come first, then the texts."""
    blobs, table = [], None
    for batch in batches:
        kind = batch.column(0).to_numpy()
        packed = int((kind == 0).sum())
        if packed:
            blobs.append(pa.RecordBatch.from_arrays([batch.column(n).slice(0, packed) for n in PACKED], names=PACKED))
        if packed < batch.num_rows:
            if table is None:
                table = _read_found(blobs)
                blobs = []
            yield from each(table, batch.slice(packed))


def _open_runs(length: int, parts: int):
    """Task: texts and their open runs to the runs' bytes, dealt by anchor; runs of
    anchors with very many go as windows, dealt by hash."""

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        d1, d2, start, anchor, many, body = zip(*held, strict=True)
        doc, start, many = np.arange(len(held)), np.array(start, np.int64), np.array(many, bool)
        few = np.flatnonzero(~many)
        c = {"d1": np.array(d1), "d2": np.array(d2), "bdoc": few, "bstart": start[few]}
        bodies = [body[i] for i in few.tolist()]
        c["bsize"] = np.array([len(x) for x in bodies])
        target = {"bdoc": _bucket(np.array(anchor, np.uint64)[few], parts)}
        if many.any():
            number = _ordered({"d1": c["d1"], "d2": c["d2"], "doc": doc})  # windows are kept by document order
            windows, gone, place = _as_windows([body[i] for i in np.flatnonzero(many).tolist()], number["doc"][many], start[many], length)
            c |= {"d1": number["d1"], "d2": number["d2"], "bdoc": number["doc"][few]} | windows
            c["cdoc"], c["cstart"], c["cend"] = united(gone, place, place + length)
            target |= {"wdoc": _bucket(c["w1"], parts), "cdoc": _doc_part(c, c["cdoc"], parts)}
        yield from _deal(c, target, parts, bodies)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], [0]

        def each(table, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            number, found = table
            cut, (anchors, starts, ends, many) = found["odoc"]
            d1s, d2s, texts = (batch.column(n) for n in ("t1", "t2", "utf8"))
            for k, key in enumerate(zip(d1s.to_pylist(), d2s.to_pylist(), strict=True)):
                i = number.get(key)
                if i is None or cut[i] == cut[i + 1]:
                    continue
                text = texts[k].as_py()
                for j in range(cut[i], cut[i + 1]):
                    a, b = int(starts[j]), int(ends[j])
                    held.append((*key, a, int(anchors[j]), bool(many[j]), text[a:b]))
                    size[0] += (b - a) * (max(1, OPEN_BYTES // WIDE_BYTES) if many[j] else 1)
                if size[0] >= OPEN_BYTES:
                    yield from emit(held)
                    held.clear()
                    size[0] = 0

        yield from _with_found(batches, each)
        if held:
            yield from emit(held)

    return opened


def _match_factors(length: int, parts: int):
    """Task: the open runs of one bucket by their longest previous factors, and its
    windows by their hashes, to covered stretches dealt by document."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for d in ("bdoc", "cdoc", "wdoc") for n in (d, *GROUPS[d])]
        c = _unpacked(batches, [*names, "content"])
        if not len(c["d1"]):
            return
        doc, start, end = covered_factors(c["content"], c["bsize"], c["bdoc"], c["bstart"], length)
        _, again = repeated_windows(c["w1"], c["w2"], c["wdoc"], c["wstart"])
        place = c["wstart"][again].astype(np.int64)
        stretches = ((c["cdoc"], c["cstart"], c["cend"]), (doc, start, end), (c["wdoc"][again], place, place + length))
        c["cdoc"], c["cstart"], c["cend"] = united(*(np.concatenate(x) for x in zip(*stretches, strict=True)))
        yield from _deal(c, {"cdoc": _doc_part(c, c["cdoc"], parts)}, parts)

    return matched


RESULT = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT_ARROW = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPAN)])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each(table, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number, found = table
        cut, (starts, ends) = found["cdoc"]
        ids, d1s, d2s, texts = (batch.column(n) for n in ("id", "t1", "t2", "utf8"))
        rows = []
        for k, key in enumerate(zip(d1s.to_pylist(), d2s.to_pylist(), strict=True)):
            text, i = texts[k].as_py(), number.get(key)
            spans = []
            if i is not None and cut[i] < cut[i + 1]:
                a, b = starts[cut[i] : cut[i + 1]].astype(np.int64), ends[cut[i] : cut[i + 1]].astype(np.int64)
                _, a, b = united(np.zeros(len(a), np.int64), a, b)
                spans = list(zip(a.tolist(), b.tolist(), strict=True))
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(memoryview(text)[at:a])
                at = b
            digest.update(memoryview(text)[at:])
            rows.append(
                {
                    "_id": ids[k].as_py(),
                    "n_bytes": len(text),
                    "n_removed": sum(b - a for a, b in spans),
                    "n_spans": len(spans),
                    "kept_sha256": digest.hexdigest(),
                    "spans": [{"start": a, "end": b} for a, b in spans],
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=RESULT_ARROW)

    yield from _with_found(batches, each)


def _beside(texts: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """Packed rows and texts of each bucket of documents, packed rows first."""
    none = F.lit(None)
    left = found.select(F.lit(0).alias("kind"), *[F.col(n) for n in PACKED], none.cast("long").alias("id"), none.cast("long").alias("t1"), none.cast("long").alias("t2"), none.cast("binary").alias("utf8"))
    right = texts.select(
        F.lit(1).alias("kind"), F.pmod(F.col("t1").bitwiseXOR(F.col("t2")), F.lit(parts)).cast("int").alias("part"), *[none.cast("binary").alias(n) for n in PACKED[1:]], "id", "t1", "t2", "utf8"
    )
    return left.unionByName(right).repartitionById(parts, F.col("part")).sortWithinPartitions("kind")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, bucket_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` and ``spans`` (byte offsets of the removed runs).

    Null text is empty. Documents stand in order of id, null last; rows that share
    an id but not their text are ordered by a hash of it, and rows that repeat id
    and text are one document, with one verdict. Texts shorter than ``length``
    lose nothing. An empty table gives an empty result.
    """
    body = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("t1"), body.alias("utf8")).withColumn("t2", F.xxhash64("utf8"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    per_task = min(RUNS_PER_TASK, max(4, RUNS_TOGETHER // max(1, total // WINDOW_BYTES)))
    runs = texts.select("t1", "t2", "utf8").mapInArrow(_run_records(length, parts, per_task), SCHEMA)
    found = stage(runs.repartitionById(parts, F.col("part")).mapInArrow(_match_runs(parts), SCHEMA), "repeats-found")
    opened = _beside(texts, found, parts).mapInArrow(_open_runs(length, parts), SCHEMA)
    windows = found.where(F.octet_length("w1") > 0).withColumns({n: F.lit(b"") for n in ("cdoc", "cstart", "cend")})
    more = stage(opened.unionByName(windows).repartitionById(parts, F.col("part")).mapInArrow(_match_factors(length, parts), SCHEMA), "repeats-factors")
    out = _beside(texts, found.unionByName(more), parts).mapInArrow(_finish, RESULT)
    return out.withColumnRenamed("_id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``(id_col, kept)``: the bytes each document keeps, as binary, since a cut may
    fall inside a character."""
    spans = repeated_spans(docs, id_col, text, **params).select(F.col(id_col).alias("_id"), "spans")
    body = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    joined = docs.select(F.col(id_col), body.alias("_body")).join(spans, F.col(id_col).eqNullSafe(F.col("_id")))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    starts = F.concat(F.col("spans.start"), F.array(F.octet_length("_body").cast("long")))
    parts = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda s: F.hex(F.substr(F.col("_body"), (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))))
    return joined.select(id_col, F.unhex(F.array_join(parts, "")).alias("kept"))


SQL = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k
  FROM (SELECT doc_id, h, unnest(range(CAST(length(h) / 2 - 99 AS BIGINT))) AS i FROM bytes WHERE length(h) >= 200)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM later
), numbered AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans
), cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
    string_agg(substr(h, CAST(2 * c + 1 AS BIGINT), CAST(2 * (a - c) AS BIGINT)), '' ORDER BY a) AS head
  FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)
"""

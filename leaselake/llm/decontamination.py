"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A document is contaminated by a test item if a passage of it aligns with the whole
item with similarity of at least ``threshold`` (0.8): the local alignment scores 1
for an equal word and -1 for a changed, added or left-out word, and similarity is
``(words + score) / (2 * words)``, so a fifth of the words may be changed.

Seeds lose nothing. A passage that reaches the threshold lost at most
``b = 2 * (1 - threshold) * words`` points. A point spoils at most ``n - 1`` of the
item's n-grams (an added word costs one point and breaks ``n - 1``; a changed word
costs two and breaks ``n``; a missing end costs one a word and breaks one), so any
``b * max(1, n - 1) + 1`` n-grams keep one that the passage still holds. The
rarest of each item's n-grams, by documents of the whole corpus that hold them,
are its seeds; items too short for n = 3 use shorter n-grams.

The items are taken in blocks of ``block_chars`` (16 million) characters, more than
most sets of benchmarks have in all. Each block is sent to the tasks, which read
the corpus once to count its n-grams and once to seed and align; so the number of
scans is twice that of blocks, and the memory of a task does not grow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
FLAGGED = "_id {id_type}, item_id long, similarity double, first_word int, last_word int"
#: Cells of the alignment matrices that are worked on together.
CELLS_AT_ONCE = 1 << 20


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def points_to_lose(n_words: int, threshold: float) -> int:
    return int(2 * (1 - threshold) * n_words + 1e-9)


def seeds_needed(n_words: int, n: int, threshold: float) -> int:
    return points_to_lose(n_words, threshold) * max(1, n - 1) + 1


def seed_length(n_words: int, threshold: float, longest: int = 3) -> int:
    """The longest n whose n-grams cannot all be spoilt by the points allowed."""
    fits = (n for n in range(min(longest, n_words), 1, -1) if seeds_needed(n_words, n, threshold) <= n_words - n + 1)
    return next(fits, 1)


class Items:
    """One block of test items as word numbers, with its n-grams.

    Word 0 is any word that no item of the block has. An n-gram is its words'
    numbers in base ``len(vocabulary) + 1``: exact for blocks of up to two million
    distinct words, beyond that modulo 2**64, where two n-grams of one code only
    propose a stretch more to align.
    """

    def __init__(self, rows: list[tuple[int | None, str | None]], threshold: float):
        self.threshold = threshold
        self.number: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        for item, text in rows:
            words = words_of(text)
            if words:
                self.ids.append(item)
                self.words.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words]))
        self.base = len(self.number) + 1
        self.lengths = [seed_length(len(w), threshold) for w in self.words]
        self.grams = {n: np.unique(np.concatenate([self.codes(w, n) for w, m in zip(self.words, self.lengths, strict=True) if m == n])) for n in sorted(set(self.lengths))}

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    def codes(self, words: np.ndarray, n: int) -> np.ndarray:
        """Code of the n-gram at each place, 0 where a word is unknown."""
        if len(words) < n:
            return np.zeros(0, np.int64)
        size = len(words) - n + 1
        out, known = np.zeros(size, np.int64), np.ones(size, bool)
        for k in range(n):
            part = words[k : k + size]
            out = out * self.base + part
            known &= part > 0
        return np.where(known, out, 0)

    def hits(self, words: np.ndarray, n: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words`` and indexes into sorted ``grams`` that match."""
        codes = self.codes(words, n)
        place = np.flatnonzero(codes)
        at = np.minimum(np.searchsorted(grams, codes[place]), len(grams) - 1)
        same = grams[at] == codes[place]
        return place[same], at[same]

    def choose(self, counted: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Each item's rarest n-grams, by their documents in ``counted[n]``, sorted
        (grams, documents), where absent means none: ``seeds[n]`` is (grams, start of each gram's
        uses, item of each use, place of each use in the item)."""
        uses: dict[int, list[tuple[int, int, int]]] = {}
        for i, (words, n) in enumerate(zip(self.words, self.lengths, strict=True)):
            codes = self.codes(words, n)
            need = seeds_needed(len(words), n, self.threshold)
            grams, docs = counted.get(n, (codes[:0], codes[:0]))
            place = np.minimum(np.searchsorted(grams, codes), max(len(grams) - 1, 0))
            often = np.where(grams[place] == codes, docs[place], 0) if len(grams) else np.zeros(len(codes), np.int64)
            rarest = np.argsort(often, kind="stable")[:need].tolist()
            uses.setdefault(n, []).extend((int(codes[k]), i, k) for k in rarest)
        self.seeds = {}
        for n, found in uses.items():
            table = np.array(sorted(found), np.int64)
            grams, first = np.unique(table[:, 0], return_index=True)
            self.seeds[n] = (grams, np.r_[first, len(table)], table[:, 1], table[:, 2])

    def windows(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of the stretches of a document to align: around each
        seed, on the diagonals that the allowed points reach; overlapping ones of an
        item become one stretch."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for n, (grams, first, item, at) in self.seeds.items():
            for place, g in zip(*self.hits(words, n, grams), strict=True):
                for u in range(first[g], first[g + 1]):
                    i = int(item[u])
                    length = len(self.words[i])
                    e = points_to_lose(length, self.threshold)
                    start = int(place - at[u])
                    spans.setdefault(i, []).append((max(0, start - e), min(len(words), start + length + e)))
        out = []
        for i, found in spans.items():
            start, end = None, -1
            for a, b in sorted(found):
                if start is not None and a <= end:
                    end = max(end, b)
                    continue
                if start is not None:
                    out.append((i, start, end))
                start, end = a, b
            out.append((i, start, end))
        return out


def align(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of ``item`` with each row of ``texts`` (-1 pads),
    and the column at which it ends. One matrix row at a time for all texts; the
    gaps along a row are a running maximum."""
    width = texts.shape[1]
    column = np.arange(1, width + 1)
    above = np.zeros((len(texts), width + 1), np.int32)
    best, where = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int64)
    for word in item:
        step = np.where(texts == word, 1, -1)
        row = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] - 1), 0)
        row = np.maximum.accumulate(row + column, axis=1) - column
        above[:, 1:] = row
        end = row.argmax(axis=1)
        top = row[np.arange(len(texts)), end]
        better = top > best
        best, where = np.where(better, top, best), np.where(better, end, where)
    return best, where


def flagged_passages(items: Items, texts: list[str | None]) -> list[tuple[int, int | None, float, int, int]]:
    """(index of text, item_id, similarity, first word, last word) of every
    stretch of the texts whose similarity reaches the threshold."""
    work: dict[tuple[int, int], list[tuple[int, int, np.ndarray]]] = {}
    for k, text in enumerate(texts):
        words = items.numbers(text)
        for i, a, b in items.windows(words):
            # stretches of like width are padded to one width and aligned together
            work.setdefault((i, (b - a - 1).bit_length()), []).append((k, a, words[a:b]))
    out = []
    for (i, _), found in sorted(work.items()):
        item = items.words[i]
        width = max(len(x[2]) for x in found)
        step = max(1, CELLS_AT_ONCE // width)
        for at in range(0, len(found), step):
            part = found[at : at + step]
            block = np.full((len(part), width), -1, np.int64)
            for row, (_, _, words) in zip(block, part, strict=True):
                row[: len(words)] = words
            score, end = align(item, block)
            similarity = (len(item) + score) / (2 * len(item))
            for j in np.flatnonzero(similarity >= items.threshold - 1e-12):
                k, a, _ = part[j]
                last = a + int(end[j])
                out.append((k, items.ids[i], float(similarity[j]), max(0, last - len(item) + 1), last))
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text: str, block_chars: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about ``block_chars`` characters, so that what is
    sent to the tasks at once is bounded whatever the benchmark's size."""
    sized = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text).cast("string").alias("words")).where(F.length("words") > 0)
    total = sized.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    n = -(-total // block_chars)
    for b in range(n):
        mine = sized.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == b) if n > 1 else sized
        yield [(r["item"], r["words"]) for r in mine.orderBy("item", "words").collect()]


def contaminated_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = 0.8,
    block_chars: int = 16_000_000,
) -> DataFrame | None:
    """``(_id, item_id, similarity, first_word, last_word)``, one row for each
    passage that reaches the threshold; None if no item has text."""
    kind = dict(docs.dtypes)[id_col]
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text"))
    sc, found = docs.sparkSession.sparkContext, None
    for rows in item_blocks(benchmark, item_id, item_text, block_chars):
        items = Items(rows, threshold)
        if not items.words:
            continue
        sent = sc.broadcast(items)

        def counts(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block, total = sent.value, {}
            for batch in batches:
                for text_ in batch.column(0).to_pylist():
                    words = block.numbers(text_)
                    for n, grams in block.grams.items():
                        if n not in total:
                            total[n] = np.zeros(len(grams), np.int64)
                        total[n][np.unique(block.hits(words, n, grams)[1])] += 1
            for n, count in total.items():
                seen = np.flatnonzero(count)
                yield pa.record_batch({"n": np.full(len(seen), n, np.int32), "gram": block.grams[n][seen], "docs": count[seen]})

        counted = chosen.select("_text").mapInArrow(counts, "n int, gram long, docs long").groupBy("n", "gram").agg(F.sum("docs").alias("docs"))
        # bounded by the n-grams of one block of items: columns, not rows
        found_counts = counted.toArrow()
        sizes, grams, docs_with = (found_counts.column(c).to_numpy() for c in ("n", "gram", "docs"))
        order = np.argsort(grams, kind="stable")
        items.choose({int(n): (grams[mine], docs_with[mine]) for n in np.unique(sizes) for mine in [order[sizes[order] == n]]})
        ready = sc.broadcast(items)

        def passages(batches: Iterator[pa.RecordBatch], sent=ready) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = flagged_passages(sent.value, batch.column(1).to_pylist())
                if hit:
                    at, *rest = map(list, zip(*hit, strict=True))
                    types = (pa.int64(), pa.float64(), pa.int32(), pa.int32())
                    cells = [batch.column(0).take(pa.array(at)), *map(pa.array, rest, types)]
                    yield pa.RecordBatch.from_arrays(cells, names=["_id", "item_id", "similarity", "first_word", "last_word"])

        part = chosen.mapInArrow(passages, FLAGGED.format(id_type=kind))
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """One row per document: ``id_col``, ``contaminated``, ``item_id`` and
    ``similarity`` of the best item (ties: smallest item_id), ``n_items``.

    Null, empty and clean texts are not contaminated: item and similarity are
    null and ``n_items`` 0. Items without a word are ignored. Item ids are cast to
    long; items whose id is null (or no number) flag documents like any other, are
    named null, and count as one in ``n_items``. Rows that repeat an id share one
    verdict, the worst; rows with a null id likewise. Empty tables
    give an empty result, or one with nothing flagged.
    """
    ids = docs.select(F.col(id_col).alias("_id"))
    found = contaminated_passages(docs, benchmark, id_col, **params)
    if found is None:
        found = ids.limit(0).select("_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"))
    per_item = found.groupBy("_id", "item_id").agg(F.max("similarity").alias("similarity"))
    best = per_item.groupBy(F.col("_id").alias("_found")).agg(
        F.max(F.struct("similarity", (-F.col("item_id")).alias("item"))).alias("best"), F.count(F.lit(1)).alias("n_items")
    )
    return ids.join(best, F.col("_id").eqNullSafe(F.col("_found")), "left").select(
        F.col("_id").alias(id_col),
        F.col("best").isNotNull().alias("contaminated"),
        (-F.col("best.item")).alias("item_id"),
        F.col("best.similarity").alias("similarity"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """``docs`` without the documents that hold a copy of a test item; all columns
    are kept. Rows with a null id are kept unless a null-id row is flagged."""
    found = contaminated_passages(docs, benchmark, id_col, **params)
    if found is None:
        return docs
    gone = found.select(F.col("_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")

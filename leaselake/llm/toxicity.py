"""Toxicity scores from a convolutional text classifier trained in numpy.

A word is the mean of hashed embeddings of itself and of its first three to six
letters, so that unseen forms of a known word still count. Filters of several
widths slide over the whole text, each filter keeps its largest response, and a
linear layer turns the responses into a score.

The model is fitted on all labelled rows outside the held-out part. A few small
networks are trained, each without one part of the rows; that part's responses set the
decision cut and each language's threshold, and the networks are put side by side as
one. Rows are dealt to at most ``SHARDS`` tasks, each of which streams its own through
the networks; after each round the tasks' networks are averaged in the cluster. One
task is plain training; a sample is taken only if ``TrainingBounds`` are asked for. Scoring runs in the tasks over whole texts. Per word it adds
rows of a table of filter responses, computed once per distinct word and batch of
work, so the cost of a text is linear in its words.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaselake.llm.sampling import bounded_texts
from leaselake.llm.staging import drop_staged, stage

WORD = re.compile(r"\w+")
THRESHOLD = 0.7
#: Words whose filter responses or feature buckets a task keeps at a time.
WORDS_KEPT = 1 << 16
#: Words that are convolved at a time: of one text, and of several short ones.
WORDS_AT_ONCE, WORDS_TOGETHER = 1 << 15, 1 << 13
#: Rows a task is fitted on, if there are no more than fill so many tasks; row visits of a
#: network below which rows are passed more than twice.
ROWS_PER_SHARD, SHARDS, VISITS = 8000, 16, 32_000
#: Buckets whose embeddings are averaged together, and steps of a logit in the calibration.
BLOCK, STEPS = 4096, 256
#: Bits that labelled ids share: 4 MB.
MARKS = 1 << 25
#: Odd factors of a sum of feature buckets.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@dataclass(frozen=True)
class TrainingBounds:
    """How many labelled rows, and how much text of them, a trial fit takes."""

    toxic_rows: int = 3000
    clean_rows: int = 5000
    chars_per_label: int = 20_000_000


@dataclass
class Model:
    """Hashed embeddings, filters ``[width][offset]`` and the linear layer."""

    embeddings: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    cut: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @property
    def widths(self) -> list[int]:
        return [len(f) for f in self.filters]

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        """Score in 0 to 1; the decision cut lands on ``THRESHOLD``."""
        z = np.clip(self.scale * (logit - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)
        return 1 / (1 + np.exp(-z))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class _Numbers:
    """Numbers of the words met so far, in the order in which they came."""

    def __init__(self):
        self.number = defaultdict(count().__next__)

    def __len__(self) -> int:
        return len(self.number)

    def of(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """Each word's number, and the words that were not met before."""
        base = len(self.number)
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return found, [*islice(reversed(self.number), len(self.number) - base)][::-1]


def _crc_table() -> np.ndarray:
    """The CRC-32 of each byte, without the inversions before and after."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> 1) ^ np.where(crc & 1, np.uint32(0xEDB88320), np.uint32(0))
    return crc


CRC, ONES = _crc_table(), np.uint32(0xFFFFFFFF)


def features(words: list[str], buckets: int) -> np.ndarray:
    """Five numbers a word: the bucket of its CRC-32, of ``^`` and its first three letters, and of
    ``^`` and four to six if it has more; 0, which is no bucket, in place of missing ones."""
    coded = [w.encode("utf-8", "surrogatepass") for w in words]
    whole = np.fromiter(map(zlib.crc32, coded), np.int64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer(b"".join(coded) + b"\0", np.uint8)
    letters = np.flatnonzero((text & 0xC0) != 0x80)  # where a letter begins; the last is the end
    first = np.cumsum(size) - size
    out = np.zeros((len(words), 5), np.int64)
    out[:, 0] = 1 + whole % (buckets - 1)
    at, crc = letters[first], np.full(len(words), np.uint32(zlib.crc32(b"^")) ^ ONES)
    for n in range(1, 7):
        end = letters[first + np.minimum(n, size)]
        while (on := at < end).any():  # one step, or as many as the longest letter has bytes
            crc = np.where(on, CRC[(crc ^ text[at]) & 0xFF] ^ (crc >> 8), crc)
            at = at + on
        if n > 2:
            out[:, n - 2] = np.where((size > n) | (n == 3), 1 + (crc ^ ONES).astype(np.int64) % (buckets - 1), 0)
    return out


class _Corpus:
    """Training texts as word numbers, with each word's feature buckets."""

    def __init__(self, texts: list[str | None], buckets: int):
        number: dict[str, int] = {}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)] or [number.setdefault("", len(number))]) for t in texts]
        self.feats = features(list(number), buckets)
        self.counts = (self.feats > 0).sum(axis=1, keepdims=True)

    @classmethod
    def of(cls, words: list[bytes], feats: list[bytes]) -> _Corpus:
        """Of texts as ``Encoder`` writes them."""
        self = cls.__new__(cls)
        own = [_ints(f).reshape(-1, 5) for f in feats]
        self.feats, at = _distinct_rows(np.concatenate(own))
        ends = np.cumsum([len(f) for f in own])
        self.docs = [at[end - len(f) :][_ints(w)] for w, f, end in zip(words, own, ends.tolist(), strict=True)]
        self.counts = (self.feats > 0).sum(axis=1, keepdims=True)
        return self


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers, and each row's place among them."""
    _, at = np.unique(rows.astype(np.uint64) @ MIX[: rows.shape[1]], return_inverse=True)
    place = np.empty(int(at.max()) + 1 if len(at) else 0, np.int64)
    place[at] = np.arange(len(at))
    if (rows[place][at] != rows).any():  # two rows with one sum
        found, at = np.unique(rows, axis=0, return_inverse=True)
        return found, at.ravel()
    return rows[place], at


def _distinct(numbers: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.unique`` with the inverse, for numbers under ``below``, without a sort."""
    met = np.zeros(below, bool)
    met[numbers] = True
    return np.flatnonzero(met), (np.cumsum(met) - 1)[numbers]


class Encoder:
    """Writes a text's words as numbers, and the feature buckets of each number; keeps
    the buckets of the words it has met."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self._forget()

    def _forget(self) -> None:
        self.known, self.feats = _Numbers(), np.zeros((1024, 5), np.int32)

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text, in order; words of several short texts are looked up together."""
        flat: list[str] = []
        sizes: list[int] = []
        for text in texts:
            words = words_of(text) or [""]
            if flat and len(flat) + len(words) > WORDS_TOGETHER:
                yield from self._written(flat, sizes)
                flat, sizes = [], []
            flat += words
            sizes.append(len(words))
        if flat:
            yield from self._written(flat, sizes)

    def _written(self, flat: list[str], sizes: list[int]) -> Iterator[tuple[bytes, bytes]]:
        if len(self.known) > WORDS_KEPT:
            self._forget()
        base = len(self.known)
        found, new = self.known.of(flat)
        while base + len(new) > len(self.feats):
            self.feats = np.vstack([self.feats, np.zeros_like(self.feats)])
        if new:
            self.feats[base : base + len(new)] = features(new, self.buckets)
        for own in np.split(found, np.cumsum(sizes)[:-1]):
            own, words = np.unique(own, return_inverse=True)
            yield _packed(words), _packed(self.feats[own])


def _packed(x: np.ndarray) -> bytes:
    """Numbers in two bytes each, or in four if one is too large, compressed."""
    small = x.max() < 1 << 16
    return (b"2" if small else b"4") + zlib.compress(x.astype(np.uint16 if small else np.int32).tobytes(), 1)


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), np.uint16 if data[:1] == b"2" else np.int32).astype(np.int64)


def train(
    texts: list[str | None],
    labels: np.ndarray,
    langs: list[str | None],
    folds: np.ndarray,
    buckets: int = 1 << 15,
    dim: int = 12,
    per_width: int = 4,
    widths: tuple[int, ...] = (1, 2, 3),
    epochs: int = 4,
    batch: int = 64,
    seed: int = 3,
) -> Model:
    """One network for each value of ``folds``, fitted on the other rows; cut and
    thresholds are calibrated on what each says of its own fold. With one label
    only, all texts score alike, below the threshold."""
    labels = np.asarray(labels, np.float64)
    corpus = _Corpus(texts, buckets)
    members, unseen = [], np.full(len(labels), np.nan)
    for k in np.unique(folds).tolist():
        fit, own = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
        if not 0 < labels[fit].sum() < len(fit):
            continue
        rng = np.random.default_rng(seed + len(members))
        model = _drawn(rng, buckets, dim, per_width, widths)
        with_, without = (_bucket_counts(corpus, fit[labels[fit] == k], buckets) for k in (1, 0))
        _start_from_counts(model, with_, without, labels[fit].sum(), len(fit) - labels[fit].sum())
        _fit(model, corpus, labels, fit, epochs, batch, rng)
        unseen[own] = _logits(model, corpus, own)
        members.append(model)
    if not members:
        return _constant(buckets, widths)
    model = side_by_side(members)
    known = np.flatnonzero(~np.isnan(unseen))
    _calibrate(model, unseen[known], labels[known], [langs[i] for i in known.tolist()])
    return model


def _constant(buckets: int, widths: tuple[int, ...]) -> Model:
    """Nothing to learn from: one score for all, below the threshold."""
    none = np.zeros(len(widths))
    return Model(np.zeros((buckets, 1)), [np.zeros((w, 1, 1)) for w in widths], none, none, 0.0, cut=1.0)


def _drawn(rng, buckets: int, dim: int, per_width: int, widths: tuple[int, ...]) -> Model:
    model = Model(
        rng.normal(0, 0.1, (buckets, dim)),
        [rng.normal(0, 0.3, (w, dim, per_width)) for w in widths],
        np.zeros(per_width * len(widths)),
        rng.normal(0, 0.1, per_width * len(widths)),
        0.0,
    )
    model.embeddings[0] = 0
    return model


def side_by_side(members: list[Model]) -> Model:
    """One network whose logit is the mean of the members' logits."""
    dims = [m.embeddings.shape[1] for m in members]
    filters, bias, out = [], [], []
    for w, width in enumerate(members[0].widths):
        per = [m.filters[w].shape[2] for m in members]
        whole = np.zeros((width, sum(dims), sum(per)))
        for k, m in enumerate(members):
            whole[:, sum(dims[:k]) : sum(dims[: k + 1]), sum(per[:k]) : sum(per[: k + 1])] = m.filters[w]
            first = sum(f.shape[2] for f in m.filters[:w])
            bias.append(m.bias[first : first + per[k]])
            out.append(m.out[first : first + per[k]] / len(members))
        filters.append(whole)
    embeddings = np.hstack([m.embeddings for m in members]).astype(np.float32)
    return Model(embeddings, filters, np.concatenate(bias), np.concatenate(out), float(np.mean([m.out_bias for m in members])))


def _bucket_counts(corpus: _Corpus, rows: np.ndarray, buckets: int) -> np.ndarray:
    """Of how many texts each bucket is a feature."""
    found = np.zeros(buckets)
    for i in rows:
        found[np.unique(corpus.feats[np.unique(corpus.docs[i])])] += 1
    return found


def _start_from_counts(model: Model, with_: np.ndarray, without: np.ndarray, n1: float, n0: float) -> None:
    """Dimension 0 starts as the shrunk log-odds of a bucket, which filter 0 of
    width 1 reads: the filters then start where the labels already tell apart."""
    odds = np.log((with_ + 0.5) / (n1 + 1)) - np.log((without + 0.5) / (n0 + 1))
    seen = with_ + without
    model.embeddings[:, 0] = 0.5 * odds * seen / (seen + 8)
    model.embeddings[0] = 0
    model.filters[0][0, :, 0] = 0
    model.filters[0][0, 0, 0] = 1
    model.out[0] = 1


def _laid_out(corpus: _Corpus, rows: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, counts, starts, ends) of texts one behind the other, ``gap`` empty
    words after each, so that no filter sees two texts."""
    docs = [corpus.docs[i] for i in rows]
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes + gap) - gap
    starts = ends - sizes
    total = int(ends[-1]) + gap if len(docs) else 0
    feats, counts = np.zeros((total, corpus.feats.shape[1]), np.int64), np.ones((total, 1), np.int64)
    for d, a, b in zip(docs, starts.tolist(), ends.tolist(), strict=True):
        feats[a:b], counts[a:b] = corpus.feats[d], corpus.counts[d]
    return feats, counts, starts, ends


def _word_vectors(model: Model, feats: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean embedding of each word's features, one feature at a time, since a long
    text's embeddings of all of them together would be the driver's largest array."""
    words = model.embeddings[feats[:, 0]].astype(np.float64)
    for k in range(1, feats.shape[1]):
        words += model.embeddings[feats[:, k]]
    words /= counts
    return words


def _table(model: Model) -> np.ndarray:
    """All filters, offset by offset: a column for each response of one word."""
    return np.hstack([f[j] for f in model.filters for j in range(len(f))])


def _responses(model: Model, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``_largest`` for texts that are laid out as word vectors."""
    return _largest(model, _table(model).T @ words.T, starts, ends)


def _largest(model: Model, by_word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each width: (first filter, largest response and its place per text).
    ``by_word`` has a row for each column of ``_table`` and a column for each word, with
    zeros behind each text, which fill up a text shorter than the filter."""
    first, row, m = 0, 0, int(ends[-1])
    for filt in model.filters:
        k, n = len(filt), filt.shape[2]
        z = by_word[row : row + n, :m]
        for j in range(1, k):
            z = z + by_word[row + j * n : row + (j + 1) * n, j : m + j]
        row += k * n
        place = np.empty((len(ends), n), np.int64)
        for d, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            place[d] = start + z[:, start : max(start + 1, end - k + 1)].argmax(axis=1)
        yield first, z[np.arange(n), place], place
        first += n


def _top(model: Model, corpus: _Corpus, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each text, and its word's place there. Long
    texts are cut into pieces that overlap, so memory does not grow with a text's
    responses; a word's own responses are made once for all its places in a group of pieces."""
    longest, n = max(model.widths), len(model.bias)
    pieces = [(d, a, doc[a : a + WORDS_AT_ONCE + longest - 1]) for d, doc in enumerate(docs) for a in range(0, max(1, len(doc) - longest + 1), WORDS_AT_ONCE)]
    best, place = np.full((len(docs), n), -np.inf), np.zeros((len(docs), n), np.int64)
    group = np.cumsum([len(p) for *_, p in pieces]) // (4 * WORDS_AT_ONCE)
    table = _table(model).T
    for g in np.unique(group).tolist():
        mine = [pieces[i] for i in np.flatnonzero(group == g)]
        sizes = np.array([len(p) for *_, p in mine], np.int64)
        ends = np.cumsum(sizes + longest - 1) - (longest - 1)
        starts = ends - sizes
        known, at = _distinct(np.concatenate([p for *_, p in mine]), len(corpus.feats))
        own = np.zeros((len(table), len(known) + 1))  # the last for no word
        own[:, :-1] = table @ _word_vectors(model, corpus.feats[known], corpus.counts[known]).T
        laid = np.full(int(ends[-1]) + longest - 1, len(known))
        laid[np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())] = at
        for first, top, where in _largest(model, own.take(laid, axis=1), starts, ends):
            cells = slice(first, first + top.shape[1])
            for (d, a, _), t, w, start in zip(mine, top, where, starts.tolist(), strict=True):
                up = t > best[d, cells]
                best[d, cells] = np.where(up, t, best[d, cells])
                place[d, cells] = np.where(up, w - start + a, place[d, cells])
    return best, place


def gradients(model: Model, corpus: _Corpus, rows: np.ndarray, labels: np.ndarray, weight: np.ndarray):
    """Of the weighted log loss of some texts: by filter, ``out``, ``bias``,
    ``out_bias``, and (buckets, gradient) of the embeddings that occur."""
    docs = [corpus.docs[i] for i in rows]
    sizes = np.array([len(d) for d in docs], np.int64)
    flat, starts = np.concatenate(docs), (np.cumsum(sizes) - sizes)[:, None]
    best, places = _top(model, corpus, docs)
    pooled = best + model.bias
    hidden = np.maximum(pooled, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
    slope = (p - labels[rows]) * weight
    down = slope[:, None] * model.out * (pooled > 0)
    at_word, by, filters, first = [], [], [], 0
    for filt in model.filters:
        k, n, dim = len(filt), filt.shape[2], filt.shape[1]
        g, place = down[:, first : first + n], places[:, first : first + n]
        first += n
        grad = np.zeros_like(filt)
        for j in range(k):
            inside = place + j < sizes[:, None]
            where = flat[starts + np.where(inside, place + j, place)].ravel()
            words = _word_vectors(model, corpus.feats[where], corpus.counts[where]).reshape(*place.shape, dim)
            grad[j] = np.einsum("df,dfe->ef", g * inside, words)
            at_word.append(where)
            by.append(((g * inside)[:, :, None] * filt[j].T[None]).reshape(-1, dim))
        filters.append(grad)
    at_word = np.concatenate(at_word)
    share = np.concatenate(by) / corpus.counts[at_word]
    touched = corpus.feats[at_word]
    buckets, inverse = np.unique(touched, return_inverse=True)
    total = np.zeros((len(buckets), share.shape[1]))
    np.add.at(total, inverse.reshape(touched.shape).ravel(), np.repeat(share, touched.shape[1], axis=0))
    total[buckets == 0] = 0
    return filters, hidden.T @ slope, down.sum(axis=0), slope.sum(), (buckets, total)


class _Fitter:
    """A network that is being fitted, with what its steps remember."""

    def __init__(self, model: Model):
        self.model = model
        self.squares = np.full(len(model.embeddings), 1e-6)
        self.touched = np.zeros(len(model.embeddings))
        self.dense = {f"filter{w}": f for w, f in enumerate(model.filters)} | {"out": model.out, "bias": model.bias}
        self.moments = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in self.dense.items()}
        self.steps = 0

    def _adam(self, name: str, grad: np.ndarray, rate: float) -> None:
        m, v = self.moments[name]
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        self.dense[name] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-8)

    def step(self, corpus: _Corpus, rows: np.ndarray, labels: np.ndarray, weight: tuple[float, float]) -> None:
        self.steps += 1
        model = self.model
        filters, out, bias, out_bias, (buckets, total) = gradients(model, corpus, rows, labels, np.where(labels[rows] > 0, *weight) / len(rows))
        for w, grad in enumerate(filters):
            self._adam(f"filter{w}", grad, 0.01)
        self._adam("out", out, 0.02)
        self._adam("bias", bias, 0.01)
        model.out_bias -= 0.5 * out_bias
        self.squares[buckets] += (total**2).mean(axis=1)
        model.embeddings[buckets] -= 0.05 * total / np.sqrt(self.squares[buckets])[:, None]
        self.touched[buckets] += 1

    def flat(self) -> np.ndarray:
        """All but the embeddings and their squares, as one vector."""
        parts = [x for name, value in self.dense.items() for x in (value, *self.moments[name])]
        return np.concatenate([*(x.ravel() for x in parts), [self.model.out_bias, self.steps]])

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for name, value in self.dense.items():
            for x in (value, *self.moments[name]):
                x[...] = flat[at : at + x.size].reshape(x.shape)
                at += x.size
        self.model.out_bias, self.steps = float(flat[at]), round(flat[at + 1])


def _weights(n1: float, n: float) -> tuple[float, float]:
    return n / (2 * max(1.0, n1)), n / (2 * max(1.0, n - n1))


def _fit(model, corpus, labels, fit, epochs, batch, rng) -> None:
    fitter = _Fitter(model)
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), batch):
            fitter.step(corpus, order[at : at + batch], labels, _weights(labels[fit].sum(), len(fit)))


def _logits(model: Model, corpus: _Corpus, rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for k, i in enumerate(rows):
        feats, counts, starts, ends = _laid_out(corpus, [i], max(model.widths) - 1)
        words = _word_vectors(model, feats, counts)
        pooled = np.hstack([b for _, b, _ in _responses(model, words, starts, ends)])[0] + model.bias
        out[k] = np.maximum(pooled, 0) @ model.out + model.out_bias
    return out


def best_cut(logits: np.ndarray, labels: np.ndarray, n: np.ndarray | None = None) -> float | None:
    """The cut of highest F1, half way to the next lower logit; ``n``: how many rows
    each one stands for."""
    n = np.ones(len(labels)) if n is None else n
    toxic = labels * n
    if not 0 < toxic.sum() < n.sum():
        return None
    order = np.argsort(-logits, kind="stable")
    z, hit = logits[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.cumsum(n[order]) + toxic.sum())
    f1[:-1][z[1:] == z[:-1]] = -1
    top = int(f1.argmax())
    return float((z[top] + z[min(top + 1, len(z) - 1)]) / 2)


def _calibrate(model: Model, z: np.ndarray, y: np.ndarray, langs: list[str | None], n: np.ndarray | None = None) -> None:
    n = np.ones(len(y)) if n is None else n
    cut = best_cut(z, y, n)
    if cut is None:
        model.cut = float(z.max()) + 1 if not y.any() else float(z.min())
    else:
        model.cut = cut
    mean = np.average(z, weights=n)
    model.scale = 2 / max(1e-3, float(np.sqrt(np.average((z - mean) ** 2, weights=n))))
    by_lang = np.array([x or "" for x in langs], object)
    for lang in sorted(set(by_lang)):
        mine = by_lang == lang
        toxic = (y * n)[mine].sum()
        # a language's own cut needs enough examples of both kinds
        own = best_cut(z[mine], y[mine], n[mine]) if min(toxic, n[mine].sum() - toxic) >= 10 else None
        model.thresholds[lang] = float(model.calibrated(np.array(own))) if own is not None else THRESHOLD


class Scorer:
    """Scores whole texts; keeps filter responses of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.buckets = len(model.embeddings)
        self.table = _table(model).astype(np.float32)
        self.longest = max(model.widths)
        # the last row is no word's; pages of rows that are not reached are never touched
        self.rows = np.zeros((WORDS_KEPT + max(WORDS_AT_ONCE, WORDS_TOGETHER) + self.longest, self.table.shape[1]), np.float32)
        self.known = _Numbers()

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Rows of at most so many words as are convolved at a time."""
        if len(self.known) > WORDS_KEPT:
            self.known = _Numbers()
        base = len(self.known)
        found, new = self.known.of(words)
        if new:
            feats = features(new, self.buckets)
            mean = _word_vectors(self.model, feats, (feats > 0).sum(axis=1, keepdims=True))
            self.rows[base : base + len(new)] = mean.astype(np.float32) @ self.table
        return found

    def logit(self, text: str | None) -> float:
        return float(self.logits([text])[0])

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Short texts are convolved together, long ones in pieces that overlap."""
        best = np.full((len(texts), len(self.model.bias)), -np.inf, np.float32)
        flat: list[str] = []
        rows, sizes = [], []
        for d, text in enumerate(texts):
            words = words_of(text) or [""]
            for at in range(0, max(1, len(words) - self.longest + 1), WORDS_AT_ONCE):
                part = words[at : at + WORDS_AT_ONCE + self.longest - 1] if len(words) > WORDS_AT_ONCE else words
                if flat and len(flat) + len(part) > WORDS_TOGETHER:
                    self._pool(best, flat, rows, sizes)
                    flat, rows, sizes = [], [], []
                flat += part
                rows.append(d)
                sizes.append(len(part))
        if flat:
            self._pool(best, flat, rows, sizes)
        model = self.model
        return np.maximum(best + model.bias, 0) @ model.out + model.out_bias

    def _pool(self, best: np.ndarray, flat: list[str], rows: list[int], sizes: list[int]) -> None:
        """Raises ``best`` to the largest responses of texts, or pieces, that stand one
        behind the other in ``flat``."""
        own = self.rows[self._numbers(flat)]
        size = np.array(sizes, np.int64)
        ends = np.cumsum(size)
        starts, at = ends - size, np.array(rows, np.int64)
        first = column = 0
        for filt in self.model.filters:
            k, n = len(filt), filt.shape[2]
            m = max(0, len(own) - k + 1)
            z = own[:m, column : column + n]
            for j in range(1, k):
                z = z + own[j : m + j, column + j * n : column + (j + 1) * n]
            full = size >= k
            top = np.zeros((len(size), n), np.float32)
            if full.any():
                # places from a text's last whole window on belong to no text
                cuts = np.column_stack([starts[full], ends[full] - k + 1]).ravel()
                top[full] = np.maximum.reduceat(z, cuts[cuts < m], axis=0)[::2]
            for d in np.flatnonzero(~full).tolist():  # shorter than the filter: the missing words are zeros
                top[d] = sum(own[starts[d] + j, column + j * n : column + (j + 1) * n] for j in range(sizes[d]))
            cells = slice(first, first + n)
            np.maximum.at(best[:, cells], at, top)
            first, column = first + n, column + k * n


def in_training(id_col: Column, parts: int = 3, held_out: int = 1) -> Column:
    """False for the held-out part: crc32 of the id as text, by remainder."""
    return F.coalesce(F.crc32(id_col.cast("string")) % parts != held_out, F.lit(False))


def _kinds(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """``_id, label`` of the labelled ids outside the held-out part."""
    return labels.where(in_training(F.col(id_col)) & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("label"))


def _texts(docs: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))


def _labelled(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """The texts that have a label, with it. Hashes of the labelled ids go to all tasks as bits, 64 a
    row and never more than ``MARKS`` of them; only texts whose id finds its bit set are shuffled to
    the join that decides. The plan is the same whatever the size: no join broadcasts the labels,
    and the rows of a partition, which are fitted in their order, come sorted by id."""
    if texts.schema["_id"].dataType == kinds.schema["_id"].dataType:  # else equal ids need not have one hash
        place, at = F.pmod(F.xxhash64("_id"), F.lit(MARKS)), F.col("_at")
        bits = kinds.select(place.alias("_at")).groupBy(F.shiftright(at, 6).alias("_slot")).agg(F.expr("bit_or(shiftleft(1L, cast(_at % 64 AS int)))").alias("_bits"))
        near = texts.where(in_training(F.col("_id"))).withColumn("_at", place).withColumn("_slot", F.shiftright(at, 6))
        texts = near.join(F.broadcast(bits), "_slot").where(F.getbit("_bits", (at % 64).cast("int")) == 1).select(*texts.columns)
    return texts.join(kinds.hint("merge"), "_id")


def training_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", bounds: TrainingBounds | None = None
) -> DataFrame:
    """A bounded sample of labelled rows outside the held-out part, by hash of id, for
    trial fits: ``_id, text, lang, label``. A text that does not fit is passed over, and
    a label of too long texts alone gives the beginning of one."""
    bounds = bounds or TrainingBounds()
    kinds = _kinds(labels, id_col, label)
    picks = [kinds.where(F.col("label") == k).withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(n) for k, n in ((1, bounds.toxic_rows), (0, bounds.clean_rows))]
    return bounded_texts(_texts(docs, id_col, text, lang), picks[0].unionByName(picks[1]), "label", bounds.chars_per_label)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", bounds: TrainingBounds | None = None, n_folds: int = 4, rows_per_shard: int = ROWS_PER_SHARD, **params
) -> Model:
    """Train on all labelled rows outside the held-out part, or on a sample within
    ``bounds``, in ``n_folds`` parts by hash of id. Rows are encoded and written once;
    counts, networks and responses are made by tasks that stream them, and only what
    does not grow with them comes to the driver."""
    texts = _texts(docs, id_col, text, lang)
    rows = _labelled(texts, _kinds(labels, id_col, label)) if bounds is None else training_sample(docs, labels, id_col, text, lang, label, bounds)
    return _fitted(rows, n_folds, rows_per_shard, **params)


#: Columns of what tasks give back.
ROWS = {"fold": pa.int32(), "label": pa.int32(), "lang": pa.string(), "words": pa.binary(), "feats": pa.binary()}
COUNTS = {"fold": pa.int32(), "label": pa.int32(), "bucket": pa.int32(), "n": pa.int64()}
BLOCKS = {"fold": pa.int32(), "block": pa.int32(), "data": pa.binary()}
SAID = {"lang": pa.string(), "label": pa.int32(), "z": pa.int64()}


def _schema(columns: dict[str, pa.DataType]) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{c} {names[kind]}" for c, kind in columns.items())


def _batch(columns: dict[str, pa.DataType], **values) -> pa.RecordBatch:
    return pa.record_batch([pa.array(values[c], kind) for c, kind in columns.items()], names=list(columns))


def _parts(batches: Iterator[pa.RecordBatch], rows: int, rng: np.random.Generator | None = None) -> Iterator[dict[str, list]]:
    """Batches as lists by column, so many rows at a time, since Python's copy of a whole batch would
    be the largest thing in a task; with ``rng`` in random order within a batch."""
    for batch in batches:
        order = np.arange(batch.num_rows) if rng is None else rng.permutation(batch.num_rows)
        for at in range(0, len(order), rows):
            yield (batch.slice(at, rows) if rng is None else batch.take(pa.array(order[at : at + rows]))).to_pydict()


def _fitted(
    rows: DataFrame, n_folds: int, rows_per_shard: int, buckets: int = 1 << 15, dim: int = 12, per_width: int = 4, widths: tuple[int, ...] = (1, 2, 3), epochs: int = 4, batch: int = 64, seed: int = 3
) -> Model:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(buckets)
        for part in _parts(batches, 1000):
            words, feats = zip(*encoder.encoded(part.pop("text")), strict=True)
            yield _batch(ROWS, **part, words=words, feats=feats)

    fold = (F.crc32(F.concat(F.lit("v"), F.col("_id").cast("string"))) % n_folds).cast("int").alias("fold")
    coded = rows.select(fold, F.col("label").cast("int").alias("label"), "lang", "text")
    coded = stage(coded.mapInArrow(encode, _schema(ROWS)), "toxicity-rows")
    sizes = {(r["fold"], r["label"]): r["n"] for r in coded.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two a fold
    total = sum(sizes.values())
    n1, n0 = ({k: sum(n for (own, kind), n in sizes.items() if own != k and kind == label) for k in range(n_folds)} for label in (1, 0))
    folds = sorted({k for k, _ in sizes if n1[k] and n0[k]})
    if not folds:
        drop_staged(coded)
        return _constant(buckets, widths)
    shards = min(SHARDS, -(-total // rows_per_shard))
    counts = _counted(coded.coalesce(shards), n_folds, buckets)
    fitters = {}
    for k in folds:
        model = _drawn(np.random.default_rng(seed + len(fitters)), buckets, dim, per_width, widths)
        with_, without = (sum((counts[own, label] for own in range(n_folds) if own != k), np.zeros(buckets)) for label in (1, 0))
        _start_from_counts(model, with_, without, n1[k], n0[k])
        fitters[k] = _Fitter(model)
    weight = {k: _weights(n1[k], n1[k] + n0[k]) for k in folds}
    for turn in range(max(min(2, epochs), min(epochs, -(-VISITS // total)))):
        # written rows are read side by side by so many tasks, without another shuffle
        _round(coded.coalesce(shards), fitters, weight, batch * n_folds // max(1, n_folds - 1), turn)
    members = {k: f.model for k, f in fitters.items()}
    _unseen(coded, model := side_by_side(list(members.values())), members)
    drop_staged(coded)
    return model


def _counted(coded: DataFrame, n_folds: int, buckets: int) -> dict[tuple[int, int], np.ndarray]:
    """Of how many texts of each fold and label each bucket is a feature."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((n_folds, 2, buckets), np.int64)
        for part in _parts(batches, 1000):
            for k, label, feats in zip(part["fold"], part["label"], part["feats"], strict=True):
                found[k, int(label > 0), np.unique(_ints(feats))] += 1
        k, label, at = np.nonzero(found)
        yield _batch(COUNTS, fold=k, label=label, bucket=at, n=found[k, label, at])

    sums = coded.select("fold", "label", "feats").mapInArrow(counted, _schema(COUNTS)).groupBy("fold", "label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = {(k, label): np.zeros(buckets) for k in range(n_folds) for label in (0, 1)}
    for (k, label), own in sums.groupby(["fold", "label"]):
        out[k, label][own["bucket"]] = own["n"]
    return out


def _round(dealt: DataFrame, fitters: dict[int, _Fitter], weight: dict[int, tuple[float, float]], at_once: int, turn: int) -> None:
    """One pass of each task over its rows, from the same networks, which then become the
    mean of the tasks': an embedding by the steps that touched it, the rest by rows."""
    spark = dealt.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps(fitters))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, _Fitter] = pickle.loads(sent.value)
        done = dict.fromkeys(mine, 0)
        for fitter in mine.values():
            fitter.touched[:] = 0
        for part in _parts(batches, at_once, np.random.default_rng(turn)):
            corpus, labels, own = _Corpus.of(part["words"], part["feats"]), np.array(part["label"], np.float64), np.array(part["fold"])
            for k, fitter in mine.items():
                fit = np.flatnonzero(own != k)
                if len(fit):
                    fitter.step(corpus, fit, labels, weight[k])
                    done[k] += len(fit)
        for k, fitter in mine.items():
            if done[k]:
                table = np.column_stack([fitter.model.embeddings, fitter.squares]) * fitter.touched[:, None]
                table = np.column_stack([table, fitter.touched]).astype(np.float32)
                at = range(0, len(table), BLOCK)
                data = [*(table[a : a + BLOCK].tobytes() for a in at), np.append(fitter.flat() * done[k], done[k]).tobytes()]
                yield _batch(BLOCKS, fold=[k] * len(data), block=[*at, -1], data=data)

    def added(table: pa.Table) -> pa.Table:
        k, block = table["fold"][0].as_py(), table["block"][0].as_py()
        kind = np.float64 if block < 0 else np.float32
        total = sum(np.frombuffer(x, kind).astype(np.float64) for x in sorted(table["data"].to_pylist()))
        return pa.Table.from_batches([_batch(BLOCKS, fold=[k], block=[block], data=[total.tobytes()])])

    schema = _schema(BLOCKS)
    for r in dealt.select("fold", "label", "words", "feats").mapInArrow(passed, schema).groupBy("fold", "block").applyInArrow(added, schema).collect():
        fitter, data = fitters[r["fold"]], np.frombuffer(r["data"], np.float64)
        if r["block"] < 0:
            fitter.take(data[:-1] / data[-1])
            continue
        dim = fitter.model.embeddings.shape[1]
        rows = data.reshape(-1, dim + 2)
        at = r["block"] + np.flatnonzero(rows[:, -1])
        mean = rows[at - r["block"], :-1] / rows[at - r["block"], -1:]
        fitter.model.embeddings[at], fitter.squares[at] = mean[:, :dim], mean[:, dim]
    sent.destroy()


def _unseen(coded: DataFrame, model: Model, members: dict[int, Model]) -> None:
    """Cut and thresholds of ``model`` from what each member says of its own fold, in
    steps of a logit, so that their number does not grow with the rows."""
    spark = coded.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps(members))

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_fold = pickle.loads(sent.value)
        for part in _parts(batches, 256):
            corpus, fold = _Corpus.of(part["words"], part["feats"]), np.array(part["fold"])
            z = np.full(len(fold), np.nan)
            for k, member in by_fold.items():
                own = np.flatnonzero(fold == k)
                if len(own):
                    best, _ = _top(member, corpus, [corpus.docs[i] for i in own])
                    z[own] = np.maximum(best + member.bias, 0) @ member.out + member.out_bias
            known = np.flatnonzero(~np.isnan(z))
            yield _batch(SAID, lang=[part["lang"][i] for i in known], label=[part["label"][i] for i in known], z=np.rint(z[known] * STEPS).astype(np.int64))

    found = coded.select("fold", "label", "lang", "words", "feats").mapInArrow(said, _schema(SAID)).groupBy("lang", "label", "z").agg(F.count(F.lit(1)).alias("n")).toPandas()
    sent.destroy()
    found = found.sort_values(["z", "label", "lang"])
    langs = [x if isinstance(x, str) else None for x in found["lang"]]
    _calibrate(model, found["z"].to_numpy(np.float64) / STEPS, found["label"].to_numpy(np.float64), langs, found["n"].to_numpy(np.float64))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Adds ``to``, a double in 0 to 1, from the text alone. Null, empty and
    wordless texts get the score of a text of one unknown word; every row keeps
    its place and its columns, and an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for batch in batches:
            # a part at a time becomes Python's strings
            parts = [scorer.logits(batch.slice(at, 1000).to_pylist()) for at in range(0, len(batch), 1000)]
            yield pa.array(sent.value.calibrated(np.concatenate([np.zeros(0), *parts])), pa.float64())

    return docs.withColumn(to, scored(F.col(text).cast("string")))


def language_threshold(lang: Column, model: Model) -> Column:
    """The calibrated threshold of a row's language (``THRESHOLD`` if unknown)."""
    if not model.thresholds:
        return F.lit(THRESHOLD)
    table = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair])
    return F.coalesce(table[F.coalesce(lang, F.lit(""))], F.lit(THRESHOLD))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", **params) -> DataFrame:
    """One row per document: ``id_col``, ``held_out``, ``score``, ``predicted``
    (score of at least 0.7) and ``predicted_by_lang`` (by the language's own
    threshold). Without labels every score is that of a constant, below 0.7."""
    model = fit_toxicity(docs, labels, id_col, text, lang, **params)
    scored = score_toxicity(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")), model, "_text")
    return scored.select(
        F.col("_id").alias(id_col),
        F.coalesce(F.crc32(F.col("_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        (F.col("score") >= language_threshold(F.col("_lang"), model)).cast("int").alias("predicted_by_lang"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", **params) -> DataFrame:
    """``docs`` without the documents scored 0.7 or more; all columns are kept."""
    model = fit_toxicity(docs, labels, id_col, text, lang, **params)
    score = "toxicity_" + uuid.uuid4().hex  # no column of docs has this name
    return score_toxicity(docs, model, text, score).where(F.col(score) < THRESHOLD).drop(score)

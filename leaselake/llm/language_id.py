"""Language identification with interpolated Kneser-Ney character models.

One model per language, all kept in shared sorted hash arrays: for every n-gram
seen in any language there is a row with its interpolated log-probability in each
language, and for every context a row with its back-off weights. A text is scored
by one search per character at the top order, and further ones only where the
n-gram is unseen. The language of lowest length-normalised cross-entropy wins; the
score is its share after a temperature fitted on texts left out of the counts, and
a text whose cross-entropy is beyond what those texts show is marked rejected.

The models are fitted on the driver from a bounded sample (``TrainingBounds``).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leaselake.llm.sampling import bounded_texts

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
MAYBE_LETTER = re.compile(r"[^\W\d_]")
CHARS_AT_ONCE = 1 << 18


@dataclass(frozen=True)
class TrainingBounds:
    """How much labelled text the driver may collect for fitting."""

    rows_per_language: int = 400
    chars_per_language: int = 2_000_000


@dataclass
class Order:
    """Sorted hashes of n-grams with log-probabilities (rows x languages), and
    sorted hashes of contexts with log back-off weights."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


@dataclass
class LanguageModels:
    languages: list[str]
    multipliers: np.ndarray
    orders: list[Order]
    unseen: float
    temperature: float = 20.0
    limits: np.ndarray | None = None


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    found = MAYBE_LETTER.search(text)
    return bool(found) and (found[0].isalpha() or any(map(str.isalpha, set(text))))


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, other characters run into one space."""
    clean = f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "
    return np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashes(chars: np.ndarray, multipliers: np.ndarray) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each character, for n = 1, 2, ...; before
    the text stand spaces. Linear in the characters, so that an (n-1)-gram that
    ends there is the same number wherever it is met."""
    n = len(multipliers)
    padded = np.r_[np.full(n - 1, 32, np.uint64), chars]
    out, total = [], np.zeros(len(chars), np.uint64)
    for k in range(n):
        total = total + padded[n - 1 - k : n - 1 - k + len(chars)] * multipliers[k]
        out.append(total)
    return out


def _spaces(multipliers: np.ndarray) -> list[np.ndarray]:
    """Hash of n spaces for n = 1, 2, ..., each as an array of one."""
    return list(np.cumsum(np.full(len(multipliers), 32, np.uint64) * multipliers, dtype=np.uint64)[:, None])


def _counts(texts: list[np.ndarray], multipliers: np.ndarray):
    """Per order: hash, context hash, suffix hash and count of distinct n-grams
    (raw counts at the top order, continuation counts below it)."""
    parts = [_hashes(t, multipliers) for t in texts]
    orders = []
    n = len(multipliers)
    space = _spaces(multipliers)
    for k in range(n):
        own = np.concatenate([p[k] for p in parts])
        if k:
            suffix = np.concatenate([p[k - 1] for p in parts])
            context = np.concatenate([np.r_[space[k - 1], p[k - 1][:-1]] for p in parts])
        else:
            suffix = context = np.zeros(len(own), np.uint64)
        grams, first, count = np.unique(own, return_index=True, return_counts=True)
        orders.append([grams, context[first], suffix[first], count.astype(np.float64)])
    for k in range(n - 1):
        kinds, count = np.unique(orders[k + 1][2], return_counts=True)
        orders[k][3] = count[np.searchsorted(kinds, orders[k][0])].astype(np.float64)
    return orders


def fit(texts: dict[str, list[str]], order: int = 4, seed: int = 9) -> LanguageModels:
    """Models of the given languages' texts."""
    languages = sorted(texts)
    rng = np.random.default_rng(seed)
    multipliers = rng.integers(1, 1 << 63, order, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    counted = [_counts([letters_of(t) for t in texts[x]], multipliers) for x in languages]
    alphabet = len(np.unique(np.concatenate([c[0][0] for c in counted]))) + 1
    unseen = 1 / alphabet
    orders: list[Order] = []
    below: np.ndarray | None = None
    for k in range(order):
        grams, first = np.unique(np.concatenate([c[k][0] for c in counted]), return_index=True)
        context = np.concatenate([c[k][1] for c in counted])[first]
        suffix = np.concatenate([c[k][2] for c in counted])[first]
        contexts = np.unique(context)
        at_context = np.searchsorted(contexts, context)
        lower = np.full((len(grams), len(languages)), unseen) if below is None else below[np.searchsorted(orders[-1].grams, suffix)]
        p = np.empty((len(grams), len(languages)))
        weights = np.ones((len(contexts), len(languages)))
        for j, c in enumerate(counted):
            own, own_context, _, count = c[k]
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones else 0.5
            place = np.searchsorted(contexts, own_context)
            total = np.bincount(place, count, len(contexts))
            kinds = np.bincount(place, minlength=len(contexts))
            seen = total > 0
            weights[seen, j] = discount * kinds[seen] / total[seen]
            mine = np.zeros(len(grams))
            mine[np.searchsorted(grams, own)] = np.maximum(count - discount, 0)
            p[:, j] = mine / np.where(seen, total, 1)[at_context] + weights[at_context, j] * lower[:, j]
        orders.append(Order(grams, np.log(p).astype(np.float32), contexts, np.log(weights).astype(np.float32)))
        below = p
    return LanguageModels(languages, multipliers, orders, float(np.log(unseen)))


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def cross_entropy(models: LanguageModels, text: str) -> np.ndarray:
    """Nats per character of the whole text in each language."""
    chars = letters_of(text)
    n = len(models.multipliers)
    total = np.zeros(len(models.languages))
    for start in range(0, len(chars), CHARS_AT_ONCE):
        reach = min(start, n - 1)
        part = chars[start - reach : start + CHARS_AT_ONCE]
        hashes = [h[reach:] for h in _hashes(part, models.multipliers)]
        earlier = [h[-1:] for h in _hashes(part[:reach], models.multipliers)] if reach else _spaces(models.multipliers)
        before = [np.r_[e, h[:-1]] for e, h in zip(earlier, hashes, strict=True)]
        left = np.arange(len(hashes[0]))
        for k in range(n - 1, -1, -1):
            order = models.orders[k]
            at, seen = _find(order.grams, hashes[k][left])
            total += order.logp[at[seen]].sum(axis=0, dtype=np.float64)
            left = left[~seen]
            if not len(left):
                break
            context = before[k - 1][left] if k else np.zeros(len(left), np.uint64)
            at, seen = _find(order.contexts, context)
            total += order.backoff[at[seen]].sum(axis=0, dtype=np.float64)
        else:
            total += len(left) * models.unseen
    return -total / len(chars)


def shares(entropy: np.ndarray, temperature: float) -> np.ndarray:
    z = np.exp(-temperature * (entropy - entropy.min()))
    return z / z.sum()


def calibrate(models: LanguageModels, texts: list[str], langs: list[str], keep: float = 0.999) -> None:
    """Temperature of highest likelihood, and per language the cross-entropy that
    a share ``keep`` of its texts stays under, with a margin of a fifth."""
    pairs = [(cross_entropy(models, t), models.languages.index(x)) for t, x in zip(texts, langs, strict=True) if x in models.languages]
    models.limits = np.full(len(models.languages), np.inf)
    if not pairs:
        return
    grid = [1.0, 2.0, 5.0, 10.0, 20.0, 50.0]
    likelihood = [sum(np.log(max(1e-12, shares(e, t)[j])) for e, j in pairs) for t in grid]
    models.temperature = grid[int(np.argmax(likelihood))]
    for j in range(len(models.languages)):
        mine = [e[j] for e, k in pairs if k == j]
        if len(mine) >= 20:
            models.limits[j] = 1.2 * float(np.quantile(mine, keep))


def predict(models: LanguageModels, text: str | None) -> tuple[str, float, bool]:
    """(language, score, rejected). ``und`` and 0.0 where there is no letter; a
    rejected text still names the nearest language, so the caller may choose."""
    if not models.languages or not has_letter(text):
        return UNKNOWN, 0.0, True
    entropy = cross_entropy(models, text)
    best = int(entropy.argmin())
    limit = np.inf if models.limits is None else models.limits[best]
    return models.languages[best], float(shares(entropy, models.temperature)[best]), bool(entropy[best] > limit)


def training_sample(docs: DataFrame, id_col: str, text: str, lang: str, bounds: TrainingBounds) -> pd.DataFrame:
    """At most ``rows_per_language`` rows and ``chars_per_language`` characters a
    language outside the held-out part, by hash of id. A language's rows are counted
    first, and hashes above a cut that leaves half as many again are passed over, so
    that no task ranks a frequent language whole. A text that does not fit is passed
    over, and a language of too long texts alone gives the beginning of one."""
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 3 != 1)).select(
        F.col(id_col).alias("_id"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.lit("lang"), id_col).alias("_h")
    )
    # one row a language, as the models are
    counts = F.broadcast(named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    low = F.pmod("_h", F.lit(1 << 32)) * F.col("n") < F.lit(float(1 << 32)) * (1.5 * bounds.rows_per_language + 50)
    few = named.join(counts, "lang").where(low).select("_id", "lang", "_h")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "_id"))
    picks = few.withColumn("_r", place).where(F.col("_r") <= bounds.rows_per_language).drop("_r").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    return bounded_texts(texts, picks, "lang", bounds.chars_per_language, ["_id", "lang"]).toPandas().sort_values(["_id", "lang", "text"], ignore_index=True)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", bounds: TrainingBounds | None = None, order: int = 4) -> LanguageModels:
    """Fit on four fifths of the sample, calibrate on the rest."""
    rows = training_sample(docs, id_col, text, lang, bounds or TrainingBounds())
    rows = rows[np.array([has_letter(t) for t in rows["text"]], bool)]
    check = np.array([zlib.crc32(f"c{x}".encode()) % 5 == 0 for x in rows["_id"]], bool)
    texts: dict[str, list[str]] = {}
    for lang_, text_ in rows.loc[~check, ["lang", "text"]].itertuples(index=False):
        texts.setdefault(lang_, []).append(text_)
    if not texts:
        return LanguageModels([], np.zeros(0, np.uint64), [], 0.0)
    models = fit(texts, order)
    calibrate(models, rows.loc[check, "text"].tolist(), rows.loc[check, "lang"].tolist())
    return models


def identify_languages(docs: DataFrame, models: LanguageModels, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected`` from the text alone; columns
    that already have these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [predict(sent.value, t) for t in batch]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "rejected"])

    new = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in new]
    both = docs.select(F.struct(*kept).alias("row"), predicted(F.col(text).cast("string")).alias("found"))
    return both.select(*[F.col("row")[c].alias(c) for c in kept], *[F.col("found")[c].alias(c) for c in new])


def language_id(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", **params) -> DataFrame:
    """One row per document: ``id_col``, ``held_out``, ``lang_pred``, ``score`` and
    ``rejected``. Texts that are null or hold no letter are ``und`` with score 0;
    so is everything if no text names its language. Repeated and null ids keep
    their rows; an empty table gives an empty result."""
    models = fit_languages(docs, id_col, text, lang, **params)
    out = identify_languages(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), models, "_text")
    held = F.coalesce(F.crc32(F.col("_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select(F.col("_id").alias(id_col), held.alias("held_out"), "lang_pred", "score", "rejected")

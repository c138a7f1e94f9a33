"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once, in one pass over the texts, and the ledger keeps
what was measured and one failure bit a rule. A policy is a versioned set of
rules: applying one is a test of bits, and changing one reads the narrow ledger
and not the texts. What each rule does to a policy comes from counts of the bit
patterns, which are at most two to the power of the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaselake.llm.mixing import WORD

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts.
SPAN = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letter_words", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule and the SQL condition, over the measures, under which a row fails it."""

    name: str
    fails: str


#: The place of a rule is its bit: new rules go to the end, and none is taken away.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "2 * word_chars < 5 * n_words"),
    Rule("long_words", "word_chars > 13 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("few_letters", "100 * n_letter_words < 60 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A row is kept if it fails none of ``rules``."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        places = {r.name: n for n, r in enumerate(rules)}
        return sum(1 << places[name] for name in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("1", (*BASE.rules, "many_symbols", "short_words", "long_words")), Policy("2", tuple(r.name for r in RULES)))}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of ``SPAN`` words that is found twice or more
    in the array, the first one included. Windows are sorted by hash, and neighbours
    of one hash are compared word by word; all is of order n log n."""

    def same(windows: Column, one: Column, other: Column) -> Column:
        equal = F.slice(words, one["at"] + 1, SPAN) == F.slice(words, other["at"] + 1, SPAN)
        return F.coalesce((one["h"] == other["h"]) & equal, F.lit(False))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, n: F.struct(h.alias("h"), n.alias("at"))))
        twice = _let(ordered, lambda s: F.filter(s, lambda x, n: same(s, x, F.get(s, n - 1)) | same(s, x, F.get(s, n + 1))))
        places = F.sort_array(F.transform(twice, lambda x: x["at"]))
        start = F.struct(F.lit(-SPAN).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(SPAN), p - a["last"])).alias("n")), lambda a: a["n"])

    def of_windows(single: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(single) - (SPAN - 1)), lambda n: F.xxhash64(F.slice(single, n, SPAN)))
        return _let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= SPAN, F.lit(0)).otherwise(_let(hashed, of_windows))


def measures(text: Column) -> Column:
    """A struct of ``MEASURES``, each long; a null text counts as an empty one."""
    def of_words(words: Column) -> Column:
        letters = F.filter(words, lambda w: w.rlike(r"\p{L}"))
        return F.struct(F.size(words).alias("n_words"), F.size(letters).alias("n_letter_words"), repeated_words(words).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    def of_text(given: Column) -> Column:
        chars = {"word_chars": F.length(F.translate(given, SPACES, "")), "n_symbols": F.length(given) - F.length(F.translate(given, SYMBOLS, ""))}
        words = _let(F.regexp_extract_all(given, F.lit(WORD), F.lit(0)), of_words)
        lines = _let(F.filter(F.split(given, "\n", -1), lambda x: x.rlike(WORD)), of_lines)
        parts = F.struct(words.alias("w"), lines.alias("l"), *[x.alias(c) for c, x in chars.items()])
        place = {c: part for part, names in (("w", ("n_words", "n_letter_words", "n_repeat_words")), ("l", ("n_lines", "n_dup_lines"))) for c in names}
        return _let(parts, lambda p: F.struct(*[(p[place[c]][c] if c in place else p[c]).cast("long").alias(c) for c in MEASURES]))

    return _let(F.coalesce(text, F.lit("")), of_text)


def quality_ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the ``MEASURES`` and ``failed``, a
    long with one bit a rule.

    Nothing is shuffled. Null, empty and wordless texts measure 0 throughout. Rows
    with a null or repeated id are rows like any other; an empty table gives an
    empty ledger; other columns are ignored, whatever their names.
    """
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    row = docs.select(docs[id_col].alias(id_col), measures(docs[text]).alias("_m"))
    flat = row.select(id_col, *[F.col("_m")[c].alias(c) for c in MEASURES])
    bits = [F.when(F.expr(r.fails), F.lit(1 << n)).otherwise(F.lit(0)).cast("long") for n, r in enumerate(rules)]
    failed = F.lit(0).cast("long")
    for bit in bits:
        failed = failed.bitwiseOR(bit)
    return flat.withColumn("failed", failed)


def apply_policy(ledger: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and ``policy``, the version that
    was applied. A row that fails the base is never kept."""
    base, mask = BASE.mask(rules), BASE.mask(rules) | policy.mask(rules)
    hit = lambda m: F.col("failed").bitwiseAND(F.lit(m)) != 0
    return ledger.withColumns({"base_failed": hit(base), "kept": ~hit(mask), "policy": F.lit(policy.version)})


def ablations(ledger: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule of a policy does: ``rule``, ``n_failed`` (rows that fail it),
    ``n_alone`` (rows that would be kept without it), ``words_alone`` (their words)
    and ``n_first`` (rows that fail it and no rule before it).

    Rows are counted by bit pattern first, so what follows has few rows."""
    mask = policy.mask(rules)
    patterns = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum("n_words").alias("_w"))
    named = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << n).cast("long").alias("bit")) for n, r in enumerate(rules) if mask >> n & 1]
    each = patterns.select("_p", "_n", "_w", F.explode(F.array(*named)).alias("r"))
    bit, none = F.col("r")["bit"], F.lit(0)

    def total(when: Column, what: str) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(none)).cast("long")

    first = F.col("_p").bitwiseAND(-F.col("_p")) == bit
    return each.groupBy(F.col("r")["rule"].alias("rule")).agg(
        total(F.col("_p").bitwiseAND(bit) != 0, "_n").alias("n_failed"), total(F.col("_p") == bit, "_n").alias("n_alone"), total(F.col("_p") == bit, "_w").alias("words_alone"), total(first, "_n").alias("n_first")
    )


SQL = r"""
WITH given AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
  SELECT r, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM given)
), windows AS (
  SELECT r, pos, count(*) OVER (PARTITION BY r, w) AS n FROM (
    SELECT r, pos, array_to_string(list_slice(words, pos, pos + 7), ' ') AS w FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS pos FROM given WHERE len(words) > 8))
), repeated AS (
  SELECT r, sum(least(8, pos - coalesce(before, -8))) AS n FROM (SELECT r, pos, lag(pos) OVER (PARTITION BY r ORDER BY pos) AS before FROM windows WHERE n > 1) GROUP BY r
), measured AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    n_lines, n_dup_lines, len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words, coalesce(n, 0) AS n_repeat_words
  FROM given JOIN lines USING (r) LEFT JOIN repeated USING (r)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 13 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 100 * n_letter_words < 60 * n_words AS more_failed
  FROM measured
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT more_failed AS kept
FROM judged
"""

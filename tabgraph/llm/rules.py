"""Quality rules as weak supervision: rules vote or abstain, a label model weighs them.

Every rule looks at counts of one whole text and says keep (1), drop (-1) or nothing (0). How far
each rule can be trusted is not set by hand: expectation-maximisation estimates, from the votes of
all documents, how often a rule says keep of good documents and drop of bad ones. The posterior
probability that a document is good, given its votes, then decides. A rule that nearly always says
keep thereby carries no weight, and one rare but telling drop can outweigh many keeps.

Documents that fail the base test go whatever the votes and take no part in the fit. The fit needs
only how many documents cast each pattern of votes, at most 3 ** len(RULES) rows whatever the size
of the corpus; all its steps are one expression over them. Texts are read once, in DataFrame
functions only. Windows of words are compared inside their row, by a sort, so a text
with a million words costs n log n, and no word is shuffled.

Defined cases: null text counts as empty; every row is judged on its own, so repeated rows, rows
that repeat a doc_id and rows without one each get a result, and each counts once in the fit; texts
without words fail the base test; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgraph.distributed import materialize, with_scalars
from tabgraph.functions.numbers import bound

#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS, PUNCTUATION = "#*$%&|<>", string.punctuation
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """SQL conditions on the counts: ``drop`` is asked first; neither means the rule abstains."""

    name: str
    drop: str
    keep: str


#: Thresholds are fixed values in common use for web text; all counts are whole numbers.
RULES = (
    Rule("length", "n_words < 50", "n_words >= 100"),
    Rule("word_size", "word_chars < 2 * n_words or word_chars > 15 * n_words",
         "word_chars >= 3 * n_words and word_chars <= 10 * n_words"),
    Rule("marks", "100 * n_marks > 10 * word_chars", "100 * n_marks <= 6 * word_chars"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines", "n_lines > 2 and n_dup_lines = 0"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words", "100 * n_repeat_words <= 20 * n_words"),
    Rule("capitals", "10 * n_capitals > 3 * word_chars", "10 * n_capitals <= word_chars"),
    Rule("shouting", "10 * n_shouts > n_words", "100 * n_shouts <= n_words"),
    Rule("digits", "10 * n_digits > 2 * word_chars", "100 * n_digits <= 2 * word_chars"),
    Rule("sentences", "n_words > 100 * n_ends", "n_words <= 40 * n_ends and n_words >= 3 * n_ends"),
)
#: Steps of the fit, and the beliefs it starts from and leans to, each worth ``PSEUDO`` votes.
STEPS, PSEUDO = 30, 20.0
START_GOOD, START_KEEP, START_DROP = 0.8, 0.98, 0.3
#: Documents whose posterior is below it go.
THRESHOLD = 0.5


def _marks(text: Column) -> Column:
    """Struct of character counts: white space, symbols, capitals, digits, shouts, sentence ends, ASCII punctuation.

    The small letters, most of any text, go first; the counts are taken from what is left.
    """
    sets = {"spaces": " \t\n\v\f\r", "symbols": SYMBOLS, "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
            "digits": "0123456789", "shouts": "!", "ends": ".!?", "marks": PUNCTUATION}
    return bound(F.translate(text, "abcdefghijklmnopqrstuvwxyz", ""), lambda x: F.struct(*[
        (F.length(x) - F.length(F.translate(x, held, ""))).cast("long").alias(name) for name, held in sets.items()]))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that stand in a window of words found twice or more in the array.

    Hashes of all windows show quickly that nothing repeats. Otherwise windows are sorted by hash
    and words, so equal ones are neighbours; the words themselves decide, not the hash.
    """
    def hashes(w: Column) -> Column:
        last = F.size(w) - window
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def found(w: Column, h: Column) -> Column:
        entries = F.sort_array(F.transform(h, lambda x, i: F.struct(
            x.alias("h"), *[F.get(w, i + k).alias(f"w{k}") for k in range(window)], i.alias("i"))))
        same = lambda x, y: reduce(lambda a, b: a & b, [x[c] == y[c] for c in ("h", *(f"w{k}" for k in range(window)))])
        pairs = bound(entries, lambda e: F.filter(
            F.zip_with(e, F.slice(e, 2, F.greatest(F.size(e), F.lit(1))), lambda x, y: F.when(same(x, y), F.struct(
                x["i"].alias("i"), y["i"].alias("j")))), lambda p: p.isNotNull()))
        covered = F.flatten(F.transform(pairs, lambda p: F.array(
            *[p["i"] + k for k in range(window)], *[p["j"] + k for k in range(window)])))
        return F.size(F.array_distinct(covered))

    counted = bound(words, lambda w: bound(hashes(w), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), found(w, h)).otherwise(F.lit(0))))
    return counted.cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts of every whole text), a row for a row."""
    text = F.col("text")
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.length(text).cast("long").alias("_n"), _marks(text).alias("_m"),
        bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("_w"),
        bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("_l"))
    return held.select(
        "doc_id", F.col("_w.n").alias("n_words"), (F.col("_n") - F.col("_m.spaces")).alias("word_chars"),
        F.col("_m.symbols").alias("n_symbols"), (F.col("_l.n") - F.col("_l.d")).alias("n_dup_lines"),
        F.col("_w.r").alias("n_repeat_words"), F.col("_l.n").alias("n_lines"),
        *[F.col(f"_m.{c}").alias(f"n_{c}") for c in ("capitals", "digits", "shouts", "ends", "marks")])


def votes(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts with ``base_failed`` and a column ``v_<rule>`` each: 1 keep, -1 drop, 0 no vote."""
    said = lambda r: F.when(F.expr(r.drop), -1).when(F.expr(r.keep), 1).otherwise(0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumns({"base_failed": failed, **{f"v_{r.name}": said(r) for r in rules}})


def _weights(model: Column) -> Column:
    """Log odds that a keep (``up``) or a drop (``down``) of each rule adds."""
    return F.zip_with(model["keep"], model["drop"], lambda k, d: F.struct(
        F.ln(k / (1 - d)).alias("up"), F.ln((1 - k) / d).alias("down")))


def _posterior(good: Column, weights: Column, cast: Column) -> Column:
    """Probability that a document is good, given its votes. Abstaining says nothing."""
    said = F.zip_with(cast, weights, lambda v, w: F.when(v > 0, w["up"]).when(v < 0, w["down"]).otherwise(F.lit(0.0)))
    odds = F.aggregate(said, F.ln(good / (1 - good)), lambda acc, x: acc + x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _total(entries: Column, value) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + value(e))


def _leaning(start: float, part: Column, whole: Column) -> Column:
    return (F.lit(PSEUDO * start) + part) / (F.lit(PSEUDO) + whole)


def _step(model: Column, patterns: Column, n_rules: int) -> Column:
    """One step: posteriors of the patterns (n, votes) under ``model``, and the model they imply."""
    def improved(weighed: Column) -> Column:
        def share(start: float, side: str, sign: int) -> Column:
            def of(j):
                hit = lambda e, test: F.when(test(F.get(e["votes"], j)), e[side]).otherwise(F.lit(0.0))
                return _leaning(start, _total(weighed, lambda e: hit(e, lambda v: v == sign)), _total(weighed, lambda e: hit(e, lambda v: v != 0)))
            return F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), of)

        return F.struct(
            _leaning(START_GOOD, _total(weighed, lambda e: e["good"]), _total(weighed, lambda e: e["good"] + e["bad"])).alias("good"),
            share(START_KEEP, "good", 1).alias("keep"), share(START_DROP, "bad", -1).alias("drop"))

    weighed = bound(_weights(model), lambda w: F.transform(patterns, lambda p: bound(
        _posterior(model["good"], w, p["votes"]), lambda q: F.struct(
            p["votes"].alias("votes"), (p["n"] * q).alias("good"), (p["n"] * (1 - q)).alias("bad")))))
    return bound(weighed, improved)


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES, steps: int = STEPS) -> DataFrame:
    """One row: ``good``, the share of good documents, and per rule the chance of a keep of good ones
    (``keep``) and of a drop of bad ones (``drop``), if it votes. Rows that failed the base test stay out."""
    cast = F.array(*[f"v_{r.name}" for r in rules])
    patterns = voted.filter("not base_failed").groupBy(cast.alias("votes")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    held = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    repeat = lambda x: F.array_repeat(F.lit(x), len(rules))
    start = F.struct(F.lit(START_GOOD).alias("good"), repeat(START_KEEP).alias("keep"), repeat(START_DROP).alias("drop"))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda model, _: _step(model, F.col("patterns"), len(rules)))
    return held.select(fitted.alias("m")).select("m.*")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): counts, ``base_failed``, ``quality`` (the posterior) and ``kept``."""
    voted = materialize(votes(counts(docs), rules))
    cast = F.array(*[f"v_{r.name}" for r in rules])
    weighed = with_scalars(voted, materialize(fit(voted, rules)))
    quality = _posterior(F.col("good"), _weights(F.struct("keep", "drop")), cast)
    return weighed.withColumn("quality", quality).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), F.round("quality", 6).alias("quality"))

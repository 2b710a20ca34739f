r"""Quality rules whose cutoffs carry a bound on false rejection.

Seven ratios are measured on every whole text.  Labelled documents are divided by
a hash of their id: a third proposes, the rest, the holdout, certifies.  Strata are
bands of text lengths; neighbours are joined until the holdout of each has enough
good documents for a bound of half of ``max_false_rejection`` if none is rejected.

In each stratum the proposing third lays down one sequence of steps, each of which
adds a rule or lowers its cutoff.  A step looks at the proposing documents that the
steps before it leave: strictness ``s`` gives a rule the smallest cutoff that at most
a share ``s`` of the good ones reaches, and of the mildest strictness at which any
rule is worth it, the rule that reaches most bad ones is taken.  A rule is worth it if
it reaches ``LEAST_GAIN`` times as large a share of the bad documents as of the good
ones (counted with one more); where none is, or after ``MOST_STEPS``, the sequence
ends.  The holdout then tests
the steps in turn: with x of n good holdout documents rejected so far, the exact
(Clopper-Pearson) upper bound on the false rejection rate must not exceed
``max_false_rejection``.  The first failure ends the sequence, which needs no further
correction as its order does not depend on the holdout; across strata the error
level is divided by their number (Bonferroni).  So with probability ``1 - error`` no
stratum rejects more than ``max_false_rejection`` of its good documents.  A stratum
with too few labels, or without bad ones, gets no cutoff and rejects by the base
rules alone.

Defined edge cases: a null or empty text has no words and fails the base rules;
repeated rows are judged alike; labels of a repeated or null id count as the
smallest quality, or not at all; without labels only the base rules hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.shared import discard, give_back, keep, materialize, small_batches
from folioflow.llm.textvec import Texts, slices, windows

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Upper ends of the strata, in words; the last stratum is open.
STRATA = (100, 400, 1600)
STRICTNESS = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.008, 0.012)
LEAST_GAIN = 5.0
MOST_STEPS = 12
MAX_FALSE_REJECTION = 0.02
ERROR = 0.05
BINS = 400

_CONTINUATION = (np.arange(256) & 0xC0) == 0x80
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_doubled")


def repeated_words(word_hashes: np.ndarray, width: int = WINDOW) -> int:
    """Return how many words lie in windows that occur twice or more."""
    grams = windows(word_hashes, width)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    again = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    cover = np.zeros(len(word_hashes) + 1, np.int32)
    cover[again] += 1
    cover[again + width] -= 1
    return int(np.count_nonzero(np.cumsum(cover)))


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """Return the counts named in FEATURES for each text."""
    starts, ends, offsets = texts.words()
    words = texts.hashes(starts, ends)
    data, solid = texts.data, ~_BLANK[texts.data]
    line_starts, line_ends, line_offsets = texts.lines()
    filled = np.concatenate([[0], np.cumsum(solid)])
    with_word = filled[line_ends] > filled[line_starts]
    of_line = np.repeat(np.arange(texts.n), np.diff(line_offsets))[with_word]
    lines = texts.hashes(line_starts[with_word], line_ends[with_word])
    n_lines = np.bincount(of_line, minlength=texts.n)
    order = np.lexsort((lines, of_line))
    dup = (lines[order][1:] == lines[order][:-1]) & (of_line[order][1:] == of_line[order][:-1])
    doubled = np.zeros(len(words), bool)
    doubled[1:] = words[1:] == words[:-1]
    doubled[offsets[:-1][offsets[:-1] < len(words)]] = False
    return {
        "n_words": np.diff(offsets),
        "word_chars": texts.sums(solid & ~_CONTINUATION[data]),
        "n_symbols": texts.sums(_SYMBOL[data]),
        "n_dup_lines": np.bincount(of_line[order][1:][dup], minlength=texts.n),
        "n_repeat_words": np.array([repeated_words(words[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64),
        "n_lines": n_lines,
        "n_upper": texts.sums(_UPPER[data]),
        "n_doubled": texts.sums(doubled, offsets),
    }


def with_features(docs: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """Add the counts of ``text_col`` to the rows of ``docs``, named prefix + feature."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + name, T.LongType()) for name in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in slices(batch.column(text_col)):
                got = measure(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *(pa.array(got[n].astype(np.int64)) for n in FEATURES)], names=[*batch.schema.names, *(prefix + n for n in FEATURES)])
        give_back()

    return docs.mapInArrow(run, schema)


def base_failed(prefix: str = "") -> Column:
    """Whether the base rules reject a row with features."""
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < MIN_WORDS) | (r * 100 > n * MAX_REPEAT_PERCENT)


def _stratum(prefix: str) -> Column:
    n = F.col(prefix + "n_words")
    return sum(((n >= top).cast("int") for top in STRATA[1:]), (n >= STRATA[0]).cast("int"))


def _bins(prefix: str) -> dict[str, Column]:
    """The ratios, each in equal bins; a document is bad towards the high ones."""
    c = lambda name: F.col(prefix + name).cast("double")
    words, lines = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0))
    mean = c("word_chars") / words
    ratios = {
        "repeat": c("n_repeat_words") / words,
        "dup_lines": c("n_dup_lines") / lines,
        "symbols": c("n_symbols") / words,
        "upper": c("n_upper") / F.greatest(c("word_chars"), F.lit(1.0)),
        "doubled": c("n_doubled") / words,
        "long_words": mean / 20,
        "short_words": 1 - mean / 20,
    }
    return {name: F.floor(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)) * BINS).cast("int") for name, ratio in ratios.items()}


RULES = ("repeat", "dup_lines", "symbols", "upper", "doubled", "long_words", "short_words")


def upper_bound(x: int, n: int, error: float) -> float:
    """Return the exact binomial upper bound on a rate, with x of n seen, at an error level."""
    if x >= n:
        return 1.0
    if not x:
        return 1.0 - error ** (1.0 / n)

    def at_most(p: float) -> float:  # P(X <= x)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(x + 1)]
        top = max(logs)
        return math.exp(top) * math.fsum(math.exp(v - top) for v in logs)

    low, high = x / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if at_most(mid) > error:
            low = mid
        else:
            high = mid
    return high


def _rejects(cutoffs: dict[tuple[int, str], int], prefix: str) -> Column:
    """Whether any ratio reaches the cutoff of its stratum."""
    stratum, verdict = _stratum(prefix), F.lit(False)
    bins = _bins(prefix)
    for k in range(len(STRATA) + 1):
        own = F.lit(False)
        for rule in RULES:
            if (k, rule) in cutoffs:
                own = own | (bins[rule] >= cutoffs[k, rule])
        verdict = F.when(stratum == k, own).otherwise(verdict)
    return verdict


@dataclass(frozen=True)
class Certificate:
    """What the holdout showed of one stratum: its bands of lengths, steps that hold, and the bound."""

    bands: tuple[int, ...]
    steps: tuple[tuple[str, int], ...]
    good: int
    rejected: int
    bound: float


def strata(good: dict[int, int], max_false_rejection: float, error: float) -> list[tuple[int, ...]]:
    """Join neighbouring bands until each has enough good holdout documents; see the module's description."""
    groups = [(k,) for k in range(len(STRATA) + 1)]
    while len(groups) > 1:
        bounds = [upper_bound(0, sum(good.get(k, 0) for k in g), error / len(groups)) for g in groups]
        worst = max(range(len(groups)), key=lambda i: (bounds[i], -i))
        if bounds[worst] <= max_false_rejection / 2:
            break
        beside = [i for i in (worst - 1, worst + 1) if 0 <= i < len(groups)]
        other = max(beside, key=lambda i: (bounds[i], -i))
        low = min(worst, other)
        groups[low : low + 2] = [groups[low] + groups[low + 1]]
    return groups


def next_step(good: dict[str, np.ndarray], bad: dict[str, np.ndarray], n_good: int, n_bad: int) -> tuple[str, int] | None:
    """Return the step (rule, cutoff) for histograms, by rule, of the documents left, of n_good and n_bad in all."""
    reach = lambda counts: counts[::-1].cumsum()[::-1]  # noqa: E731  documents at or above each bin
    g, b = {r: reach(c) for r, c in good.items()}, {r: reach(c) for r, c in bad.items()}
    nothing = np.zeros(BINS + 2, np.int64)
    for s in STRICTNESS:
        at = {r: int(np.flatnonzero(g.get(r, nothing) <= s * n_good)[0]) for r in b}
        worth = [r for r in b if int(b[r][at[r]]) / n_bad >= LEAST_GAIN * (int(g.get(r, nothing)[at[r]]) + 1) / (n_good + 1)]
        if worth:
            best = min(worth, key=lambda r: (-int(b[r][at[r]]), RULES.index(r)))
            return best, at[best]
    return None


def _first_step(steps: dict[tuple[int, ...], list[tuple[str, int]]]) -> Column:
    """The number of the first step of its stratum that rejects a row of (band, features); null for none."""
    bins, first = _bins(""), F.lit(None).cast("int")
    for bands, own in steps.items():
        if own:
            hit = F.coalesce(*(F.when(bins[r] >= cut, F.lit(k)) for k, (r, cut) in enumerate(own)))
            first = F.when(F.col("band").isin(*bands), hit).otherwise(first)
    return first


def certify(features: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, error: float = ERROR) -> list[Certificate]:
    """Return what holds in each stratum, from rows (doc_id, features) and labels (doc_id, quality).

    Only counts reach the driver: bands x rules x bins x labels, and bands x steps, whatever the input.
    """
    quality = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    known = features.join(quality, "doc_id").where(~base_failed())
    third = F.pmod(F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string"))), F.lit(3))
    known = materialize(known.select((third > 0).alias("holdout"), (F.col("q") == 1).alias("good"), _stratum("").alias("band"), *FEATURES), "labelled")
    bins = _bins("")
    held = {r["band"]: r["count"] for r in known.where("holdout AND good").groupBy("band").count().collect()}
    groups = strata(held, max_false_rejection, error)
    of = {k: g for g in groups for k in g}
    proposing = known.where("NOT holdout").select("band", "good", *FEATURES)
    total = dict.fromkeys([(g, q) for g in groups for q in (True, False)], 0)
    for row in proposing.groupBy("band", "good").count().collect():
        total[of[row["band"]], row["good"]] += row["count"]
    steps: dict[tuple[int, ...], list[tuple[str, int]]] = {g: [] for g in groups}
    going = [g for g in groups if total[g, True] and total[g, False]]
    for _ in range(MOST_STEPS):
        if not going:
            break
        left = proposing.where(F.col("band").isin(*(k for g in going for k in g)) & _first_step(steps).isNull())
        long = left.select("band", "good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), bins[r].alias("bin")) for r in RULES))).alias("x"))
        counts: dict[tuple[tuple[int, ...], bool], dict[str, np.ndarray]] = {}
        for row in long.groupBy("band", "good", "x.rule", "x.bin").count().collect():
            hist = counts.setdefault((of[row["band"]], row["good"]), {}).setdefault(row["rule"], np.zeros(BINS + 2, np.int64))
            hist[row["bin"]] += row["count"]
        new = {g: next_step(counts.get((g, True), {}), counts.get((g, False), {}), total[g, True], total[g, False]) for g in going}
        going = [g for g in going if new[g]]
        for g in going:
            steps[g].append(new[g])
    tests = known.where("holdout AND good").groupBy("band", _first_step(steps).alias("step")).count().collect()
    out = []
    for g in groups:
        n = sum(held.get(k, 0) for k in g)
        holds, x, bound = 0, 0, upper_bound(0, n, error / len(groups))
        for k in range(len(steps[g])):
            more = x + sum(r["count"] for r in tests if r["band"] in g and r["step"] == k)
            now = upper_bound(more, n, error / len(groups))
            if now > max_false_rejection:
                break
            holds, x, bound = k + 1, more, now
        out.append(Certificate(g, tuple(steps[g][:holds]), n, x, bound))
    discard(known)
    return out


def fit_cutoffs(features: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, error: float = ERROR) -> dict[tuple[int, str], int]:
    """Return certified cutoffs (band, rule) -> bin; see certify()."""
    cutoffs: dict[tuple[int, str], int] = {}
    for c in certify(features, labels, max_false_rejection, error):
        for rule, at in c.steps:
            cutoffs |= {(band, rule): min(at, cutoffs.get((band, rule), at)) for band in c.bands}
    return cutoffs


def _prefix(docs: DataFrame) -> str:
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """Return doc_id, the counts, base_failed and kept for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = keep(with_features(rows, "text", "").drop("text"))
    cutoffs = fit_cutoffs(features, labels, **options)
    return features.select("doc_id", *FEATURES, base_failed().alias("base_failed"), (~base_failed() & ~_rejects(cutoffs, "")).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """Return the rows of ``docs`` that the rules keep, with their own columns only.

    The texts are measured twice, once to fit the cutoffs and once to apply them,
    so that no text is shuffled or written in between.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cutoffs = fit_cutoffs(with_features(rows, "text", "").drop("text"), labels, **options)
    prefix = _prefix(docs)
    return with_features(docs, text_col, prefix).where(~base_failed(prefix) & ~_rejects(cutoffs, prefix)).select(*docs.columns)

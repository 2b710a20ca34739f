r"""Quality scores by Bradley-Terry ranking of document pairs.

Features of a whole text are ratios of counts (words, lines, repeats, symbols,
case, digits, ...), each cut at quantiles of all labelled rows into bins, so a text
is a sparse 0/1 vector.  Pairs of a good and a bad document are drawn, and weights
are learned by logistic loss on the difference of the two vectors: the log-odds that
the first is preferred.  The weighted sum is a document's score; the threshold is
the quantile of all labelled rows' scores at the share of bad documents.  The
reported score is a logistic curve through 0.7 at that threshold, so ``predicted``
is score >= 0.7.

Every labelled row that is not held out is learned from.  They are dealt out by a hash
of the id into blocks of about ``BLOCK_ROWS``; each block draws its own pairs, with
each of its rows in one at least, and the mean of the blocks' weights is taken, by
their rows.  Quantiles are exact: counts of leading bits, then of further bits below
those that hold a wanted rank.  Counts and weights reach the driver, rows do not.

Defined edge cases: null and empty texts have all counts 0 and are scored;
without both labels in the sample every score is 0.5; labels of a repeated id
count as the smallest, and its text with the smallest hash is learned from;
repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.ppm_langid import held_out
from folioflow.llm.quality_rules import measure
from folioflow.llm.shared import discard, materialize, small_batches
from folioflow.llm.textvec import Texts, slices

BLOCK_ROWS = 20_000
PAIRS = 60_000
BINS = 16
CUT = 0.7
SEED = 11
#: Rows of the rarer label that a block has on average at least.
LEAST_OF_A_LABEL = 200
#: Levels of the cut points, slopes that are tried (by the spread of sums), and the bits that each pass for quantiles counts.
LEVELS, SLOPES, DIGITS = np.linspace(0, 1, BINS + 1)[1:-1], np.geomspace(0.02, 20, 60), (16, 12, 12, 12, 12)
_TOP = np.uint64(1 << 63)


_BYTE = np.arange(256)
_DIGIT, _LOWER, _HIGH = (_BYTE >= 48) & (_BYTE < 58), (_BYTE >= 97) & (_BYTE < 123), _BYTE >= 192
_STOP, _BANG = (np.isin(_BYTE, np.frombuffer(marks, np.uint8)) for marks in (b".,;:!?", b"!?"))


def features(texts: Texts) -> np.ndarray:
    """Return texts x features: ratios that do not depend on the language's words."""
    m = {k: v.astype(np.float64) for k, v in measure(texts).items()}
    starts, ends, offsets = texts.words()
    words = texts.hashes(starts, ends)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.float64)
    count = {k: texts.sums(mask[texts.data]).astype(np.float64) for k, mask in (("digit", _DIGIT), ("lower", _LOWER), ("stop", _STOP), ("high", _HIGH), ("bang", _BANG))}
    n, chars, lines = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1), np.maximum(m["n_lines"], 1)
    return np.stack(
        [
            np.log1p(m["n_words"]), m["word_chars"] / n, m["n_symbols"] / n, m["n_dup_lines"] / lines, m["n_repeat_words"] / n, m["n_upper"] / chars, m["n_doubled"] / n,
            n / lines, distinct / n, distinct / np.sqrt(n), count["digit"] / chars, count["lower"] / chars, count["stop"] / n, count["high"] / chars, count["bang"] / n,
        ],
        axis=1,
    )


class Ranker:
    """Cut points, weights and threshold of a learned ranking."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS):
        self.ready = bool(len(good)) and bool(good.any()) and not good.all()
        if not self.ready:
            return
        self._cut(np.quantile(x[:, k], LEVELS) for k in range(x.shape[1]))
        self.weights = self.learned(x, good, pairs)
        s = self.sums(x)
        self.threshold = float(np.quantile(s, 1 - good.mean()))
        self.slope = self._steepness(s - self.threshold, good)

    def _cut(self, quantiles: Iterable[np.ndarray]) -> None:
        self.cuts = [np.unique(q) for q in quantiles]
        self.first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.cuts])])

    def learned(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS) -> np.ndarray:
        """Return the weights of pairs drawn from these rows; both labels must be there."""
        bins = self._bins(x)
        rng = np.random.default_rng(SEED)
        goods, bads = np.flatnonzero(good), np.flatnonzero(~good)
        a, b = rng.choice(goods, pairs), rng.choice(bads, pairs)
        left, right = np.setdiff1d(goods, a), np.setdiff1d(bads, b)  # rows in no pair yet
        a, b = np.concatenate([a, left, rng.choice(goods, len(right))]), np.concatenate([b, rng.choice(bads, len(left)), right])
        pairs = len(a)
        weights, velocity, size = np.zeros(self.first[-1]), np.zeros(self.first[-1]), 2.0
        for _ in range(400):  # gradient descent with momentum on the mean logistic loss
            ahead = weights + 0.9 * velocity
            margin = ahead[bins[a]].sum(axis=1) - ahead[bins[b]].sum(axis=1)
            pull = 1 / (1 + np.exp(np.clip(margin, -60, 60))) / pairs
            slope = 1e-4 * ahead
            slope -= np.bincount(bins[a].ravel(), np.repeat(pull, bins.shape[1]), len(ahead))
            slope += np.bincount(bins[b].ravel(), np.repeat(pull, bins.shape[1]), len(ahead))
            velocity = 0.9 * velocity - size * slope
            weights += velocity
        return weights

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Return the weighted sums, before threshold and slope."""
        return self.weights[self._bins(x)].sum(axis=1)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.first[k] + np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], 1)

    @staticmethod
    def _losses(s: np.ndarray, good: np.ndarray, tried: np.ndarray) -> np.ndarray:
        """Of each slope, the summed loss of a logistic curve through CUT at 0."""
        base = np.log(CUT / (1 - CUT))
        return np.array([np.logaddexp(0, np.where(good, -1, 1) * (k * s + base)).sum() for k in tried])

    @classmethod
    def _steepness(cls, s: np.ndarray, good: np.ndarray) -> float:
        """The slope of a logistic curve through CUT at 0 that fits the labels best."""
        tried = SLOPES / max(float(s.std()), 1e-9)
        return float(tried[int(np.argmin(cls._losses(s, good, tried)))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Return scores from 0 to 1."""
        if not self.ready:
            return np.full(len(x), 0.5)
        s = self.sums(x) - self.threshold
        return 1 / (1 + np.exp(-np.clip(self.slope * s + np.log(CUT / (1 - CUT)), -60, 60)))


def _codes(values: np.ndarray) -> np.ndarray:
    """64-bit codes in the order of the numbers."""
    bits = (values + 0.0).view(np.uint64)  # one zero
    return np.where(bits >> np.uint64(63), ~bits, bits | _TOP)


def _values(codes: np.ndarray) -> np.ndarray:
    return np.where(codes >> np.uint64(63), codes & ~_TOP, ~codes).view(np.float64)


def quantiles(rows: DataFrame, column: str, count: int, width: int, levels: np.ndarray) -> np.ndarray:
    """Return width x levels: exact quantiles, as numpy's, of each place of an array column of ``count`` rows.

    A pass counts the next bits of the codes that begin like one with a wanted rank, so
    the driver gets at most a table of counts for each of these beginnings.
    """
    at = levels * (count - 1)
    low = np.floor(at).astype(np.int64)
    ranks = np.tile(np.concatenate([low, np.minimum(low + 1, count - 1)]), (width, 1))
    begin, below, done = np.zeros(ranks.shape, np.uint64), np.zeros(ranks.shape, np.int64), 0
    for bits in DIGITS:
        wanted = rows.sparkSession.sparkContext.broadcast([np.unique(b) for b in begin])
        shift, before = np.uint64(64 - done - bits), np.uint64(bits)

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted, shift=shift, before=before, done=done) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, width)
                for k in range(width):
                    code = _codes(np.ascontiguousarray(x[:, k])) >> shift
                    if done:
                        code = code[np.isin(code >> before, wanted.value[k])]
                    code, n = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "code", "n"])

        got = rows.select(column).mapInArrow(run, "k int, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n")).toArrow()
        place, code, n = got.column("k").to_numpy(), got.column("code").to_numpy().view(np.uint64), got.column("n").to_numpy()
        for k in range(width):
            own = np.flatnonzero(place == k)
            own = own[np.argsort(code[own])]
            found, size = code[own], n[own]
            for j in range(ranks.shape[1]):
                inside = slice(*np.searchsorted(found >> before, [begin[k, j], begin[k, j] + np.uint64(1)])) if done else slice(0, len(found))
                upto = below[k, j] + np.cumsum(size[inside])
                i = int(np.searchsorted(upto, ranks[k, j], side="right"))
                below[k, j] = upto[i] - size[inside][i]
                begin[k, j] = found[inside][i]
        done += bits
    value = _values(begin)
    a, b, t = value[:, : len(levels)], value[:, len(levels) :], at - low
    return np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, good, x), written: features of all labelled rows that are not held out, one row an id."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "h")), pa.array(list(features(texts)), pa.list_(pa.float64()))], names=["doc_id", "h", "x"])

    # Texts do not go through the join: features of all rows that may be learned from are few numbers each.
    found = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, x array<double>")
    # Of the texts of a repeated id the one with the smallest hash is taken, so that reruns agree.
    got = found.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("h", "x")).alias("first"))
    return materialize(got.select("doc_id", (F.col("quality") == 1).alias("good"), "first.x"), "labelled")


def _by_block(dealt: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Return each block's rows and what ``work`` (x, good) gives for it, in the order of blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        out = work(x, table.column("good").to_numpy())
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "rows": pa.array([table.num_rows], pa.int64()), "out": pa.array([out], pa.list_(pa.float64()))})

    got = sorted(dealt.groupBy("block").applyInArrow(run, "block int, rows long, out array<double>").collect(), key=lambda r: r["block"])
    return np.array([r["rows"] for r in got], np.float64), np.array([r["out"] for r in got])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = BLOCK_ROWS) -> Ranker:
    """Learn from labels (doc_id, quality) of all rows that are not held out, in blocks of about ``rows``."""
    known = _labelled(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), labels.select("doc_id", "quality"))
    total, goods = known.agg(F.count("*"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0))).first()
    ranker = Ranker(np.empty((0, 1)), np.empty(0, bool))
    ranker.ready = 0 < goods < total
    if ranker.ready:
        blocks, rare = -(-total // rows), min(goods, total - goods)
        width = known.select(F.size("x")).first()[0]
        ranker._cut(quantiles(known, "x", total, width, LEVELS))
        # A row of a rare label goes to more than one block, so that each block has some.
        copies = F.when(F.col("good") == (2 * goods <= total), min(blocks, max(1, -(-LEAST_OF_A_LABEL * blocks // rare)))).otherwise(1)
        own = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
        dealt = known.withColumn("block", F.explode(F.sequence(own, own + copies - 1))).withColumn("block", (F.col("block") % blocks).cast("int"))
        n, weights = _by_block(dealt, lambda x, good: ranker.learned(x, good) if good.any() and not good.all() else np.zeros(ranker.first[-1]))
        ranker.weights = (n[:, None] * weights).sum(axis=0) / n.sum()

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = ranker.sums(batch.column(0).flatten().to_numpy().reshape(-1, width))
                yield pa.RecordBatch.from_arrays([pa.array(list(s[:, None]), pa.list_(pa.float64()))], names=["s"])

        scored = known.select("x").mapInArrow(sums, "s array<double>")
        ranker.threshold = float(quantiles(scored, "s", total, 1, np.array([1 - goods / total]))[0, 0])
        away = lambda x: ranker.sums(x) - ranker.threshold
        once = known.withColumn("block", own.cast("int"))
        _, moments = _by_block(once, lambda x, good: np.array([away(x).sum(), (away(x) ** 2).sum()]))
        mean, square = moments.sum(axis=0) / total
        tried = SLOPES / max(float(np.sqrt(max(square - mean**2, 0.0))), 1e-9)
        _, losses = _by_block(once, lambda x, good: Ranker._losses(away(x), good, tried))
        ranker.slope = float(tried[int(np.argmin(losses.sum(axis=0)))])
    discard(known)
    return ranker


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in slices(batch.column("text")):
                s = shared.value.score(features(texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")

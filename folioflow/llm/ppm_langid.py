r"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes of order 0 to 3, counted once on a
sample and then frozen.  The code length of a byte is that of PPM with escape
method C, without exclusion: with n bytes counted in a context, d of them
distinct, a known byte costs -ln(c / (n + d)), and an unknown one the escape
-ln(d / (n + d)) plus its cost in the next shorter context; a context that was
never seen passes on for free, and below order 0 every byte costs ln 256.  A text
starts after three line ends.  The language with the shortest code wins, and the
score is its share of the likelihoods, exp(-code length), of all languages.

The costs of all 4-byte strings that were counted in any language are tabulated,
so that a text is scored by table look-up over whole arrays; other strings take
the escape path, which is also tabulated, so code lengths are exact.

The sample: at most ``PER_LANGUAGE`` documents a language, those with the smallest
hash of their id, one text each, among texts of at most ``SAMPLE_CHARS`` characters.
Where there are fewer of these, the first ``SAMPLE_CHARS`` characters of longer texts
fill the sample up, so that every labelled language is learned.  Of many languages each
text teaches less, so that the driver holds ``TOTAL_CHARS`` at most, and languages are
tabulated ``GROUP`` at a time: their trees are independent, so their number is not
bounded.  Rows without a language or an id teach nothing.

Defined edge cases: a null text, or one without a letter, is ``und`` with score
0; without any training row every text is; ties go to the first language by
code point; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.shared import small_batches
from folioflow.llm.textvec import slices

PER_LANGUAGE = 300
SAMPLE_CHARS = 20_000
#: Characters of all samples together, least characters of a text, languages of a table.
TOTAL_CHARS, LEAST_CHARS, GROUP = 32_000_000, 100, 16
ORDER = 3
#: Bytes with a place in the direct index; strings with other bytes are searched for.
COMMON = 48
START = b"\n" * ORDER

_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Whether a row's id keeps it out of learning; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _grams(texts: list[bytes]) -> np.ndarray:
    """Return the 4-byte strings of texts, each after the start bytes, as unsigned ints."""
    found = []
    for text in texts:
        b = np.frombuffer(START + text, np.uint8).astype(np.uint32)
        found.append(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])
    return np.concatenate(found) if found else np.empty(0, np.uint32)


class Model:
    """Frozen statistics of all languages, in tables of some languages each."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        groups = [self.languages[i : i + GROUP] for i in range(0, len(self.languages), GROUP)]
        self.parts = [Tables({name: samples[name] for name in g}, direct=len(groups) == 1) for g in groups]

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Return code lengths in nats, texts x languages; ``data`` is all texts' bytes."""
        return np.concatenate([p.costs(data, offsets) for p in self.parts], axis=1) if self.parts else np.zeros((len(offsets) - 1, 0))


class Tables:
    """Frozen statistics of some languages, as tables of costs in nats.

    ``direct`` asks for an index of strings of common bytes, which takes 20 MB; other
    strings, or all without it, are searched for.
    """

    def __init__(self, samples: dict[str, list[bytes]], direct: bool = True):
        self.languages, self.direct = sorted(samples), direct
        n = len(self.languages)
        grams = [_grams(samples[name]) for name in self.languages]
        self.uniform = np.log(256.0)
        # Orders 0 and 1 are full tables; orders 2 and 3 hold the strings seen in any language.
        low = np.full((256, n), self.uniform)
        for k, g in enumerate(grams):
            low[:, k] = self._step(np.arange(256), g & 0xFF, 0, low[:, k])
        one = np.repeat(low[None], 256, 0).reshape(65536, n)
        for k, g in enumerate(grams):
            one[:, k] = self._step(np.arange(65536), g & 0xFFFF, 8, one[:, k])
        self.one = one.astype(np.float32)
        self.keys2, self.cost2, self.contexts2, self.escape2 = self._table([g & 0xFFFFFF for g in grams], one[:, :], 0xFFFF)
        two = lambda keys: self._lower(keys, self.keys2, self.cost2, self.contexts2, self.escape2, one)
        self.keys3, self.cost3, self.contexts3, self.escape3 = self._table(grams, None, 0xFFFFFF, two)
        counts = np.bincount(np.concatenate([g & 0xFF for g in grams]).astype(np.intp), minlength=256) if n else np.zeros(256, int)
        place = np.full(256, COMMON, np.int32)
        place[np.argsort(-counts, kind="stable")[:COMMON]] = np.arange(COMMON)
        self.place = place
        self._direct: np.ndarray | None = None

    @staticmethod
    def _step(keys: np.ndarray, grams: np.ndarray, bits: int, shorter: np.ndarray) -> np.ndarray:
        """Costs of ``keys`` (context, byte) in one language, given those in the shorter context."""
        if not len(grams):
            return shorter
        seen, count = np.unique(grams, return_counts=True)
        context, first = np.unique(seen >> 8 if bits or len(seen) and seen.max() > 255 else seen * 0, return_index=True)
        total, distinct = np.add.reduceat(count, first), np.diff(np.append(first, len(seen)))
        own = keys >> 8 if bits else keys * 0
        at = np.minimum(np.searchsorted(context, own), len(context) - 1)
        known = context[at] == own
        size = (total + distinct)[at]
        k = np.minimum(np.searchsorted(seen, keys), len(seen) - 1)
        hit = known & (seen[k] == keys)
        escape = np.where(known, -np.log(distinct[at] / size), 0.0)
        return np.where(hit, -np.log(np.where(hit, count[k], 1) / size), escape + shorter)

    def _table(self, grams: list[np.ndarray], one: np.ndarray | None, mask: int, lower=None):
        keys = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint32)
        shorter = one[keys & mask] if lower is None else lower(keys & mask)
        cost = np.stack([self._step(keys, g, 16, shorter[:, k]) for k, g in enumerate(grams)], 1) if grams else shorter
        contexts = np.unique(keys >> 8)
        escape = np.zeros((len(contexts), len(grams)))
        for k, g in enumerate(grams):
            seen, count = np.unique(g, return_counts=True)
            if len(seen):
                own, first = np.unique(seen >> 8, return_index=True)
                total, distinct = np.add.reduceat(count, first), np.diff(np.append(first, len(seen)))
                escape[np.searchsorted(contexts, own), k] = -np.log(distinct / (total + distinct))
        return keys, cost.astype(np.float32), contexts, escape.astype(np.float32)

    @staticmethod
    def _lower(keys, table, cost, contexts, escape, one):
        """Costs of strings by a table, or by escape from their context and the next table."""
        out = one[keys & 0xFFFF].astype(np.float32)
        if len(table):
            c = np.minimum(np.searchsorted(contexts, keys >> 8), len(contexts) - 1)
            out += np.where((contexts[c] == keys >> 8)[:, None], escape[c], np.float32(0))
            k = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            hit = table[k] == keys
            out[hit] = cost[k[hit]]
        return out

    def _index(self) -> np.ndarray:
        if self._direct is None:
            direct = np.full(COMMON**4, -1, np.int32)
            p = [self.place[(self.keys3 >> s) & 0xFF] for s in (24, 16, 8, 0)]
            common = np.all([x < COMMON for x in p], axis=0)
            at = ((p[0].astype(np.int64) * COMMON + p[1]) * COMMON + p[2]) * COMMON + p[3]
            direct[at[common]] = np.flatnonzero(common)
            self._direct = direct
        return self._direct

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Return code lengths in nats, texts x languages; ``data`` is all texts' bytes."""
        n, texts = len(self.languages), len(offsets) - 1
        if not len(data) or not n:
            return np.zeros((texts, n))
        # Each text is preceded by its start bytes.
        padded = np.full(len(data) + ORDER * texts, START[0], np.uint8)
        shift = np.repeat(np.arange(1, texts + 1) * ORDER, np.diff(offsets))
        padded[np.arange(len(data)) + shift] = data
        starts = offsets[:-1] + ORDER * np.arange(1, texts + 1)
        place = self.place[padded]
        at = ((place[:-3] * COMMON + place[1:-2]) * COMMON + place[2:-1]) * COMMON + place[3:]
        rare = place == COMMON
        rare = rare[:-3] | rare[1:-2] | rare[2:-1] | rare[3:]
        at[rare] = 0
        row = self._index()[at] if self.direct else np.full(len(at), -1, np.int32)
        row[rare] = -1
        lost = np.flatnonzero(row < 0)
        cost = self.cost3[row] if len(self.cost3) else np.zeros((len(row), n), np.float32)
        if len(lost):
            b = padded.astype(np.uint32)
            key = b[lost] << 24 | b[lost + 1] << 16 | b[lost + 2] << 8 | b[lost + 3]
            k = np.minimum(np.searchsorted(self.keys3, key), len(self.keys3) - 1)
            hit = self.keys3[k] == key
            c = np.minimum(np.searchsorted(self.contexts3, key >> 8), len(self.contexts3) - 1)
            escape = np.where((self.contexts3[c] == key >> 8)[:, None], self.escape3[c], np.float32(0))
            shorter = self._lower(key & 0xFFFFFF, self.keys2, self.cost2, self.contexts2, self.escape2, self.one)
            cost[lost] = np.where(hit[:, None], self.cost3[k], escape + shorter)
        total = np.zeros((texts, n))
        some = np.flatnonzero(np.diff(offsets) > 0)
        # Position p of ``cost`` is the string that ends at p + 3; the next text's padding lies between.
        inside = np.zeros(len(cost), bool)
        inside[np.arange(len(data)) + shift - ORDER] = True
        cost = cost[inside]
        total[some] = np.add.reduceat(cost, offsets[:-1][some], axis=0, dtype=np.float64)
        return total


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn the trees from rows that are not held out; see the module's description."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    languages = rows.agg(F.count_distinct("lang")).first()[0]
    chars = min(SAMPLE_CHARS, max(LEAST_CHARS, TOTAL_CHARS // max(1, languages * per_language)))
    rows = rows.withColumn("long", F.length("text") > SAMPLE_CHARS).withColumn("text", F.substring("text", 1, chars))
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang", "long").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("doc_id", "lang", "long", "n")
    picked = chosen.collect()  # at most per_language rows a language
    if not picked:
        return Model({})
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["lang"], r["long"]) for r in picked], "doc_id long, lang string, long boolean").distinct()
    # One text for each id, whichever comes first; texts reach the driver only after that.
    texts = rows.join(F.broadcast(ids), ["doc_id", "lang", "long"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return Model(samples)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, lang_pred, score and nats (the shortest code length) for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    limit = max(1 << 16, (1 << 22) // max(4, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, texts in slices(batch.column("text"), limit=limit):
                letters = [t is not None and _LETTER.search(t) is not None for t in batch.column("text").slice(i, j - i).to_pylist()]
                if m.languages:
                    cost = m.costs(texts.data, texts.offsets)
                    best = cost.argmin(axis=1)
                    least = cost[np.arange(len(best)), best]
                    share = 1 / np.exp(np.maximum(least[:, None] - cost, -700.0)).sum(axis=1)
                else:
                    best, least, share, letters = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i), [False] * (j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([m.languages[b] if ok else "und" for b, ok in zip(best, letters)], pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(np.where(letters, least, 0.0))],
                    names=["doc_id", "lang_pred", "score", "nats"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, nats double")

r"""N-gram Jaccard join by parity sketches.

A text is the set of its distinct ``width``-word shingles.  Two texts link when
``den * |A & B| >= num * |A | B|``.

Method.  Every shingle is a 64-bit token.  XOR-ing one bit per token gives a
parity sketch: a token in both sets cancels, so the Hamming distance of two
sketches never exceeds the symmetric difference of the sets, and a pair that
links differs in at most ``k = floor((den - num) * (|A| + |B|) / (den + num))``
bits.  The sketch (2**64 positions, kept sparsely) is cut into ``k + m + e``
parts.  By the pigeonhole principle at least ``m + e`` parts of a linked pair
are equal, so an equi-join on (size band, part, content) finds every linked
pair.  Empty parts, which unrelated sets share, are left out; a set with more
than ``e`` of them keeps them, so that a linked pair still shares ``m`` keys.
Sets belong to the band of their size, and to a higher band if a partner there
is within reach.

Sets with fewer than ``m`` shared keys in a band drop out of it; sets that share
only a passage go that way.  The rest have their tokens written once, with a
parity sketch folded to ``SKETCH_BITS`` bits for each bit that a linked pair may
differ in; a pair whose folded sketches differ in more than ``k`` bits cannot
link, and the exact check of the token sets has the last word.

Candidates are not expanded to all pairs.  Each set is first tried with the
smallest member of the buckets that it shares most often.  Then buckets of up to
``SMALL_BUCKET`` sets offer their pairs of different components.  Larger ones that have
their most shared member in common, as those of one group of near copies do, are one
bucket, unless that makes more pairs.  Only those that still hold several components are
looked at, and in them only pairs of
one member outside the bucket's largest component with any member of another
component: first, in a few small buckets of each member, its closest partner, in the
end all pairs that the sketch allows, so the components are exact.  As a linked
pair shares ``m`` keys, a set leaves ``m - 1`` of them out, those of the largest
buckets.  Large buckets are dealt out in blocks of members, to a square of blocks with
no more sides than the tasks need, and a key that many sets of a task have is not
gathered to be found.

Defined edge cases: null and empty texts have the empty set, size 0, and link
with nothing; texts with fewer than ``width`` words have one shingle, the whole
sequence.  Equal sets (copies) are one class, whatever their ids; rows with null
or repeated ids are kept, and the component id is the smallest non-null id; other
columns play no part.  Equality of shingles and of texts is that of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.components import connected_components
from folioflow.llm.shared import discard, give_back, keep, materialize, small_batches
from folioflow.llm.textvec import U64, Texts, mix, slices, windows

BAND_RATIO = 1.4
#: Parts beyond k, as a share of it, for keys that a linked pair must share.
COMMON_SHARE = 0.08
#: Keys that one reducer group holds on average, and that a mapper gathers.
KEYS_PER_BUCKET = 1 << 18
KEYS_PER_FLUSH = 400_000
#: Members beyond which a key of one flush is known as shared, and not gathered.
HOT_IN_FLUSH = 16
#: 64-bit words of a filter of text hashes: by the number of texts, 16 MiB at most.  Its false positives only cost time.
LEAST_FILTER, MOST_FILTER = 1 << 12, 1 << 21
#: Bits of a folded sketch for each bit that linked sets may differ in, and the largest sketch.
SKETCH_BITS, MOST_BITS = 12, 1 << 16
#: Members up to which a bucket offers all its pairs.
SMALL_BUCKET = 8
#: Members of a bucket that are compared in one place (more in buckets of more blocks than tasks), and rows that such places hold on average.
ROWS_PER_BLOCK = 256
ROWS_PER_GROUP = 8192
#: 64-bit words of sketches that are compared at once.
WORDS_AT_ONCE = 1 << 20
#: Buckets in which each member offers its closest partner, one a round.
CLOSEST_ROUNDS = 4


def shingle_sets(texts: Texts, width: int) -> list[np.ndarray]:
    """Return the sorted distinct shingle hashes of each text."""
    starts, ends, offsets = texts.words()
    words = texts.hashes(starts, ends)
    grams = windows(words, width)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:
            out.append(windows(words[a:b], b - a) if b > a else words[:0])
    return out


def set_id(tokens: np.ndarray) -> int:
    """Return a signed 64-bit hash of a set of tokens."""
    total = np.array([mix(tokens ^ U64(0xA5A5A5A5DEADBEEF)).sum(dtype=U64), len(tokens)], U64)
    return int(mix(total[:1] * U64(0x9E3779B97F4A7C15) + total[1:]).view(np.int64)[0])


def sketch_bits(n: int, num: int, den: int) -> int:
    """Return the bits of the folded sketch of a set of n tokens, a power of two."""
    differ = 2 * n * (den - num) // (den + num)
    return min(MOST_BITS, max(64, 1 << (SKETCH_BITS * differ - 1).bit_length() if differ else 64))


def folded_sketch(tokens: np.ndarray, bits: int) -> bytes:
    """Return the parity sketch folded to a number of bits."""
    odd = np.bincount((tokens & U64(bits - 1)).astype(np.intp), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def unpacked(sketches: list[bytes]) -> np.ndarray:
    """Return sketches as rows of 64-bit words, all folded to the shortest one."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), U64)
    for i, sketch in enumerate(sketches):
        words = np.frombuffer(sketch, U64)
        out[i] = np.bitwise_xor.reduce(words.reshape(-1, least // 8), axis=0) if len(words) > least // 8 else words
    return out


def distances(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Return the bits in which the sketches of each row differ, folded to the shorter one."""
    (da, oa), (db, ob) = _bytes(left), _bytes(right)
    na, nb = np.diff(oa), np.diff(ob)
    out = np.zeros(len(na), np.int64)
    for a, b in {*zip(na.tolist(), nb.tolist())}:
        rows, least = np.flatnonzero((na == a) & (nb == b)), min(a, b)
        step = max(1, 8 * WORDS_AT_ONCE // (a + b))
        for i in range(0, len(rows), step):
            own = rows[i : i + step]
            x, y = (d[o[own][:, None] + np.arange(n)].view(U64) for d, o, n in ((da, oa, a), (db, ob, b)))
            x, y = (np.bitwise_xor.reduce(v.reshape(len(own), -1, least // 8), axis=1) for v in (x, y))
            out[own] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a binary column, and its offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), np.frombuffer(offsets, np.int64, count=len(column) + 1, offset=8 * column.offset)


class Bands:
    """Size bands, each with its number of parts, for a threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.high = [1]
        # The smallest sets of a band have the most empty parts: exp(-tokens per part), and half as many again.
        least = num / den / BAND_RATIO * (den + num) / (2.4 * max(den - num, 1))
        self.empty_share = min(1.0, 0.02 + 1.8 * math.exp(-least))

    def _reach(self, n: int) -> None:
        while self.high[-1] < n:
            self.high.append(max(self.high[-1] + 1, math.floor(self.high[-1] * BAND_RATIO)))

    def parts(self, n: int) -> Iterator[tuple[int, int, int]]:
        """Yield (band, parts, empty parts to leave out) for each band that a set of size n takes part in."""
        most = n * self.den // self.num  # the largest possible partner
        self._reach(max(n, most))
        home = int(np.searchsorted(self.high, n))
        for band in range(home, len(self.high)):
            if band > home and self.high[band - 1] + 1 > most:
                break
            k = self._differences(band)
            if k:
                empty = math.ceil(self.empty_share * k)
                yield band, k + self.common(band) + empty, empty

    def _differences(self, band: int) -> int:
        return 2 * self.high[band] * (self.den - self.num) // (self.den + self.num)

    def common(self, band: int) -> int:
        """Return how many keys of the band a linked pair shares at least."""
        while len(self.high) <= band:
            self._reach(self.high[-1] + 1)
        return 1 + math.ceil(COMMON_SHARE * self._differences(band))


def part_keys(tokens: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Return the join keys of a sorted token set, one per band and part, and their bands."""
    keys, own = [], []
    high = tokens >> U64(32)
    codes = mix(tokens + U64(0x632BE59BD9B4E019))
    for band, parts, slack in bands.parts(len(tokens)):
        part = (high * U64(parts)) >> U64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        content = np.bitwise_xor.reduceat(codes, first)
        at = part[first]
        if parts - len(first) > slack:
            empty = np.setdiff1d(np.arange(parts, dtype=U64), at, assume_unique=True)
            at, content = np.concatenate([at, empty]), np.concatenate([content, np.zeros(len(empty), U64)])
        keys.append(mix(content ^ mix(at + U64(band << 40))))
        own.append(np.full(len(at), band, np.uint8))
    return (np.concatenate(keys), np.concatenate(own)) if keys else (np.empty(0, U64), np.empty(0, np.uint8))


def _bucketed(keys: list[tuple[np.ndarray, np.ndarray]], cids: list[int], buckets: int) -> pa.RecordBatch:
    """Pack keys, bands and set ids into one row per bucket: 5, 1 and 8 bytes each.

    Of a key that more than HOT_IN_FLUSH sets here have, two go to its bucket, so that
    others with it are found; the rest is known to be shared, and goes to one of the
    extra buckets from ``buckets`` on, as whole rows.
    """
    k = np.concatenate([x[0] for x in keys])
    g = np.concatenate([x[1] for x in keys])
    c = np.repeat(np.array(cids, np.int64), [len(x[0]) for x in keys])
    order = np.argsort(k, kind="stable")
    k, g, c = k[order], g[order], c[order]
    fresh = np.concatenate([[True], k[1:] != k[:-1]])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(k)))
    rank = np.arange(len(k)) - np.repeat(first, size)
    known = (np.repeat(size, size) > HOT_IN_FLUSH) & (rank >= 2)
    b = ((k >> U64(32)) * U64(buckets)) >> U64(32)
    rows = {"bucket": [], "keys": [], "cids": []}
    if known.any():
        extra = np.zeros(int(known.sum()), _KNOWN)
        extra["key"], extra["band"], extra["cid"] = _key_id(k[known], b[known]), g[known], c[known]
        rows["bucket"].append(buckets + int(extra["cid"][0] % buckets))
        rows["keys"].append(extra.tobytes())
        rows["cids"].append(b"")
    k, g, c, b = k[~known], g[~known], c[~known], b[~known]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))  # keys are in order, and so are buckets
    low = np.concatenate([k.view(np.uint8).reshape(-1, 8)[:, :5], g[:, None]], axis=1)
    for i, j in zip(cut.tolist(), np.append(cut[1:], len(b)).tolist()):
        rows["bucket"].append(int(b[i]))
        rows["keys"].append(low[i:j].tobytes())
        rows["cids"].append(c[i:j].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int64()), pa.array(rows["keys"], pa.binary()), pa.array(rows["cids"], pa.binary())], names=list(rows))


_KNOWN = np.dtype([("key", "<i8"), ("band", "<i4"), ("cid", "<i8")])


def _key_id(key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The name of a key: its low 40 bits, and its bucket."""
    return (key & U64((1 << 40) - 1)).astype(np.int64) + (bucket.astype(np.int64) << 40)


def _shared_keys(buckets: int):
    """Of one bucket, return (key, band, cid) for each key that two sets or more have."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= buckets:
            rows = np.frombuffer(b"".join(table.column("keys").to_pylist()), _KNOWN)
            return pa.table({name: np.ascontiguousarray(rows[name]) for name in ("key", "band", "cid")})
        raw = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint8).reshape(-1, 6)
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :5] = raw[:, :5]
        key, band = key.view(U64).ravel(), raw[:, 5]
        cid = np.frombuffer(b"".join(table.column("cids").to_pylist()), np.int64)
        order = np.argsort(key)
        sorted_keys = key[order]
        same = sorted_keys[1:] == sorted_keys[:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        key, band, cid = key[order], band[order], cid[order]
        order = np.lexsort((cid, key))
        key, band, cid = key[order], band[order], cid[order]
        if len(key):
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])])
            key, band, cid = key[fresh], band[fresh], cid[fresh]
        same = key[1:] == key[:-1]
        many = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(key) else np.empty(0, bool)
        return pa.table({"key": _key_id(key[many], np.full(int(many.sum()), bucket)), "band": band[many].astype(np.int32), "cid": cid[many]})

    return run


def _split_pairs(num: int, den: int, closest: bool):
    """Pairs of different components within the blocks of a group, which the folded sketches allow.

    A block (key, i, j) holds some members of a bucket, and some of its minor ones, which
    are those outside its largest component; each minor one meets every member.  With
    ``closest`` a minor member offers only the closest other one of the block.
    """

    def meet(major: dict[str, np.ndarray], minor: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        """Yield rows (minor, member, bits in which they differ)."""
        step = max(1, WORDS_AT_ONCE // max(1, len(major["n"]) * major["sketch"].shape[1]))
        for i in range(0, len(minor["n"]), step):
            x = {k: v[i : i + step] for k, v in minor.items()}
            far = np.bitwise_count(x["sketch"][:, None, :] ^ major["sketch"][None, :, :]).sum(axis=2, dtype=np.int64)
            nx, ny = x["n"][:, None], major["n"][None, :]
            ok = (far * (den + num) <= (den - num) * (nx + ny)) & (den * np.minimum(nx, ny) >= num * np.maximum(nx, ny)) & (x["label"][:, None] != major["label"][None, :])
            if closest:
                far[~ok] = 1 << 40
                best = far.argmin(axis=1)
                least = far[np.arange(len(best)), best]
                rows = np.flatnonzero(least < 1 << 40)
                yield np.stack([x["cid"][rows], major["cid"][best[rows]], least[rows]], 1)
            else:
                a, b = np.nonzero(ok)
                yield np.stack([x["cid"][a], major["cid"][b], far[a, b]], 1)

    def run(table: pa.Table) -> pa.Table:
        names = ("key", "i", "j", "minor", "cid", "label", "n")
        col = {name: table.column(name).to_numpy() for name in names}
        sketches = table.column("sketch").to_pylist()
        order = np.lexsort((col["cid"], col["minor"], col["j"], col["i"], col["key"]))
        col = {k: v[order] for k, v in col.items()}
        cut = (col["key"][1:] != col["key"][:-1]) | (col["i"][1:] != col["i"][:-1]) | (col["j"][1:] != col["j"][:-1])
        first = np.flatnonzero(np.concatenate([[True], cut]))
        found, offers = [np.empty((0, 2), np.int64)], []
        for i, j in zip(first.tolist(), np.append(first[1:], len(order)).tolist()):
            block = {k: col[k][i:j] for k in ("cid", "label", "n", "minor")}
            block["sketch"] = unpacked([sketches[r] for r in order[i:j].tolist()])
            own = block.pop("minor")
            # A row that is a minor one of this block, and a member of it, is there as both.
            minor, major = ({k: v[pick] for k, v in block.items()} for pick in (own > 0, own < 2))
            if len(minor["n"]) and len(major["n"]):
                got = np.concatenate(list(meet(major, minor)))
                if closest:
                    offers.append(got)
                else:
                    found.append(np.unique(np.sort(got[:, :2], axis=1), axis=0))
        if offers:  # the closest of all blocks of the group that a member asks in
            got = np.concatenate(offers)
            got = got[np.lexsort((got[:, 1], got[:, 2], got[:, 0]))]
            found.append(np.sort(got[np.concatenate([[True], got[1:, 0] != got[:-1, 0]])][:, :2], axis=1) if len(got) else got[:, :2])
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


class TextFilter:
    """A filter of text hashes of a bounded size, sent to executors; it may hold too many, but misses none."""

    def __init__(self, hashes: DataFrame, count: int):
        self.words = min(MOST_FILTER, max(LEAST_FILTER, 1 << (max(count, 1) // 4).bit_length()))
        spots = hashes.select(F.explode(F.array(*(F.struct(self._word(F.col("h"), i).alias("w"), self._bit(F.col("h"), i).alias("b")) for i in range(2)))).alias("x"))
        rows = spots.select("x.w", F.expr("shiftleft(1L, x.b)").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
        bits = np.zeros(self.words, np.int64)
        got = rows.toArrow()  # at most ``words`` rows
        bits[got.column("w").to_numpy()] = got.column("v").to_numpy()
        self.bits = hashes.sparkSession.sparkContext.broadcast(bits)

    def _word(self, h: Column, i: int) -> Column:
        return F.shiftrightunsigned(h, 13 + 21 * i).bitwiseAND(self.words - 1)

    @staticmethod
    def _bit(h: Column, i: int) -> Column:
        return F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")

    def maybe(self, h: Column) -> Column:
        """Whether the filter may hold a hash; only the hashes go to Python."""
        test = self.test()

        @F.arrow_udf("boolean")
        def held(column: pa.Array) -> pa.Array:
            return pa.array(test(column))

        return held(h)

    def test(self) -> Callable[[pa.Array], np.ndarray]:
        """The same, for a function that runs on executors anyway."""
        bits, last = self.bits, self.words - 1

        def held(column: pa.Array) -> np.ndarray:
            u = column.to_numpy(zero_copy_only=False).view(U64)
            spots = [(bits.value[((u >> U64(13 + 21 * i)) & U64(last)).astype(np.intp)].view(U64) >> ((u >> U64(6 * i)) & U64(63))) & U64(1) for i in range(2)]
            return (spots[0] & spots[1]).astype(bool)

        return held


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class ParitySketchJoin:
    """The join over one table of texts, from its sets to components."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int):
        if width < 1 or not 0 < num <= den:
            raise ValueError("width must be positive and 0 < num <= den")
        small_batches(docs.sparkSession)
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.width, self.num, self.den = width, num, den
        self.sets = self._describe()

    def _describe(self) -> DataFrame:
        """(doc_id, h, cid, n): hash of the text, id and size of its set, a row for each input row."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, texts in slices(batch.column("text"), fold_case=True):
                    sets = shingle_sets(texts, width)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(i, j - i), batch.column("h").slice(i, j - i), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())],
                        names=["doc_id", "h", "cid", "n"],
                    )
            give_back()

        return keep(self.docs.withColumn("h", _text_hash(F.col("text"))).mapInArrow(run, "doc_id long, h long, cid long, n long"))

    def _shared(self) -> DataFrame:
        """(key, cid, band, need, center, m): members of all buckets with two sets or more that share enough keys.

        ``need`` is how many keys of the band a linked pair shares, ``m`` how many members the bucket has.
        """
        width, num, den = self.width, self.num, self.den
        total = self.sets.agg(F.sum("n")).first()[0] or 0
        buckets = max(64, math.ceil(3 * (den - num) / (den + num) * total / KEYS_PER_BUCKET))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bands, keys, cids, seen, held = Bands(num, den), [], [], set(), 0
            for batch in batches:
                for _, _, texts in slices(batch.column("text"), fold_case=True):
                    for tokens in shingle_sets(texts, width):
                        if not len(tokens) or (cid := set_id(tokens)) in seen:
                            continue
                        seen.add(cid)
                        new = part_keys(tokens, bands)
                        if len(new[0]):
                            keys.append(new)
                            cids.append(cid)
                            held += len(new[0])
                        if held >= KEYS_PER_FLUSH:
                            yield _bucketed(keys, cids, buckets)
                            keys, cids, seen, held = [], [], set(), 0
            if keys:
                yield _bucketed(keys, cids, buckets)
            keys, cids = [], []
            give_back()

        packed = self.docs.select("text").mapInArrow(emit, "bucket long, keys binary, cids binary")
        found = keep(packed.groupBy("bucket").applyInArrow(_shared_keys(buckets), "key long, band int, cid long"))
        top = found.agg(F.max("band")).first()[0] or 0
        bands = Bands(num, den)
        need = F.element_at(F.array(*(F.lit(bands.common(i)) for i in range(top + 1))), F.col("band") + 1)
        strong = found.groupBy("cid", "band").agg(F.count("*").alias("own")).where(F.col("own") >= need).select("cid", "band")
        # A copy of a known key's row may have come from several flushes.
        left = keep(found.join(strong, ["cid", "band"]).select("key", "cid", "band", need.cast("int").alias("need")).distinct())
        discard(found)
        # Written before the join, so that a key with many members can be split.
        keys = materialize(left.groupBy("key").agg(F.min("cid").alias("center"), F.count("*").alias("m")).where("m > 1"), "keys")
        shared = keep(left.join(keys, "key").select("key", "cid", "band", "need", "center", "m"))
        discard(left)
        return shared

    @staticmethod
    def _prefix(shared: DataFrame) -> DataFrame:
        """(key, cid, band, m) without ``need - 1`` keys of each set and band: of all in one order, the first common key stays.

        The order is by the members of the bucket, so the largest ones go.
        """
        own = Window.partitionBy("cid", "band")
        ranked = shared.withColumn("place", F.row_number().over(own.orderBy("m", "key"))).withColumn("own", F.count("*").over(own))
        return ranked.where(F.col("place") <= F.col("own") - F.col("need") + 1).select("key", "cid", "band", "m")

    @staticmethod
    def _joined_buckets(shared: DataFrame) -> DataFrame:
        """(key, cid): buckets of a band with the same hub, their most shared member, as one, where that makes fewer pairs.

        Sets that share a bucket still do, so no pair is lost; the near copies of a text
        meet in a few buckets, instead of once for each key that most of them have.
        """
        own = shared.groupBy("cid").agg(F.count("*").alias("own"))
        hub = F.max_by("cid", F.struct("own", "cid")).alias("hub")
        # Written before the joins, so that a key with many members can be split.
        keys = materialize(shared.join(own, "cid").groupBy("key", "band").agg(hub, F.count("*").cast("double").alias("c")), "keys")
        together = shared.select("key", "cid").join(keys, "key").select("hub", "band", "cid").distinct().groupBy("hub", "band").agg(F.count("*").cast("double").alias("c"))
        apart = keys.groupBy("hub", "band").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
        fewer = apart.join(together, ["hub", "band"]).where("c * c <= pairs").select("hub", "band", F.xxhash64("hub", "band").alias("name"))
        names = materialize(keys.join(fewer, ["hub", "band"], "left").select("key", F.coalesce("name", "key").alias("name")), "names")
        joined = materialize(shared.select("key", "cid").join(names, "key").select(F.col("name").alias("key"), "cid").distinct(), "shared")
        discard(keys, names)
        return joined

    def _members(self, shared: DataFrame) -> DataFrame:
        """(cid, n, tokens, sketch) of the sets in ``shared``."""
        width, num, den = self.width, self.num, self.den
        cids = shared.select("cid").distinct()
        # One text stands for each set.
        texts = keep(self.sets.where("n > 0").groupBy("cid").agg(F.min("h").alias("h")).join(cids, "cid", "left_semi"))
        wanted = TextFilter(texts.select("h"), texts.count()).test()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                # Tested here, as a filter before would take another worker for each task.
                for _, _, part in slices(batch.column("text").filter(pa.array(wanted(batch.column("h")))), fold_case=True):
                    got = {}
                    for tokens in shingle_sets(part, width):
                        if len(tokens) and (cid := set_id(tokens)) not in seen:
                            seen.add(cid)
                            got[cid] = tokens
                    if got:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(list(got), pa.int64()), pa.array([len(t) for t in got.values()], pa.int64()), pa.array([t.view(np.int64) for t in got.values()], pa.list_(pa.int64())), pa.array([folded_sketch(t, sketch_bits(len(t), num, den)) for t in got.values()], pa.binary())],
                            names=["cid", "n", "tokens", "sketch"],
                        )
            give_back()

        rows = self.docs.select("text", _text_hash(F.col("text")).alias("h"))
        rows = rows.mapInArrow(run, "cid long, n long, tokens array<long>, sketch binary")
        rows = rows.join(cids, "cid", "left_semi").groupBy("cid").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "sketch")))
        members = materialize(rows, "members")
        discard(texts)
        return members

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """Return those pairs (a, b) whose sets pass the exact test; sizes and sketches are looked at first."""
        near = pairs
        for own, other in (("a", "a"), ("b", "b")):
            near = near.join(self.members.select(F.col("cid").alias(own), F.col("n").alias("n" + other), F.col("sketch").alias("s" + other)), own)
        num, den = self.num, self.den

        @F.arrow_udf("boolean")
        def allowed(na: pa.Array, nb: pa.Array, sa: pa.Array, sb: pa.Array) -> pa.Array:
            return pa.array(distances(sa, sb) * (den + num) <= (den - num) * (na.to_numpy() + nb.to_numpy()))

        size = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
        near = keep(near.where(size).where(allowed("na", "nb", "sa", "sb")).select("a", "b", "na", "nb"))
        tokens = lambda own, name: self.members.select(F.col("cid").alias(own), F.col("tokens").alias(name))
        both = near.join(tokens("a", "ta"), "a").join(tokens("b", "tb"), "b")
        common = F.size(F.array_intersect("ta", "tb"))
        links = keep(both.where(den * common >= num * (F.col("na") + F.col("nb") - common)).select("a", "b"))
        discard(near)
        return links

    def labels(self) -> DataFrame:
        """Return (cid, label) of every set that links with another; labels are set ids of one component each."""
        shared = self._shared()
        self.members = self._members(shared)
        often = shared.where("cid != center").groupBy("cid", "center").agg(F.count("*").alias("c"))
        first = often.groupBy("cid").agg(F.max_by("center", F.struct("c", -F.col("center"))).alias("a"))
        full, shared = shared, materialize(self._prefix(shared), "shared")
        tested = materialize(first.select(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b")).distinct(), "tested")
        discard(full)
        links = self._verify(tested)
        labels = materialize(connected_components(links).withColumnRenamed("node", "cid"), "labels")
        discard(links)
        few = materialize(self._small_pairs(shared.where(F.col("m") <= SMALL_BUCKET), labels).join(tested, ["a", "b"], "left_anti"), "pairs")
        labels = self._merge(labels, self._verify(few))
        tested = tested.union(few)
        large = self._joined_buckets(shared.where(F.col("m") > SMALL_BUCKET))
        discard(shared)
        for turn in [*range(CLOSEST_ROUNDS), None]:
            open_pairs = self._open_pairs(large, labels, turn)
            if not open_pairs._folioflow_rows:
                continue
            new = materialize(open_pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            discard(open_pairs)
            if not new.isEmpty():
                labels = self._merge(labels, self._verify(new))
                tested = tested.union(new)
        discard(large, self.members)
        return labels

    @staticmethod
    def _small_pairs(shared: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components in buckets of a bounded size."""
        own = keep(shared.select("key", "cid").join(labels, "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label")))
        left = own.select("key", F.col("cid").alias("a"), F.col("label").alias("la"))
        right = own.select("key", F.col("cid").alias("b"), F.col("label").alias("lb"))
        return left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))).select("a", "b").distinct()

    def _open_pairs(self, shared: DataFrame, labels: DataFrame, turn: int | None) -> DataFrame:
        """Pairs (a, b) of different components that share a key: all of them, or in a turn the closest of each set in one bucket."""
        own = keep(shared.select("key", "cid").join(labels, "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label")))
        counts = own.groupBy("key", "label").agg(F.count("*").alias("c"))
        stats = counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("top"))
        stats = materialize(stats.where("top < m"), "stats")  # written before the join, so that a key with many members can be split
        x = own.join(stats, "key").withColumn("outside", F.col("label") != F.col("main"))
        size = own.sparkSession.conf.get("spark.sql.shuffle.partitions")
        total = stats.agg(F.sum(F.col("m"))).first()[0] or 0
        groups = max(int(size), math.ceil(total / ROWS_PER_GROUP))
        side = math.ceil(math.sqrt(groups))  # so many blocks a side give every group one; more would only repeat rows
        blocks = lambda n: F.least(F.ceil(n / ROWS_PER_BLOCK), F.lit(side)).cast("int")
        majors, minors = blocks(F.col("m")), blocks(F.col("m") - F.col("top"))
        at = lambda salt, n: F.pmod(F.xxhash64("cid", F.lit(salt)), n).cast("int")
        span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        base = left = keep(x.select("key", "cid", "label", "outside", "m", majors.alias("ni"), minors.alias("nj")))
        asks = base.where("outside")
        if turn is not None:
            # Each member outside asks in one bucket, turn by turn a larger one.
            by_size = Window.partitionBy("cid").orderBy("m", "key")
            asks = keep(asks.withColumn("place", F.row_number().over(by_size) - 1).where(F.col("place") == turn).drop("place"))
            base = base.join(asks.select("key").distinct(), "key", "left_semi")
        as_member = base.select("key", "cid", "label", at(1, F.col("ni")).alias("i"), span(F.col("nj")).alias("j"), F.lit(0).alias("minor"))
        as_minor = asks.select("key", "cid", "label", span(F.col("ni")).alias("i"), at(2, F.col("nj")).alias("j"), F.lit(2).alias("minor"))
        rows = as_member.unionByName(as_minor)
        rows = rows.join(self.members.select("cid", "n", "sketch"), "cid").withColumn("group", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))
        pairs = rows.groupBy("group").applyInArrow(_split_pairs(self.num, self.den, turn is not None), "a long, b long").distinct()
        found = keep(pairs)
        discard(own, left, stats, asks)
        return found

    @staticmethod
    def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Bring labels up to date with new links (of keep()): components of the labels that they join."""
        if not links._folioflow_rows:
            return labels
        known = lambda name: labels.select(F.col("cid").alias(name), F.col("label").alias("label_" + name))
        edges = links.join(known("a"), "a", "left").join(known("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
        joined = keep(connected_components(edges).withColumnRenamed("label", "new"))
        moved = labels.join(joined, labels["label"] == joined["node"], "left").select("cid", F.coalesce("new", "label").alias("label"))
        fresh = joined.select(F.col("node").alias("cid"), F.col("new").alias("label")).join(labels.select("cid"), "cid", "left_anti")
        merged = materialize(moved.union(fresh).distinct(), "labels")
        discard(joined, links, labels)
        return merged

    def _labelled(self) -> DataFrame:
        """(doc_id, h, cid, n, label): the label is null for empty sets."""
        joined = self.sets.join(self.labels(), "cid", "left")
        return materialize(joined.select("doc_id", "h", "cid", "n", F.when(F.col("n") > 0, F.coalesce("label", "cid")).alias("label")), "labelled")

    def components(self) -> DataFrame:
        """Return (doc_id, n_shingles, component_id, cid), a row for each input row."""
        known = self._labelled()
        # Written before the join, so that a large component can be split.
        low = materialize(known.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("low")), "low")
        return known.join(low, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"), "cid")

    def one_per_component(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """Return ``docs`` (those of this join) with one row for each component: that of the smallest id.

        Rows with an empty set are all kept, null ids come last, and of rows with equal
        id and text any one stays.  A filter of text hashes tells most rows that stand
        alone, and another one of ids and text hashes those that go, without a shuffle;
        the others are joined exactly.
        """
        known = self._labelled().where("n > 0")
        groups = materialize(known.groupBy("label").agg(F.count("*").alias("c")).where("c > 1").select("label"), "groups")
        inside = known.join(groups, "label", "left_semi")
        best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("best")
        first = inside.groupBy("label").agg(best).select("best.h", "best.doc_id", F.lit(True).alias("once"))
        texts = keep(inside.select("h").distinct())
        grouped = TextFilter(texts, texts.count())
        # Rows that stand alone, but that the filter does not tell from grouped ones.
        alone = self.sets.where(grouped.maybe(F.col("h"))).join(texts, "h", "left_anti").select("h", "doc_id", F.lit(False).alias("once")).distinct()
        key = lambda h, i: F.xxhash64(h, i)
        staying = materialize(first.union(alone).withColumn("k", key("h", "doc_id")), "staying")
        stays = TextFilter(staying.select(F.col("k").alias("h")), staying.count())
        names = docs.columns
        mark = "_set"
        while any(c.lower().startswith(mark) for c in names):
            mark = "_" + mark
        h, k, one = mark + "_h", mark + "_k", mark + "_one"
        rows = docs.withColumn(h, _text_hash(F.col(text_col).cast("string"))).withColumn(k, key(h, F.col(id_col).cast("long")))
        maybe = grouped.maybe(F.col(h))
        sure = rows.where(~maybe).select(*names)
        own = staying.select(F.col("k").alias(mark + "_own"), F.col("h").alias(mark + "_text"), F.col("doc_id").alias(mark + "_id"), F.col("once").alias(one))
        same = (F.col(k) == F.col(mark + "_own")) & (F.col(h) == F.col(mark + "_text")) & F.col(id_col).cast("long").eqNullSafe(F.col(mark + "_id"))
        rest = rows.where(maybe & stays.maybe(F.col(k))).join(own, same)
        # Rows that stand alone are each a partition of their own.
        order = Window.partitionBy(k, F.when(~F.col(one), F.monotonically_increasing_id())).orderBy(F.lit(0))
        rest = rest.withColumn(mark + "_rank", F.row_number().over(order)).where(F.col(mark + "_rank") == 1)
        return sure.union(rest.select(*names))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Group texts that n-gram Jaccard links join; see the module's description."""
    return ParitySketchJoin(docs, id_col, text_col, width, num, den).components()

"""Operators against plain versions of their methods, and their results at any partitioning."""

import collections
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import chat_repair as C
from folioflow.llm import collision_ann, mixing, pair_rank, quality_rules
from folioflow.llm.textvec import slices

DATA = "/root/testdata/sf0.01"


def test_repair_does_not_depend_on_cuts():
    r = random.Random(3)

    def ways(roles):
        own, cost = C.turn_ways(roles[0]), 0
        for role in roles[1:]:
            own, more = C.extend(own, role)
            cost += more
        return tuple(min(c + cost, C._NEVER) for c in own[0]), own[1]

    for _ in range(400):
        roles = [r.randrange(4) for _ in range(r.randint(1, 14))]
        whole = C.chained([C.turn_ways(x) for x in roles])
        assert [0, *C.trace(roles, 0, whole[-1])] == whole
        for _ in range(3):
            cuts = sorted({0, len(roles), *(r.randrange(len(roles) + 1) for _ in range(r.randint(0, 4)))})
            parts = [roles[a:b] for a, b in zip(cuts, cuts[1:])]
            ends = C.chained([ways(p) for p in parts])
            assert [0, *(s for p, a, b in zip(parts, ends, ends[1:]) for s in C.trace(p, a, b))] == whole


def test_repair_at_any_partitioning(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["system", "user", "assistant", None, "tool"]), r.choice(["a", "b", None])) for c in range(40) for t in range(r.randint(1, 30)) for _ in range(r.choice([1, 1, 2]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n, stretch in ((1, 4096), (3, 5), (7, 4096)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, C.repair(df, stretch=stretch).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(rows)


def test_mix_comes_from_the_shards(spark):
    r = random.Random(9)
    rows = [(i, " ".join("w" * r.choice([1, 30, 200])), r.choice("abc"), 7) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size int")
    mix = mixing.Mix(df, shards=4)
    got = {x.doc_id: x for x in mix.taken().collect()}
    out = mix.rows(df)
    assert out.columns == ["doc_id", "text", "source", "mix_size", "_mix_shard", "_mix_pass", "_mix_slot"]
    by_shard, whole = collections.defaultdict(collections.Counter), collections.Counter()
    for x in out.withColumn("n", mixing.word_count(F.col("text"))).collect():
        assert x.mix_size == 7
        by_shard[x.doc_id][x._mix_shard] += x.n
        whole[x._mix_shard] += x.n
    for i, x in got.items():
        listed = collections.Counter()
        for part in filter(None, x.shards.split(",")):
            shard, words = map(int, part.split(":"))
            listed[shard] += words
        assert listed == by_shard[i] and x.taken == sum(listed.values())
    assert len(whole) == 4 and max(whole.values()) < 1.6 * min(whole.values())
    # Without a shard's run its blocks are not in the mix.
    mix.draws = mix.draws.where("shard <> 2")
    less = {x.doc_id: x.taken for x in mix.taken().collect()}
    assert all(less[i] == x.taken - by_shard[i][2] for i, x in got.items())
    with pytest.raises(ValueError):
        mixing.split_quotas(spark.createDataFrame([(0, 3)], "idx int, quota long"), 3, 1)


def plain_certificates(rows, share=0.02, error=0.05):
    """Steps of each stratum, by lists of documents instead of histograms: (band, holdout, good, bins by rule)."""
    held = collections.Counter(b for b, h, g, _ in rows if h and g)
    out = {}
    for bands in quality_rules.strata(held, share, error):
        own = [x for x in rows if x[0] in bands]
        good, bad = [x[3] for x in own if not x[1] and x[2]], [x[3] for x in own if not x[1] and not x[2]]
        test, steps = [x[3] for x in own if x[1] and x[2]], []
        m = len(quality_rules.strata(held, share, error))
        hit = lambda x: any(x[r] >= cut for r, cut in steps)  # noqa: B023, E731
        for _ in range(quality_rules.MOST_STEPS if good and bad else 0):
            left_good, left_bad = [x for x in good if not hit(x)], [x for x in bad if not hit(x)]
            best = None
            for s in quality_rules.STRICTNESS:
                for r in quality_rules.RULES:
                    cut = next(c for c in range(quality_rules.BINS + 2) if sum(x[r] >= c for x in left_good) <= s * len(good))
                    b, g = sum(x[r] >= cut for x in left_bad), sum(x[r] >= cut for x in left_good)
                    if b / len(bad) >= quality_rules.LEAST_GAIN * (g + 1) / (len(good) + 1) and (best is None or b > best[0]):
                        best = b, r, cut
                if best:
                    break
            if not best:
                break
            steps.append(best[1:])
            if quality_rules.upper_bound(sum(map(hit, test)), len(test), error / m) > share:
                steps.pop()
                break
        out[bands] = steps
    return out


def test_cutoffs_equal_plain_version(spark):
    r = random.Random(6)

    def text(good):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([30, 150, 600]))]
        bad = r.random()
        if not good and bad < 0.5 or good and bad < 0.004:
            words = [w + "#" if r.random() < 0.4 else w for w in words]
        elif not good and bad < 0.8:
            words = [w.upper() for w in words]
        return " ".join(words)

    rows = [(i, text(i % 5 > 0), int(i % 5 > 0)) for i in range(2500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(3, rows[3][1]), (None, None), (9000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (4, None)], "doc_id long, quality int")
    features = quality_rules.with_features(docs, "text", "").drop("text")
    quality = {i: q for i, _, q in rows}
    known, by_row = [], []
    for x in features.select("doc_id", quality_rules.base_failed().alias("base"), quality_rules._stratum("").alias("band"), *(c.alias(k) for k, c in quality_rules._bins("").items())).collect():
        bins = {k: x[k] for k in quality_rules.RULES}
        by_row.append((x.doc_id, x.base, x.band, bins))
        if not x.base and x.doc_id in quality:
            known.append((x.band, zlib.crc32(f"part{x.doc_id}".encode()) % 3 > 0, quality[x.doc_id] == 1, bins))
    want = plain_certificates(known)
    got = {c.bands: list(c.steps) for c in quality_rules.certify(features, labels)}
    assert got == want and sum(map(len, got.values())) >= 2
    cut = {band: steps for bands, steps in want.items() for band in bands}
    kept = sorted((str(i), not base and not any(bins[k] >= c for k, c in cut[band])) for i, base, band, bins in by_row)
    assert kept == sorted((str(x.doc_id), x.kept) for x in quality_rules.judge(docs, labels).collect())
    rejected = [q for i, base, band, bins in by_row if not base and (q := quality.get(i)) is not None and any(bins[k] >= c for k, c in cut[band])]
    assert rejected.count(0) > 250 and rejected.count(1) <= 40


def test_false_rejection_is_bounded():
    """Documents of one stratum whose rules reach many good ones: how often a certified rate is too high."""
    rng = np.random.default_rng(2)
    n, wrong, some = 900, 0, 0
    # A step k rejects a share of (k + 1) * 0.4 % of good documents, each step more than the one before.
    rates = (np.arange(12) + 1) * 0.004
    for _ in range(2000):
        first = np.searchsorted(rates, rng.random(n))
        holds = -1
        for k in range(12):
            if quality_rules.upper_bound(int((first <= k).sum()), n, 0.05) > 0.02:
                break
            holds = k
        some += holds >= 0
        wrong += holds >= 0 and rates[holds] > 0.02
    assert some > 1500 and wrong <= 0.06 * 2000


def test_strata_are_joined_until_they_can_certify():
    groups = quality_rules.strata({0: 1000, 1: 900, 2: 180, 3: 40}, 0.02, 0.05)
    assert [k for g in groups for k in g] == [0, 1, 2, 3]
    sizes = {0: 1000, 1: 900, 2: 180, 3: 40}
    assert all(quality_rules.upper_bound(0, sum(sizes[k] for k in g), 0.05 / len(groups)) <= 0.01 for g in groups) and len(groups) > 1
    assert quality_rules.strata({}, 0.02, 0.05) == [(0, 1, 2, 3)]


def test_neighbours_are_pruned():
    rng = np.random.default_rng(7)
    v = rng.standard_normal((4000, 64))
    v[:300] = v[0] + 0.2 * rng.standard_normal((300, 64))  # a cluster
    ids = np.arange(len(v))
    asked = np.array([5, *range(400, 1400, 50)])
    got = collision_ann.Block(ids, ids * 0, v).search(asked, asked * 0, v[asked], 5)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in asked:
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & set(got[2][got[0] == q]))
    verified = got[5][::5] / len(v)
    assert hits >= 0.95 * 5 * len(asked)
    assert verified.max() < 0.3 and verified.mean() < 0.2


def test_window_counts():
    rng = np.random.default_rng(8)
    v = rng.standard_normal((200, 8))
    ids = np.arange(200)
    block = collision_ann.Block(ids, ids * 0, v)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    at = (unit[:10] @ block.lines).T
    low, high = block._windows(at, np.full(10, 0.5))
    counts = np.zeros((10, 200), np.uint8)
    block._count_all(counts, low, high)
    half = collision_ann.WIDTH * 0.5 / 2
    want = (np.abs((unit @ block.lines).T[:, None, :] - at[:, :, None]) <= half).sum(axis=0)
    assert np.abs(counts.astype(int) - want).max() <= 1  # a bound may round either way


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_recall_of_the_query(spark):
    from folioflow.llm import queries

    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    v = np.array([r.embedding for r in rows], np.float64)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    got = collections.defaultdict(list)
    for r in queries.op9_collision_ann(spark, DATA).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        s[i] = -2
        hits += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(got[ids[i]]))
    assert hits >= 0.9 * 5 * len(got)


def plain_rank(x, good):
    """Bradley-Terry weights by the same pairs, as plain loops over features."""
    cuts = [sorted(set(np.quantile(x[:, k], np.linspace(0, 1, pair_rank.BINS + 1)[1:-1]).tolist())) for k in range(x.shape[1])]
    hot = lambda row: [(k, sum(c <= row[k] for c in cuts[k])) for k in range(len(cuts))]
    rows = [hot(r) for r in x]
    rng = np.random.default_rng(pair_rank.SEED)
    a, b = rng.choice(np.flatnonzero(good), pair_rank.PAIRS), rng.choice(np.flatnonzero(~good), pair_rank.PAIRS)
    return rows, a, b


def test_ranking_equals_plain_version():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 3))
    good = x[:, 0] + 0.5 * rng.standard_normal(400) > -0.5
    r = pair_rank.Ranker(x, good)
    rows, a, b = plain_rank(x, good)
    w = collections.Counter()
    for k in range(3):
        for i in range(int(r.first[k + 1] - r.first[k])):
            w[k, i] = r.weights[r.first[k] + i]
    score = np.array([sum(w[f] for f in row) for row in rows])
    # The weights are a minimum of the pairs' logistic loss: its slope vanishes.
    pull = 1 / (1 + np.exp(score[a] - score[b])) / len(a)
    slope = collections.Counter()
    for p, i, j in zip(pull, a, b):
        for f in rows[i]:
            slope[f] -= p
        for f in rows[j]:
            slope[f] += p
    assert max(abs(slope[f] + 1e-4 * w[f]) for f in w) < 2e-3
    threshold = np.quantile(score, 1 - good.mean())
    want = 1 / (1 + np.exp(-(r.slope * (score - threshold) + np.log(0.7 / 0.3))))
    assert np.allclose(r.score(x), want) and ((want >= 0.7) == (score >= threshold)).all()
    assert ((r.score(x) >= 0.7) == good).mean() > 0.85


def test_features_of_odd_texts():
    import pyarrow as pa

    texts = ["", None, "a" * 300_000, "x y\nx y\n" * 50_000, "\n\n", "ü " * 10]
    got = np.concatenate([pair_rank.features(t) for _, _, t in slices(pa.array(texts))])
    assert got.shape[0] == len(texts) and np.isfinite(got).all()
    assert (got[0] == got[1]).all() and got[3][4] == 1.0

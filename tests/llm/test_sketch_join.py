"""The parity-sketch join against all pairs."""

import random
import re

import pytest

from folioflow.llm import components, sketch_join
from folioflow.llm.components import connected_components
from folioflow.llm.shared import materialize
from folioflow.llm.sketch_join import Bands, ParitySketchJoin, jaccard_components

SCHEMA = "doc_id long, text string, n string, cid string"


def shingles(text, width):
    table = {c: c + 32 for c in range(65, 91)}
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if common and den * common >= num * union:
                low[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    least = {r: min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for r, g in groups.items()}
    return sorted((str(rows[i][0]), len(sets[i]), str(least[root(i)] if sets[i] else rows[i][0])) for i in range(len(rows)))


def corpus(seed):
    """Groups of near copies on both sides of the threshold, chains, copies, a shared passage, odd texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = [r.choice(words) for _ in range(60)]
    texts = []
    for size in (5, 9, 14, 30, 60, 120, 300, 700):
        for _ in range(3):
            base = [r.choice(words) for _ in range(size)]
            texts.append(base)
            chain = base
            for k in range(6):
                copy = list(chain if k % 2 else base)
                for _ in range(r.randint(0, max(1, size // 45))):
                    at = r.randrange(len(copy))
                    copy[at : at + r.randint(0, 2)] = [r.choice(words) for _ in range(r.randint(0, 2))]
                texts.append(copy)
                chain = copy
    for _ in range(25):
        texts.append([r.choice(words) for _ in range(r.randint(20, 200))] + passage + [r.choice(words) for _ in range(r.randint(20, 200))])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(9000 + i, rows[3][1].upper()) for i in range(4)]
    rows += [(9100, None), (9101, ""), (9102, " \n\t"), (9103, "a"), (9104, "A"), (9105, "a b c"), (9106, "a b c d"), (9106, "a b c d"), (None, "only here x y z"), (None, rows[10][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, width, num, den", [(1, 4, 85, 100), (2, 5, 80, 100)])
def test_equals_all_pairs(spark, seed, width, num, den):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    got = jaccard_components(df, width=width, num=num, den=den).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, width, num, den)


def test_one_per_component(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    kept = ParitySketchJoin(df, "doc_id", "text", 4, 85, 100).one_per_component(df)
    assert kept.columns == df.columns
    want = brute(rows, 4, 85, 100)
    empty = sum(n == 0 for _, n, _ in want)
    labels = {c for _, n, c in want if n}
    assert kept.count() == empty + len(labels)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard_components(df).count() == 0


def test_bands_hold_every_allowed_pair():
    for num, den in ((85, 100), (80, 100), (1, 1)):
        bands = Bands(num, den)
        own = {n: {b: p for b, p, _ in bands.parts(n)} for n in range(1, 400)}
        for b in range(1, 400):
            for a in range(-(-b * num // den), b + 1):
                k = (den - num) * (a + b) // (den + num)
                if k:
                    common = own[a].keys() & own[b].keys()
                    assert any(own[a][x] >= k + bands.common(x) for x in common), (a, b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 170)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    labels = {r.node: r.label for r in got.collect()}
    assert {labels[i] for i in range(41)} == {0} and labels[101] == 100 and labels[200] == 150 and labels[170] == 150
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bound", [0, 1 << 18])
def test_components_write_few_tables(spark, monkeypatch, bound):
    r = random.Random(6)
    edges = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(500)] + [(1000 + i, 1001 + i) for i in range(60)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    while any(label[a] != label[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    wrote = []
    monkeypatch.setattr(components, "ONE_TASK_EDGES", bound)
    monkeypatch.setattr(components, "materialize", lambda df, name: wrote.append(name) or materialize(df, name))
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.label for x in got} == label and len(got) == len(label)
    assert len(wrote) == 1 if bound else len(wrote) > 3  # a few edges take no rounds


def near_copies(n):
    """Half of the texts are close to one text and link; half are further off, link with none, and share keys with all."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(n):
        gone = set(r.sample(range(300), r.randint(8, 12) if i % 2 else r.randint(40, 44)))
        rows.append((i, " ".join(f"x{i}_{j}" if j in gone else w for j, w in enumerate(base))))
    return rows


def test_rows_compared_grow_with_a_group(spark, monkeypatch):
    make, made = sketch_join._split_pairs, spark.sparkContext.accumulator(0)

    def counting(*args):
        run = make(*args)

        def counted(table):
            made.add(table.num_rows)
            return run(table)

        return counted

    monkeypatch.setattr(sketch_join, "_split_pairs", counting)
    monkeypatch.setattr(sketch_join, "ROWS_PER_BLOCK", 8)
    rows = near_copies(160)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = jaccard_components(df, width=1, num=80, den=100).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 1, 80, 100)
    assert 0 < made.value <= 100 * len(rows)  # not once for each key and block of its group, which is 1100 times

"""Chat repair, licences, mixing, neighbours, and the pipeline."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import chat_repair as C
from folioflow.llm import collision_ann, license_scan, mixing


def cheapest(roles):
    """The cost of the best repair by trying all ways."""
    best = None
    for choice in itertools.product(range(3), range(1, 4), repeat=len(roles)):  # kind of step and role
        cost, state, ok = 0, 0, True
        for k, role in enumerate(roles):
            kind, new = choice[2 * k], choice[2 * k + 1]
            if kind == 1:
                ok = ok and state != 0 and new == state
                cost += C.MERGE
            elif kind == 2:
                between = [x for x in C.FOLLOWS[state] if new in C.FOLLOWS[x]]
                ok = ok and bool(between)
                cost += C.INSERT
            else:
                ok = ok and new in C.FOLLOWS[state]
            cost += C.RELABEL * (new != role)
            state = new
            if not ok:
                break
        if ok:
            cost += C.INSERT * len(C.CLOSING[state])
            best = cost if best is None else min(best, cost)
    return best


def cost_of(rows):
    total, state = 0, 0
    for r in rows:
        new, old = C.ROLES.index(r.new_role) + 1, C.role_state(r.role)
        total += C.RELABEL * (new != old) + (C.MERGE if r.action.startswith("merge") else 0) + (C.INSERT if r.inserted else 0)
        if r.action.startswith("merge"):
            assert new == state
        else:
            if r.inserted:
                assert C.ROLES.index(r.inserted) + 1 in C.FOLLOWS[state]
                state = C.ROLES.index(r.inserted) + 1
            assert new in C.FOLLOWS[state]
        state = new
    return total + C.INSERT * len(C.CLOSING[state])


def test_repair_is_cheapest_and_legal(spark):
    r = random.Random(1)
    names = ["system", "user", "assistant", None, "User ", "tool"]
    convs = {str(i): [r.choice(names) for _ in range(r.randint(1, 4))] for i in range(60)}
    rows = [(c, t, role, f"x{t}<|end|>" if t else None, 1) for c, roles in convs.items() for t, role in enumerate(roles)] + [(None, None, None, None, 1)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, pos int")
    got = collections.defaultdict(list)
    for x in C.repair(df).orderBy("pos").collect():
        got[x.conv_id].append(x)
    assert len(got) == 61
    for c, roles in convs.items():
        assert [x.role for x in got[c]] == roles
        assert cost_of(got[c]) == cheapest([C.role_state(x) for x in roles]), (roles, got[c])
        text = "".join(x.rendered for x in got[c])
        kinds = [p.split("|>")[0] for p in text.split("<|")[1:] if not p.startswith("end")]
        body = kinds[1:] if kinds[0] == "system" else kinds
        assert body and all(k == ("user", "assistant")[i % 2] for i, k in enumerate(body)) and len(body) % 2 == 0
        assert text.count("<|end|>") == len(kinds)


def test_long_conversation_spans_tasks(spark):
    r = random.Random(2)
    roles = [r.choice(["user", "assistant", "system"]) for _ in range(3000)]
    df = spark.createDataFrame([(7, t, x, "t") for t, x in enumerate(roles)], "conv_id long, turn long, role string, text string").repartition(5)
    got = C.repair(df, stretch=500).orderBy("pos").collect()
    assert [x.turn for x in got] == [x.pos for x in got] == list(range(3000))
    states = [C.role_state(x) for x in roles]
    cost = np.array([0] + [C._NEVER] * 3)
    for s in states:
        cost = (cost[:, None] + C._MATRICES[s]).min(axis=0)
    assert cost_of(got) == min(cost[s] + C.INSERT * len(C.CLOSING[s]) for s in (1, 2, 3))
    assert C.repair(df.limit(0)).count() == 0


def test_licences(spark):
    notes = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0."}
    rows = [(i, f"some words here\n{t}\nmore", "x") for i, t in enumerate(notes.values())]
    rows += [(10, "He renewed his driver license today.", "x"), (11, None, None), (12, "", None), (None, "Released under the MIT License.", None), (13, "plain text\nwithout any", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    got = sorted((str(r.doc_id), r.paragraph, r.family) for r in license_scan.scan(df, license_scan.LicenseModel(spark, df)).collect())
    assert got == sorted([(str(i), 1, k) for i, k in enumerate(notes)] + [("None", 0, "mit")])


def test_licences_by_any_stem(spark):
    notes = [
        ("cc-by-4.0", "Available under CC BY 4.0."), ("cc-by-sa-4.0", "Published under CC BY-SA 4.0"), ("cc-by-nc-4.0", "Released under CC BY-NC 4.0."),
        ("cc-by-4.0", "This work is available under a Creative Commons Attribution 4.0 International"),
    ]
    df = spark.createDataFrame([(i, f"some words here\n{t}\nmore") for i, (_, t) in enumerate(notes)] + [(10, "The gnu met the account owner\nA warranty in the domain")], "doc_id long, text string")
    got = license_scan.scan(df, license_scan.LicenseModel(spark, df)).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == [(i, 1, k) for i, (k, _) in enumerate(notes)]


def test_wrapped_licences(spark):
    gpl = "# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:"
    rows = [(0, f"first line\n\n{gpl}\n\nlast"), (1, f"first\n \n{bsd}"), (1, f"first\n \n{bsd}"), (None, bsd), (2, f"Released under the MIT License.\n{bsd}"), (3, "He lost his\nfishing license\nlast year"), (4, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.scan(df, license_scan.LicenseModel(spark, df)).collect()
    assert sorted((str(r.doc_id), r.paragraph, r.family) for r in got) == [("0", 2, "gpl-3.0"), ("1", 2, "bsd"), ("1", 2, "bsd"), ("2", 0, "bsd"), ("2", 0, "mit"), ("None", 0, "bsd")]


def test_licences_calibration(spark):
    df = spark.createDataFrame([(i, f"The license of driver {i} ended\n\nLicensed under the MIT License, number {i}") for i in range(200)], "doc_id long, text string")
    model = license_scan.LicenseModel(spark, df)
    held = license_scan.training_lines(spark, df).where("held AND line LIKE 'The license of driver%'")
    near = model.scores(license_scan._counted(held)).collect()
    assert len(near) > 20 and sum(r.predicted != "unknown" and r.probability >= model.cutoff for r in near) <= 0.01 * len(near)
    assert license_scan.training_lines(spark, df).where("family = 'unknown' AND line LIKE '%number%'").count() == 0
    assert {(r.paragraph, r.family) for r in license_scan.scan(df, model).collect()} == {(2, "mit")}


def test_hypergeometric_distribution(spark):
    n = 20_000
    u = mixing._uniform("id")
    got = spark.range(n).select(F.expr(mixing.hypergeometric("50", "20", "10", u)).alias("h")).groupBy("h").count().collect()
    from math import comb

    for r in got:
        p = comb(20, r.h) * comb(30, 10 - r.h) / comb(50, 10)
        assert abs(r["count"] / n - p) < 0.015
    edges = spark.range(1).select(*(F.expr(mixing.hypergeometric(*a, "0.5D")) for a in (("5", "5", "3"), ("5", "0", "3"), ("0", "0", "0"), ("7", "4", "7")))).first()
    assert tuple(edges) == (3, 0, 0, 4)


def test_splitting_tree_meets_quotas(spark):
    q = spark.createDataFrame([(i, 37 * i) for i in range(6)], "idx int, quota long")
    rows = mixing.split_quotas(q, 8, 1).collect()
    by_source, by_shard = collections.Counter(), collections.Counter()
    for r in rows:
        by_source[r.idx] += r.quota
        by_shard[r.shard] += r.quota
    assert all(by_source[i] == 37 * i for i in range(6)) and max(by_shard.values()) - min(by_shard.values()) <= 1


def filled(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    rest, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: rest * w[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
            free.discard(s)
    return out


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(r.choice([1, 5, 50, 400]))), r.choice(["a", "b", "ä", "z", None]), 1) for i in range(400)] + [(1000, None, "a", 1), (1000, None, "a", 1), (None, "x y", "b", 1), (1001, "", "only empty", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mix = mixing.Mix(df, shards=8)
    got = mix.taken().collect()
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken = filled(dict(sizes)), collections.Counter()
    source = {i: s for i, _, s, _ in rows}
    for x in got:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 and 0 <= x.taken <= 2 * x.size
        taken[s] += x.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 2 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.Mix(df, shards=8).taken().collect()))
    out = mix.rows(df)
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.Mix(df.limit(0), shards=2).taken().count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 16))
    v[3] = v[150] = v[200]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(3000, None, 0), (3050, [0.0] * 16, 0), (3100, [float("nan")] * 16, 0), (3150, [1.0, None], 0), (None, [1.0] * 16, 0), (3200, [1.0, 2.0], 0), (3201, [2.0, 1.0], 0)]
    got = collections.defaultdict(list)
    for r in collision_ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        hits += len(set(best) & {r.vec_id for r in got[q]})
        assert [r.rank for r in got[q]] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in got[q])
    assert hits >= 0.9 * 150 and [r.vec_id for r in got[150]][:2] == [3, 200]
    assert [(r.vec_id, round(r.score, 6)) for r in got[3200]] == [(3201, 0.8)] and not {3000, 3050, 3100, 3150} & set(got)
    assert collision_ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_neighbours_of_repeated_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [0.1, 1.0]), (1, [0.1, 1.0]), (2, [-1.0, -1.0])]
    got = collections.Counter()
    for r in collision_ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id, r.rank, r.vec_id, round(r.score, 6)] += 1
    near, far = round(1 / 1.01**0.5, 6), round(0.1 / 1.01**0.5, 6)
    # Each vector of 50 is a query, and the other one a candidate.
    assert got == {(50, 1, 1, near): 2, (50, 2, 1, far): 2, (50, 3, 50, 0.0): 2, (50, 4, 2, round(-(0.5**0.5), 6)): 2}


def test_pipeline(spark):
    data = "/root/testdata/sf0.001"
    try:
        docs = spark.read.parquet(f"{data}/documents.parquet")
    except Exception:
        pytest.skip("no tables")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() > 0

"""Null, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import chat_repair, license_scan, mixing, pair_rank, piece_bpe, ppm_langid, quality_rules, queries, secret_ledger
from folioflow.llm import sketch_join as S
from folioflow.llm.textvec import slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def odd_documents(spark, extra=""):
    r = random.Random(3)
    text = words(r, 80)
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text.upper(), "en", None, 1), (3, None, None, None, None), (4, "", "de", "a", 0), (None, text + " more", "de", "b", 5), (None, None, None, None, None)]
    rows += [(5, words(r, 60_000), "de", "b", 9), (6, "password: hunter22 " + words(r, 30), "en", "b", 3), (6, "password: hunter22 " + words(r, 30), "en", "b", 3), (7, " \n\t", "en", "c", 3)]
    return spark.createDataFrame(rows, DOCS)


def test_redact_with_clashing_columns(spark):
    docs = odd_documents(spark).withColumn("findings", F.lit("own")).withColumn("BLOB", F.lit(1)).withColumn("_scan_blob", F.lit(2)).withColumn("h", F.lit(3))
    got = secret_ledger.redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = got.where("doc_id = 6").collect()
    assert len(rows) == 2 and all(r.text.startswith("[SECRET]") and r.findings == "own" and r._scan_blob == 2 for r in rows)
    assert got.where("text IS NULL").count() == 2 and got.where("doc_id = 5").first().text == docs.where("doc_id = 5").first().text
    assert secret_ledger.redact(docs.limit(0)).count() == 0


def test_many_languages(spark):
    names = [f"l{i:03}" for i in range(450)]
    alphabets = [chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i) for i in range(450)]
    r = random.Random(1)
    rows = [(4 * i + k, " ".join("".join(r.choice(a) for _ in range(6)) for _ in range(12)), n) for i, (n, a) in enumerate(zip(names, alphabets)) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ppm_langid.fit(docs)
    assert len(model.languages) > 400 and len(model.parts) > 1
    got = ppm_langid.predict(docs, model).join(docs, "doc_id").where(F.col("lang").isin(model.languages))
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()


def test_groups_of_languages_are_exact():
    r = random.Random(2)
    samples = {f"x{i}": [words(r, 50).encode(), bytes(r.randrange(256) for _ in range(200))] for i in range(20)}
    model, whole = ppm_langid.Model(samples), ppm_langid.Tables(samples)
    texts = [words(r, 9), "äöü", "", "a"]
    for _, _, t in slices(pa.array(texts)):
        assert len(model.parts) == 2 and np.allclose(model.costs(t.data, t.offsets), whole.costs(t.data, t.offsets), rtol=1e-5)


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark)
    model = ppm_langid.fit(docs)
    got = ppm_langid.predict(docs, model)
    assert got.count() == docs.count() and got.where("lang_pred = 'und'").count() == 4 and got.where("score < 0 OR score > 1").count() == 0
    assert {r.lang_pred for r in ppm_langid.predict(docs, ppm_langid.fit(docs.limit(0))).collect()} == {"und"}
    # Equal languages tie, and the first by code point wins.
    tie = ppm_langid.Model({"b": [b"same text"], "a": [b"same text"]})
    assert ppm_langid.predict(spark.createDataFrame([(1, "same")], "doc_id long, text string"), tie).first()[1:3] == ("a", 0.5)


def test_quality_of_odd_rows(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0)], LABELS)
    got = quality_rules.judge(docs, labels)
    assert got.count() == docs.count() and got.where("n_words = 0 AND kept").count() == 0
    assert quality_rules.judge(docs.limit(0), labels).count() == 0 and quality_rules.keep_good(docs.limit(0), labels.limit(0)).count() == 0
    clash = docs.withColumn("_q_n_words", F.lit("x")).withColumn("n_words", F.lit("y"))
    kept = quality_rules.keep_good(clash, labels)
    assert kept.columns == clash.columns and {r._q_n_words for r in kept.collect()} == {"x"}


def test_ranking_of_odd_rows(spark):
    docs = odd_documents(spark)
    r = random.Random(8)
    more = [(i, words(r, 40) if i % 2 else words(r, 40).upper() + " !!!", "en", "a", 1) for i in range(20, 220)]
    docs = docs.unionByName(spark.createDataFrame([*more, *more[:9], (21, "another text of 21", "en", "a", 1)], DOCS))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20, 220)] + [(20, 1, 0), (None, 1, 0), (3, 1, 0)], LABELS)
    one, two = pair_rank.fit(docs, labels), pair_rank.fit(docs.repartition(7), labels)
    assert np.array_equal(one.weights, two.weights) and one.threshold == two.threshold
    got = pair_rank.score(docs, one)
    assert got.count() == docs.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert {r.score for r in pair_rank.score(docs, pair_rank.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert pair_rank.score(docs.limit(0), one).count() == 0


def test_licences_of_odd_rows(spark):
    long = "plain words here\n" * 30_000 + "Released under the GPLv3\n" + "more words\n" * 1000
    notes = [("gpl-3.0", "Released under the GPLv3"), ("gpl-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"), ("bsd", "Distributed under the terms of the Modified BSD License"), ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted")]
    rows = [(i, f"x y\n{t}\nz", 0.5, "f") for i, (_, t) in enumerate(notes)] + [(10, long, 0.5, "f"), (11, None, None, None), (12, "", None, None), (0, f"x y\n{notes[0][1]}\nz", 0.5, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, probability double, family string")
    model = license_scan.LicenseModel(spark, docs)
    got = sorted((r.doc_id, r.paragraph, r.family) for r in license_scan.scan(docs, model).collect())
    assert got == sorted([(i, 1, f) for i, (f, _) in enumerate(notes)] + [(0, 1, "gpl-3.0"), (10, 30_000, "gpl-3.0")])
    assert license_scan.scan(docs.limit(0), model).count() == 0


def plain_licence(model, line):
    """Family, probability and overlap of a line from the model's weights, in plain Python."""
    import re

    tokens = re.findall(r"[^\W_]+(?:\.\d+)*", line.lower())
    grams = {" ".join(tokens[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(tokens) - n + 1)}
    grams = sorted(g for g in grams if any(s in g for s in license_scan.STEMS))
    at = sorted({model._hash.indexOf(g) for g in grams})
    weights, bias = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    margin = weights[:, at].sum(axis=1) + bias
    p = np.exp(margin - margin.max())
    p /= p.sum()
    family = model.families[int(p.argmax())]
    pairs = {f"{a} {b}" for a, b in zip(tokens, tokens[1:])}
    share = max((len(pairs & set(license_scan._word_pairs(t))) / len(license_scan._word_pairs(t)) for t in license_scan.TEMPLATES.get(family, [])), default=0.0)
    return family, float(p.max()), share


def test_licences_equal_plain_version(spark):
    lines = ["Licensed under the MIT License", "This file is under the Apache License, Version 2.0 as of now", "the license of the driver", "All rights reserved. No part of this publication may be reproduced", "Copyright law is old", "Licensed under CC BY-SA 4.0", "GNU General Public", "spdx license identifier", "a public domain novel"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    model = license_scan.LicenseModel(spark, docs)
    got = {r.doc_id: r for r in license_scan.scan(docs, model).collect()}
    for i, line in enumerate(lines):
        family, p, share = plain_licence(model, line)
        assert (i in got) == (family != "unknown" and p >= model.cutoff and share >= license_scan.CONFIRM), line
        if i in got:
            assert got[i].family == family and abs(got[i].probability - p) < 1e-9 and abs(got[i].overlap - share) < 1e-12


def test_mix_of_odd_rows(spark):
    docs = odd_documents(spark)
    mix = mixing.Mix(docs)
    got = mix.taken().collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    rows = mix.rows(docs)
    assert rows.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in got)
    empty = mixing.Mix(docs.where("text IS NULL"))
    assert empty.taken().count() == 2 and empty.rows(docs.where("text IS NULL")).count() == 0


def test_repair_of_odd_rows(spark):
    rows = [(1, 0, "user", "x" * 300_000), (1, 0, "user", "x" * 300_000), (None, None, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(7)).withColumn("rendered", F.lit("r"))
    got = chat_repair.repair(df).collect()
    assert len(got) == 5 and sum(len(r.rendered) > 300_000 for r in got) == 2
    assert chat_repair.repair(df.limit(0)).count() == 0


def test_join_of_odd_rows(spark):
    docs = odd_documents(spark).withColumn("h", F.lit(1)).withColumn("_set_h", F.lit(2)).withColumn("cid", F.lit(3))
    join = S.ParitySketchJoin(docs, "doc_id", "text", 5, 80, 100)
    kept = join.one_per_component(docs)
    assert kept.columns == docs.columns
    # One of the copies and near copies of document 1; both texts of id 6 and all without words stay.
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "4", "5", "6", "6", "7", "None"] and {r._set_h for r in rows} == {2}
    assert S.ParitySketchJoin(docs.limit(0), "doc_id", "text", 5, 80, 100).one_per_component(docs.limit(0)).count() == 0


def plain_pairs(rows, num, den, closest):
    out = set()
    for x in rows:
        near = []
        for y in rows:
            if (x["key"], x["i"], x["j"]) == (y["key"], y["i"], y["j"]) and x["minor"] and not y["minor"] and x["label"] != y["label"]:
                least = min((r["sketch"] for r in rows if (r["key"], r["i"], r["j"]) == (x["key"], x["i"], x["j"])), key=len)
                a, b, _ = S.unpacked([x["sketch"], y["sketch"], least])
                far = int(np.bitwise_count(a ^ b).sum())
                if far * (den + num) <= (den - num) * (x["n"] + y["n"]) and den * min(x["n"], y["n"]) >= num * max(x["n"], y["n"]):
                    near.append((far, tuple(sorted((x["cid"], y["cid"])))))
        if closest and near:
            least = min(near)[0]
            out.add(frozenset(p for f, p in near if f == least))
        elif not closest:
            out |= {p for _, p in near}
    return out


@pytest.mark.parametrize("closest", [True, False])
def test_blocks_of_buckets(closest):
    rng = np.random.default_rng(5)
    rows = []
    for key in range(3):
        base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        for m in range(14):
            n = int(rng.integers(330, 400))
            tokens = np.unique(np.concatenate([base[:n], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), dtype=np.uint64)]))
            for i in range(2):
                rows.append({"key": key, "i": i, "j": 0, "minor": 2 * (m % 3 > 0) if i else 0, "cid": 100 * key + m, "label": 100 * key + m // 4, "n": len(tokens), "sketch": S.folded_sketch(tokens, S.sketch_bits(len(tokens), 80, 100))})
    rows += [dict(r, minor=0) for r in rows if r["minor"]]
    table = pa.table({k: pa.array([r[k] for r in rows], pa.binary() if k == "sketch" else pa.int64()) for k in rows[0]})
    got = S._split_pairs(80, 100, closest)(table)
    pairs = set(zip(got.column("a").to_pylist(), got.column("b").to_pylist()))
    want = plain_pairs(rows, 80, 100, closest)
    assert pairs and (all(any(p in w for p in pairs) for w in want) and pairs <= set().union(*want) if closest else pairs == want)
    none = table.filter(pa.array([False] * len(rows)))
    assert S._split_pairs(80, 100, closest)(none.slice(0, 0)).num_rows == 0 if none.num_rows else True


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(50):
        both = rng.integers(0, 1 << 63, int(rng.integers(0, 300)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, int(rng.integers(0, 40)), dtype=np.uint64)])) for _ in range(2))
        bits = [S.sketch_bits(len(x) * s, 80, 100) for x, s in ((a, 1), (b, 2))]
        x, y = S.folded_sketch(a, bits[0]), S.folded_sketch(b, bits[1])
        far = S.distances(pa.array([x, y], pa.binary()), pa.array([y, x], pa.binary()))
        assert far[0] == far[1] <= len(np.setxor1d(a, b))


def test_keys_of_many_sets_of_a_task():
    rng = np.random.default_rng(9)
    hot = np.uint64(1 << 63)
    keys = [(np.concatenate([[hot], rng.integers(0, 1 << 63, 5, dtype=np.uint64)]).astype(np.uint64), np.zeros(6, np.uint8)) for _ in range(40)]
    packed = S._bucketed(keys, list(range(40)), 64)
    tables = [pa.Table.from_batches([packed.slice(i, 1)]) for i in range(packed.num_rows)]
    rows = pa.concat_tables([S._shared_keys(64)(t) for t in tables])
    found = {}
    for k, c in zip(rows.column("key").to_pylist(), rows.column("cid").to_pylist()):
        found.setdefault(k, set()).add(c)
    assert [sorted(v) for v in found.values()] == [list(range(40))]


def test_filter_misses_nothing(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    held = S.TextFilter(rows.where("id < 1000").select("h"), 1000)
    got = rows.withColumn("m", held.maybe(F.col("h")))
    assert got.where("id < 1000 AND NOT m").count() == 0 and got.where("id >= 1000 AND m").count() < 400


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_documents(spark).withColumn("findings", F.lit(1)).withColumn("mix_size", F.lit(2)).withColumn("_set_h", F.lit(3)).withColumn("ids", F.lit(4)).withColumn("_q_n_words", F.lit(5))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, rows, str(tmp_path))
            assert got.columns == rows.columns, name
            rows = corpus_pipeline.materialize(got, name)
        out = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
        assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() == rows.count()


def test_stages_keep_what_they_should(spark, tmp_path):
    """Clean documents stay, copies go but for the smallest id, secrets are marked, and words are drawn."""
    r = random.Random(12)
    clean = [(i, words(r, 60), "en", "ab"[i % 2], 1) for i in range(60)]
    copies = [(100 + i, clean[0][1], "en", "a", 1) for i in range(3)] + [(200, clean[1][1] + " extra", "en", "b", 1)]
    secret = [(300, words(r, 40) + " token=abcdef123 end", "en", "a", 1)]
    bad = [(400, "few words", "en", "a", 1)]
    spark.createDataFrame([(0, 1, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(clean + copies + secret + bad, DOCS)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
    rows = {x.doc_id: x for x in docs.collect()}
    assert sorted(rows) == [*range(60), 300]
    assert "[SECRET]" in rows[300].text and "abcdef123" not in rows[300].text and rows[300].n_chars == len(rows[300].text)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    total = sum(len(x.text.split()) for x in rows.values())
    drawn = mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(drawn - 1.5 * total) < 0.05 * total
    out = corpus_pipeline.STAGES[4][1](spark, mixed, str(tmp_path)).join(mixed.select("doc_id", "text").distinct(), "doc_id").collect()
    encoder = piece_bpe.encoder(queries.tokenizer_model())
    by_text = {(x.doc_id, tuple(x.ids)) for x in out}
    want = {(x.doc_id, tuple([*encoder.library.encode(x.text), encoder.end])) for x in out}
    assert by_text == want

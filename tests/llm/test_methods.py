"""The methods themselves: data structures, bounds, models and the paths that small tables do not reach."""
import random
import time

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import ROWS, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.llm import common, decontaminate, license_scan, line_dedup, pii_crf, piece_bpe, quality_rff, queries, secrets, simhash, token_files

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------- Elias-Fano
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=1500))
def test_elias_fano_round_trip(values):
    values = np.sort(np.array(values, np.int64))
    ef = token_files.EliasFano.encode(values)
    ef = token_files.EliasFano.of(len(values), *ef.parts())
    assert ef.slice(0, len(values)).tolist() == values.tolist()
    for i in {0, len(values) // 2, len(values) - 1} if len(values) else ():
        assert ef.select(i) == values[i]
    a, b = len(values) // 3, 2 * len(values) // 3
    assert ef.slice(a, b).tolist() == values[a:b].tolist()
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_space():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 100_000))
    size = sum(map(len, token_files.EliasFano.encode(values).parts()))
    assert size * 8 <= 100_000 * (2 + np.log2(values[-1] / 100_000)) + 64  # near the bound, against 64 bits each
    assert token_files.EliasFano.encode(values).slice(0, len(values)).tolist() == values.tolist()


def test_token_files_without_ids_and_by_select(spark, tmp_path):
    rows = [(None, "no id"), (5, "five"), (5, "again five"), (-3, "minus"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_files.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), 1, str(tmp_path))
    got = [tuple(r) for r in token_files.read_shards(manifest, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute.token_rows(rows)
    for m in manifest.collect():
        shard = token_files.Shard(str(tmp_path), m["name"])
        assert sum(len(shard.tokens(i)) for i in range(shard.n_docs)) == m["n_tokens"]


# ------------------------------------------------------------- tokenizers
WORDS = st.text(st.one_of(st.characters(max_codepoint=0x24F), st.characters(), st.sampled_from(" \n.,'▁")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4))
def test_words_equal_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    enc = token_files.encoder(public_tokenizers.path("word_bpe_49k.json"))
    for t, got in zip(texts, enc.encode_batch(texts)):
        assert np.frombuffer(got, enc.kind).tolist() == enc.lib.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4))
def test_agenda_equals_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    enc = piece_bpe.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    for t, got in zip(texts, enc.ids_batch(texts)):
        assert got == [*enc.lib.encode(t), enc.end]


@settings(max_examples=80, deadline=None)
@given(st.text("aeithns.", min_size=1, max_size=80))
def test_list_and_heap_agendas_agree(part):
    enc = piece_bpe.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    assert enc._merge_short(part) == enc._merge_long(part)


def test_memos_are_emptied(monkeypatch):
    monkeypatch.setattr(piece_bpe, "MEMO_SEGMENTS", 3)
    monkeypatch.setattr(piece_bpe, "MEMO_PARTS", 3)
    enc = piece_bpe.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    for t in ("one two three four five", "six seven eight nine ten", "one two"):
        assert enc.encode(t) == [*enc.lib.encode(t), enc.end]
    assert len(enc.known) <= 5


def test_long_parts_are_not_kept():
    enc = piece_bpe.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    text = "\u6f22\u5b57" * 500 + " plain words " + "ab" * 400
    assert enc.encode(text) == [*enc.lib.encode(text), enc.end]
    words = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(words.encode_batch([text])[0], words.kind).tolist() == words.lib.encode(text, add_special_tokens=False).ids
    memos = (enc.known, enc.parts, words.words, words.others, words.pieces)
    assert any(memos) and max(len(k) for m in memos for k in m) <= 64


# ------------------------------------------------------------- SimHash
def close_prints(rng, n, centre=None):
    out = set()
    centre = rng.getrandbits(64) if centre is None else centre
    while len(out) < n:
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        out.add(x)
    return out


def pairs_to_groups(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", range(4))
def test_pivot_tables_lose_no_link(seed):
    rng = random.Random(seed)
    prints = sorted(close_prints(rng, 150) | close_prints(rng, 60) | {rng.getrandbits(64) for _ in range(100)})
    signed = {simhash._signed(p): p for p in prints}
    u, v = simhash.pivot_links(np.array(list(signed), np.int64), 4)
    assert all((int(a) ^ int(b) & (1 << 64) - 1).bit_count() % 64 <= 64 for a, b in zip(u, v))
    mine = pairs_to_groups(list(signed), list(zip(u.tolist(), v.tolist())))
    every = pairs_to_groups(list(signed), [(a, b) for i, a in enumerate(signed) for b in list(signed)[i + 1 :] if (signed[a] ^ signed[b]).bit_count() <= 4])
    groups = lambda g: {frozenset(x for x in g if g[x] == r) for r in set(g.values())}
    assert groups(mine) == groups(every) and len(u) == len(signed) - len(groups(every))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_every_k_and_tiles_find_every_group(spark, k):
    rng = random.Random(k)
    prints = sorted(close_prints(rng, 120) | close_prints(rng, 40) | {0, 1, (1 << 64) - 1})
    df = spark.createDataFrame([(simhash._signed(p), i) for i, p in enumerate(prints)], "fp long, least_id long")
    dealt = simhash.tiles(df, 4, k, tile=16)  # cells of over 16 are split
    assert dealt.groupBy("cell", "a", "b").count().agg(F.max("count")).first()[0] < len(prints)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.link_tiles(dealt, 4)).collect()}
    got = {i: roots.get(simhash._signed(p), simhash._signed(p)) for i, p in enumerate(prints)}
    want = brute.components(dict(enumerate(prints)))
    assert len({(got[i], want[i]) for i in got}) == len(set(got.values())) == len(set(want.values()))


def test_blocks_follow_the_count():
    assert [simhash.blocks_to_agree(n, 4) for n in (0, 10**6, 10**9, 10**11)] == sorted(simhash.blocks_to_agree(n, 4) for n in (0, 10**6, 10**9, 10**11))
    for k in range(1, 6):
        assert all(bin(m).count("1") >= 64 * k // (4 + k) - k for m in simhash.cell_masks(4, k))


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1001, 1000)], "u long, v long")
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert {roots[i] for i in range(1, 301)} == {0} and roots[1001] == 1000
    assert simhash.components(links.limit(0)).collect() == []


# ------------------------------------------------------------- decontamination
def test_shards_and_pieces_of_a_large_benchmark(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 80)))) for i in range(30)]
    texts = []
    for i in range(40):
        words = rng.choices(vocab, k=50)
        source = rng.choice(items)[1].split()
        at = rng.randrange(len(source))
        texts.append((i, " ".join(words + source[at : at + 25] + words[:5])))
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 20)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(decontaminate.automata, "__defaults__", (10, 300))
    assert len(decontaminate.automata(bench)) > 1
    for r in decontaminate.overlaps(docs, bench).collect():
        n, hit, found = brute.contamination(dict(texts)[r["doc_id"]], items)
        assert (r["mark"]["n_words"], sum(s["stop"] - s["start"] for s in r["mark"]["spans"]), r["mark"]["items"]) == (n, hit, found)
    whole = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert whole and all(brute.contamination(t, items)[1] == 0 for t in whole.values())
    # coverage counts the spans of all shards together
    assert whole == {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, shard_words=300).collect()}
    mostly = spark.createDataFrame([(1, " ".join(f"{t} gap{i}" for i, t in items if len(t.split()) >= 10)), (2, "clean"), (3, None)], "doc_id long, text string")
    for words in (300, 200_000):
        got = decontaminate.decontaminate(mostly.withColumn("_mark", F.lit(7)), bench, shard_words=words)
        assert sorted(map(tuple, got.collect())) == [(2, "clean", 7), (3, None, 7)]


def test_spans_are_cut_and_covered_documents_dropped(spark):
    bench = spark.createDataFrame(brute.ITEMS[:1], "item_id long, text string")
    rows = [(1, "Clean words stay,\nall of them."), (2, f"Lead in words that come before it and are more than the passage has. {brute.PASSAGE}! Tail words, and a few more of them here."), (3, brute.PASSAGE), (4, None), (5, "")]
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: rows[0][1], 2: "Lead in words that come before it and are more than the passage has. ! Tail words, and a few more of them here.", 4: None, 5: ""}


# ------------------------------------------------------------- personal data
def test_skip_chain_labels_a_repeated_number(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        n = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        rows.append((i, f"Please call {n} today. " + "word " * 50 + f"Once more: {n[3:]} it is." if i % 2 else f"The order {rng.randint(10**8, 10**9)} left the house."))
    got = {r["doc_id"]: r for r in pii_crf.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i]["base"]) == i % 2 for i in range(60))
    assert all(len(got[i]["spans"]) == 2 * (i % 2) for i in range(60))  # the repeat without its country code; no order number
    i, s = 1, got[1]["spans"][1]
    assert rows[i][1][s["start"] : s["stop"]] == rows[i][1].split("Once more: ")[1].split(" it")[0]


def test_hundreds_of_repeats_keep_their_label(spark):
    rng = random.Random(6)
    number = lambda: f"{rng.randint(20, 99)} {rng.randint(10**6, 10**7 - 1)}"
    rows = []
    for i, repeats in enumerate([1, 2, 5, 31, 100, 400] * 4):
        n = number()
        rows.append((i, f"Tel: +49 {n}. " + f" {'word ' * 12} 0{n} it is." * repeats))
    rows += [(100 + i, " ".join(f"order {rng.randint(10**8, 10**9)} {'went ' * 10}" for _ in range(60))) for i in range(20)]
    got = {r["doc_id"]: r for r in pii_crf.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(got[i]["spans"]) for i in range(24)] == [2, 3, 6, 32, 101, 401] * 4
    assert not any(got[100 + i]["spans"] for i in range(20))


def test_numbers_in_one_run_are_candidates(spark):
    text = "030 1234567 192.168.0.1 and 030 1234567 040 7654321"
    got = {text[n.start : n.stop] for n in pii_crf.nodes_of(text) if n.kind < 0}
    assert {"030 1234567", "040 7654321", "1234567", "7654321"} <= got and not any("192" in x for x in got)
    rng, rows = random.Random(8), []
    for i in range(60):
        a, b = (f"{rng.randint(20, 99)} {rng.randint(10**6, 10**7 - 1)}" for _ in "ab")
        rows.append((i, f"Tel: +49 {a}. {'word ' * 12} Fax: +49 {b}. {'word ' * 12} 0{a} 0{b} then. {'word ' * 12} 0{a} 192.168.0.1 end"))
    for r in pii_crf.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t = rows[r["doc_id"]][1]
        a, b = t.split("Tel: +49 ")[1].split(".")[0], t.split("Fax: +49 ")[1].split(".")[0]
        more = sorted(t[s["start"] : s["stop"]] for s in r["spans"] if s not in r["base"])
        assert more == sorted([f"0{a}", f"0{b}", f"0{a}"]), t


def test_messages_cross_a_long_chain():
    pairwise = np.log(np.full((2, 5, 5), 1e-3) + np.eye(5))
    field = pii_crf.Field({"x": np.zeros(5)}, pairwise, np.zeros(5))
    p = field.beliefs([(3, "x")] + [(-1, "x")] * 100, [(i, i + 1, 0) for i in range(100)])
    k = np.linalg.matrix_power(np.exp(pairwise[0]), 100)[4]
    assert np.allclose(p[100], k / k.sum(), atol=1e-2)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@1+0-_ ()%25\n4", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [(pii_crf.KINDS[k], a, b) for k, a, b in pii_crf.base_spans(text)] == brute.pii(text)


@pytest.mark.parametrize("text", ["x@y " + "a" * 400_000, "7" * 400_000, "a@" * 200_000, "1." * 200_000, "a[at]" * 80_000, "+1" + "." * 400_000, "0" * 5000 + "1.2.3.4", "\u6f22" * 400_000 + "@"])
def test_long_runs_take_linear_time(text):
    began = time.perf_counter()
    pii_crf.edges_of(pii_crf.nodes_of(text))
    assert time.perf_counter() - began < 20
    if text.endswith("1.2.3.4"):
        assert pii_crf.base_spans(text) == [(1, 0, len(text))]


def test_spelt_out_addresses():
    text = "Write to jo.doe (at) host.org or anna[at]host.org, bo@intranet"
    assert [text[a:b] for a, b in pii_crf._addresses(text)] == ["jo.doe (at) host.org", "anna[at]host.org", "bo@intranet"]


def test_message_passing_is_exact_on_a_chain():
    field = pii_crf.Field({"x": np.log([0.7, 0.1, 0.1, 0.05, 0.05])}, np.log(np.full((2, 5, 5), 0.5) + np.eye(5)), np.zeros(5))
    p = field.beliefs([(2, "x"), (-1, "x"), (-1, "x")], [(0, 1, 0), (1, 2, 1)])
    m = np.exp(field.pairwise[0])
    u = np.exp(field.unary["x"])
    joint = m[3][:, None] * u[:, None] * m * u[None, :]
    assert np.allclose(p[1], joint.sum(1) / joint.sum(), atol=1e-3) and np.allclose(p[2], joint.sum(0) / joint.sum(), atol=1e-3)


# ------------------------------------------------------------- secrets
def test_random_runs_are_found_and_word_runs_are_not(spark):
    rng = random.Random(11)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(b64) for _ in range(44)) + "7a" for _ in range(40)]
    dull = ["abcdefghijklmnopqrstuvwxyz0123456789", "aaaaaaaaaaaaaaaaaaaaaaaaa1111111111", "the-quick-brown-fox-jumps-2-over-the-lazy-dog", "item_00000000000000000000000001", "1a" * 20, "http//www/example/com/some/long/path/name/2024"]
    rows = [(i, f"before {k} after") for i, k in enumerate(keys)] + [(100 + i, f"before {d} after") for i, d in enumerate(dull)]
    got = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == 3] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(got[i]) for i in range(40)) >= 36  # the share thrown out is bounded by the false-discovery level
    assert not any(got[100 + i] for i in range(len(dull)))
    assert all((s["start"], s["stop"]) == (7, 7 + 46) for i in range(40) for s in got[i])


# ------------------------------------------------------------- licences
def test_size_bounds_are_exact():
    for b in range(1, 60):
        low, high = license_scan.size_bounds(b, 0.8)
        ok = [a for a in range(1, 400) if 2 * min(a, b) / (a + b) >= 0.8]
        assert (min(ok), max(ok)) == (max(low, 1), high)


MIT = """MIT License

Copyright (c) 2020 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
GPL = """#!/usr/bin/env python
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
import os
import sys
def main(argv):
    for name in os.listdir(argv[1]):
        print(name, os.path.getsize(name))
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
 * Redistributions of source code must retain the above copyright notice.
"""


def test_wrapped_notices_are_one_passage(spark):
    rows = [(1, MIT), (2, GPL), (3, BSD), (4, "Copyright 2020 Foo, released under the MIT License"), (5, GPL + "x y z\n" * 30 + GPL), (6, "the license of free software"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.summarise(license_scan.scan_licenses(docs)).collect()}
    assert [got[i]["best_license"] for i in range(1, 9)] == ["mit", "gpl-3.0", "bsd-3-clause", "mit", "gpl-3.0", None, None, None]
    assert all(got[i]["best_dice"] == 1 for i in range(1, 6))
    assert got[5]["n_matches"] == 2 * got[2]["n_matches"]  # each copy is a passage
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(queries.ORACLES["op10_license_scan"]).fetchall()) == sorted(map(tuple, got.values()))


# ------------------------------------------------------------- quality
def test_held_out_accuracy(spark):
    docs, labels = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    rows = quality_rff.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_normal_equations_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [([float(x) for x in rng.normal(size=quality_rff.N_STATS)], float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "stats array<double>, y double")
    model = quality_rff.QualityModel(np.zeros(quality_rff.N_STATS), np.ones(quality_rff.N_STATS))
    z = model.features(np.array([r[0] for r in rows]))
    want = z.T @ np.hstack([z, np.array([[r[1]] for r in rows])])
    for n in (1, 7):
        assert np.allclose(quality_rff.normal_equations(df.repartition(n), model), want)


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, quality_rff.N_STATS))
    model = quality_rff.QualityModel(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2 / x.shape[1])
    assert np.abs(z @ z.T - kernel).mean() < 0.08


@given(st.lists(st.integers(0, 5), min_size=1, max_size=40))
def test_pooling_is_monotone_and_keeps_the_mean(y):
    w = np.ones(len(y))
    _, fitted = quality_rff.pool_adjacent(np.arange(len(y)), w, np.array(y, float))
    assert (np.diff(fitted) >= -1e-12).all() and abs(fitted.mean() - np.mean(y)) < 1e-9


def test_no_labels(spark):
    labels = spark.createDataFrame([(10, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality_rff.quality_scores(table(spark), labels).collect()} == {0.5}


# ------------------------------------------------------------- line dedup
def test_bitmaps_leave_full_words_out(spark):
    docs = table(spark)
    maps = {r["doc_id"]: r for r in line_dedup.keep_bitmaps(docs).collect()}
    text = dict(ROWS)
    for i, r in maps.items():
        lines = text[i].split("\n")
        kept = [n for n in range(len(lines)) if r["keep"].get(n >> 6, -1) >> (n & 63) & 1]
        assert "\n".join(lines[n] for n in kept) == brute.line_dedup(ROWS)[i][2] and all(w != -1 for w in r["keep"].values())


def test_inner_names_as_columns(spark):
    rows = [(i, "a line that three documents share\nown line %d" % i) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_th", "_BID", "_bth", "_lost", "_keep", "_n_lines", "_n_dropped", "_fp", "_clean"):
        docs = docs.withColumn(c, F.lit(c))
    bench = spark.createDataFrame(brute.ITEMS[:1], "item_id long, text string")
    for out in (line_dedup.dedup_lines(docs), simhash.keep_one(docs), decontaminate.decontaminate(docs, bench)):
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.collect() for c in docs.columns[2:])


def test_repeated_rows_and_rows_without_id(spark):
    rows = [(1, brute.LINE), (1, brute.LINE), (2, brute.LINE), (None, brute.LINE), (3, f"x\n{brute.LINE}")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, ""), (1, ""), (2, ""), (None, brute.LINE), (3, f"x\n{brute.LINE}")], key=str)


# ------------------------------------------------------------- later findings
def test_keep_one_keeps_each_group_where_rows_share_a_doc_id(spark):
    near = "the quick brown fox jumps over the lazy dog near the old river bank today while birds sing loudly above"
    rows = [(1, "alpha beta gamma delta epsilon"), (1, "one two three four five six"), (2, "alpha beta gamma delta epsilon"), (3, near), (3, near), (4, near), (5, None), (6, ""), (None, "alpha beta gamma delta epsilon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect())
    assert kept == [(1, rows[0][1]), (1, rows[1][1]), (3, near), (5, None)]


def test_a_third_of_blank_texts(spark):
    rows = [(i, " " * (i % 3) if i % 3 == 0 else f"text number {i} of its own kind with words {i * 7919}") for i in range(600)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.components({i: brute.simhash(t) for i, t in rows})


def test_tables_of_digits_stay_small():
    began = time.time()
    nodes = pii_crf.nodes_of(" ".join(random.Random(1).choices("0123456789", k=200_000)))
    assert time.time() - began < 15 and len(nodes) < 1000
    text = "call +49 30 1234567 now; 030 1234567 040 7654321 / 49 30 1234567"
    keys = {n.exact for n in pii_crf.nodes_of(text)}
    assert {"#49301234567", "#1234567", "#7654321"} <= keys
    assert any(text[n.start : n.stop] == "030 1234567" for n in pii_crf.nodes_of(text))  # a join that stands elsewhere on its own


def test_spelt_out_hosts_are_taken_whole():
    text = "bob [at] example [dot] com and bob@example.com"
    spans = {text[n.start : n.stop]: n.exact for n in pii_crf.nodes_of(text)}
    assert spans["bob [at] example [dot] com"] == "bob@example.com" == spans["bob@example.com"]

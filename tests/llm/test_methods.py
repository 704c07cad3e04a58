"""Operators that SQL can't express, against brute force, exact round trips or held-out accuracy."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from litscreen.llm import decontaminate, extract, graph, labelled, licences, lines, minhash, neighbours, packing, quality, repeats, toxicity
from litscreen.llm.common import table

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def documents(spark):
    return [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def mutated(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(f"t{rng.randrange(300)}" for _ in range(rng.randrange(3, 90)))) for i in range(60)]
    for base in range(4):  # chains and crowds around each base, copies included
        words = [f"b{base}w{i}" for i in range(150)]
        docs += [(100 + 50 * base + i, mutated(rng, words, rng.randrange(0, 14))) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == minhash.brute_force(docs)


def test_blocks_find_what_heads_miss(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    docs = [(i, mutated(rng, words, 5)) for i in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), rounds=0).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == minhash.brute_force(docs)


def test_near_duplicates_on_documents(spark):
    got = minhash.near_duplicates(table(spark, SF, "documents")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == minhash.brute_force(documents(spark))


def test_word_hashes_do_not_depend_on_parts(monkeypatch):
    data = " ".join(f"word{i}" for i in range(400)).encode() + b" " + b"x" * 900 + b"  end"
    whole = minhash.word_hashes(data)
    monkeypatch.setattr(minhash, "CHUNK", 64)
    parts = minhash.word_hashes(data)
    assert len(whole) == len(parts) == 402
    assert (whole[:400] == parts[:400]).all() and whole[-1] == parts[-1]


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"{rng.randrange(300):03}", f"{rng.randrange(300):03}") for _ in range(220)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(80)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}


@pytest.mark.parametrize("length, most", [(64, 2000), (64, 6), (400, 2000)])
def test_repeats_equal_brute_force(spark, length, most):
    rng = random.Random(length)
    docs = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 700)))) for i in range(30)]
    base = docs[3][1] + docs[8][1] + "z" * 500
    for i in range(40, 75):
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = rng.choice("abc")
        docs.append((i, "".join(text)[rng.randrange(0, 40):]))
    docs += [(90, None), (91, "ab" * 600)]
    got = repeats.repeats_report(spark.createDataFrame(docs, "doc_id long, text string"), length, most).collect()
    assert {r["doc_id"]: tuple(r[1:]) for r in got} == repeats.brute_force(docs, length)


def test_repeats_on_documents(spark):
    got = repeats.repeats_report(table(spark, SF, "documents")).collect()
    assert {r["doc_id"]: tuple(r[1:]) for r in got} == repeats.brute_force(documents(spark))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=0, max_size=7), min_size=1, max_size=12), st.integers(1, 4))
def test_merged_transform_orders_suffixes(strings, depth):
    cells = np.zeros((len(strings), 8), np.int64)
    for i, s in enumerate(strings):
        cells[i, : len(s)] = s
    shards = [repeats.Shard(cells[i : i + 5]) for i in range(0, len(strings), 5)]
    row, column, interval = repeats.merge(shards, depth)
    suffixes = [tuple(strings[r][c:]) for r, c in zip(row, column, strict=True)]
    assert sorted(zip(row, column, strict=True)) == [(r, c) for r, s in enumerate(strings) for c in range(len(s))]
    cut = [s[:depth] for s in suffixes]
    assert cut == sorted(cut)
    together = defaultdict(set)
    for i, s in zip(interval, suffixes, strict=True):
        together[i].add(s[:depth])
    assert all(len(v) == 1 for v in together.values())
    long_ones = [(s[:depth], i) for i, s in zip(interval, suffixes, strict=True) if len(s) >= depth]
    assert len({i for _, i in long_ones}) == len({s for s, _ in long_ones})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9), st.integers(1, 90))
def test_fullest_is_the_best_subset(lengths, capacity):
    counts = sorted(((n, lengths.count(n)) for n in set(lengths)), reverse=True)
    chosen = packing.fullest(counts, capacity)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums}
    assert sum(n * k for n, k in chosen) == max(s for s in sums if s <= capacity)
    assert all(k <= lengths.count(n) for n, k in chosen)


def check_packing(rows, docs, encode):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc, text in docs:
        ids = [*encode(text or ""), 2]
        start = 0
        for r in sorted(pieces.pop(doc), key=lambda r: r["start"]):
            own = struct.pack(f"<{r['length']}I", *ids[start : start + r["length"]])
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(own))
            start += r["length"]
        assert start == len(ids)
    assert not pieces
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two


def test_packing_round_trip(spark):
    docs = [*documents(spark), (9001, "it's <|endoftext|> Ünïcödé\tİstanbul ﬁ x²y ①  你好世界 don't\x0bstop éa"), (9002, "word " * 9000)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), TOKENIZER).collect()
    check_packing(rows, docs, packing.encode_texts(TOKENIZER))


def test_tables_of_the_encoder_stay_small():
    with open(TOKENIZER, encoding="utf-8") as file:
        own = packing.ChunkEncoder(file.read())
    numbers, long = " ".join(f"w{i}x{i}" for i in range(200_000)), "ab" * 5_000
    assert own(numbers) and own(f"{long} {long}.") == own(long) + own(f"{long}.")
    assert len(own.chunks) <= packing.CHUNKS_KEPT <= 150_000 and len(own.words) <= packing.WORDS_KEPT <= 80_000
    assert max(map(len, own.words)) <= packing.KEPT_CHARS and max(map(len, own.chunks)) <= packing.KEPT_CHARS


def test_terms_of_the_sample_reach_the_driver_as_numbers_of_32_bits(spark, monkeypatch):
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda sample, *rest: seen.extend(sample) or fit(sample, *rest))
    docs = spark.createDataFrame([(i, f"one two two {'three' * (i % 4)}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert seen and {a.dtype.itemsize for s in seen for a in s[:2]} == {4}
    assert all(s[1].sum() >= 6 and len(s[0]) == len(s[1]) for s in seen) and model.known.dtype == "int64"


def test_words_of_a_plain_text_are_kept_without_the_signs_beside_them():
    with open(TOKENIZER, encoding="utf-8") as file:
        own = packing.ChunkEncoder(file.read())
    words = ["".join("abcdefghij"[int(d)] for d in f"{i:06d}") for i in range(100_000)]
    assert own("* ".join(words))
    assert all(w in own.words or w in own.chunks for w in words)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_chunks_encode_like_the_whole(text):
    plain = packing.encode_texts(TOKENIZER)
    with open(TOKENIZER, encoding="utf-8") as file:
        own = packing.encoder(file.read())
    ids = plain(text)
    assert own(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_search_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 25)))) for i in range(40)]
    docs = [(i, " ".join(rng.choice("abcdX") for _ in range(rng.randrange(0, 120)))) for i in range(80)]
    found = decontaminate.find_benchmark(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    got = {r["doc_id"]: tuple(r[1:]) for r in decontaminate.contamination_report(found).collect()}
    assert got == decontaminate.brute_force(docs, items)


def test_neighbours_recall(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    want = neighbours.brute_force(rows, lambda i: i % 50 == 0)
    got = defaultdict(dict)
    for r in neighbours.nearest(table(spark, SF, "embeddings"), F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    hits = sum(v in got[q] for q, best in want.items() for v, _ in best)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(abs(got[q][v] - s) < 1e-12 for q, best in want.items() for v, s in best if v in got[q])


@pytest.mark.parametrize("report, label, threshold", [(quality.quality_report, "quality", 0.5), (toxicity.toxicity_report, "toxic", 0.7)])
def test_held_out_accuracy(spark, report, label, threshold):
    sf = "/root/testdata/sf0.01"
    scored = report(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = scored.join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    scores, truth = np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])
    right, area = labelled.accuracy(scores, truth, threshold)
    assert right > 0.9 and area > 0.9


def test_pages_give_their_articles(spark):
    import re
    from html import unescape

    pages = table(spark, SF, "pages")
    got = {r["page_id"]: r["text"] for r in extract.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_article_without_its_surroundings():
    html = (
        "<html><head><title>T</title></head><body><header><a href=/>Home</a></header><div class='cookie-notice'>We use cookies</div>"
        "<main><h1>Head line of it all</h1><p>First  para&shy;graph &lt;one&gt; with some words.</p><div class=ad>Buy</div><p>Second <i>one</i> with more words.<script>x('</p>')</script></p>"
        "<form><input>Sign</form><section id=comments><p>Nice</p></section></main><footer>foot</footer></body></html>"
    )
    assert extract.main_text(html, {}) == (
        "Head line of it all\n\nFirst para\xadgraph <one> with some words.\n\nSecond one with more words."
    )


def test_article_keeps_its_lists_and_links():
    links = "".join(f"<li><a href=/{i}>link{i}</a></li>" for i in range(20))
    page = "<html><body><nav><ul>{0}</ul></nav><article>{1}</article><footer><ul>{0}</ul></footer></body></html>"
    plain = page.format(links, "<h1>Title of it</h1><p>" + "some words " * 40 + "</p>")
    weights = extract.weights_of(extract.count_features([plain] * 5))
    assert not any("li" in f or f == "a" for _, f in weights)
    short = "<ul><li>one</li><li><a href=/x>two</a></li></ul>"
    middle = f"<ul>{links}</ul>"
    inner = f"{short}<h1>Title of it</h1><nav class=toc><ul>{links}</ul></nav><p>{'first half ' * 20}</p>{middle}<p>{'second half ' * 20}</p>{short}"
    blocks = extract.main_text(page.format(links, inner), weights).split("\n\n")
    want = ["one", "two", "Title of it", ("first half " * 20).strip(), *(f"link{i}" for i in range(20)), ("second half " * 20).strip(), "one", "two"]
    assert blocks == want
    # A contents list costs one tag, so that a short title before it stays also where no article is marked.
    unmarked = f"<body><h1>Title of it</h1><nav><ul>{links}</ul></nav><p>{'first half ' * 20}</p></body>"
    assert extract.main_text(unmarked, {}).split("\n\n")[0] == "Title of it"


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""


@pytest.mark.parametrize(
    "text, want",
    [
        (MIT, [(0, 0, "MIT"), (4, 6, "MIT")]),
        ("int x;\n\n" + GPL, [(2, 4, "GPL-3.0")]),
        (BSD, [(0, 2, "BSD-3-Clause")]),
        ("Distributed under the MIT License.", [(0, 0, "MIT")]),
        ("The code is made available to all\nunder the terms of the MIT\nlicense, as is.", [(1, 2, "MIT")]),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", [(0, 1, "GPL-3.0")]),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", [(0, 1, "GPL-2.0")]),
        ("Apache License\nVersion 2.0, January 2004", [(0, 1, "Apache-2.0")]),
        ("Made available under the Apache 2.0 license", [(0, 0, "Apache-2.0")]),
        ("This tool is free software under the GNU LGPL v3", [(0, 0, "LGPL-3.0")]),
        ("Under the terms of the new law we had a licence, version 3.", []),
        ("They spoke of the MIT License and other such names over a long lunch.", []),
        ("It is under the GNU General Public License.", []),
    ],
)
def test_wrapped_and_reworded_licences(text, want):
    scanner = licences.fit([[b"alpha", b"beta"], [b"the", b"house", b"of", b"the", b"sea"]] * 20)
    found = []
    blocks, at = text.split("\n\n"), 0
    for block in blocks:
        found += [(at + a, at + b, f) for a, b, f, _ in scanner.block([licences.words_of(x) for x in block.split("\n")])]
        at += block.count("\n") + 2
    assert found == want


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><article>{0}</article></body>",
        "<body class='sidebar'><main>{0}</main></body>",
        "<body><main class='content with-sidebar'>{0}</main></body>",
        "<body><article class='post comments-open'>{0}</article></body>",
        "<body><div id='search-results-page'>{0}</div></body>",
        "<body><div class='no-banner'>{0}</div></body>",
        "<body><div class='widget'>{0}</div></body>",
        "<body><form id=aspnet><label>Find</label><input name=q><button>Go</button><main>{0}</main></form></body>",
        "<body><form><select><option>one</option></select><div>{0}</div></form></body>",
        "<head><meta charset=utf-8><body><article>{0}</article><div class=comments><article class=comment><p>Nice one</p></article></div></body>",
        "<body><article>{0}<div class='site-footer'>foot</div><div class='ad-slot-3'>Buy</div></article><form>Find<input></form></body>",
    ],
)
def test_names_do_not_drop_the_content(page):
    content = "<h1>Title of it</h1><p>Some words of the first.</p><h2 id='related-work'>Related work</h2><p>And more of the second.</p>"
    want = "Title of it\n\nSome words of the first.\n\nRelated work\n\nAnd more of the second."
    assert extract.main_text(f"<html>{page.format(content)}</html>", {}) == want


def plain_lines(docs, window=3, words=50):
    """The definition of line dedup, run by run."""
    seen, out = {}, {}
    for doc, text in sorted(docs):
        rows = text.split("\n")
        at = [i for i, line in enumerate(rows) if line.strip(" ")]
        for k in range(len(at)):
            held = [rows[i] for i in at[k : k + window]]
            n = next((n for n in range(1, window) if sum(1 + x.count(" ") for x in held[:n]) >= words and n <= len(held)), window)
            key = tuple(held[:n])
            if len(key) == n and seen.setdefault(key, (doc, k)) != (doc, k):
                out.setdefault(doc, set()).update(range(at[k], at[k + n - 1] + 1))
    return {d: "\n".join(r for i, r in enumerate(t.split("\n")) if i not in out.get(d, ())) for d, t in docs}


def test_line_dedup_equals_definition(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    rng = random.Random(7)
    pool = [" ".join(f"l{i}w{j}" for j in range(rng.choice([1, 3, 20, 26, 60]))) for i in range(25)] + ["", " ", "same"]
    docs += [(10_000 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(150)]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == plain_lines(docs)


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    docs = table(spark, SF, "documents")
    kept = corpus_pipeline.keep_quality(spark, docs, SF).cache()
    scores = {r["doc_id"]: r["score"] for r in quality.quality_report(docs, table(spark, SF, "labels")).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, s in scores.items() if s >= 0.5}
    assert kept.columns == docs.columns

    cut = corpus_pipeline.dedup_lines(spark, kept, SF).cache()
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    want = {d: t for d, t in plain_lines(list(before.items())).items() if t == before[d] or t.strip(" \n")}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    single = corpus_pipeline.dedup_documents(spark, cut, SF).cache()
    found = minhash.brute_force([(d, t) for d, t in want.items()])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(d for d, v in found.items() if v[2])

    clean = corpus_pipeline.decontaminate_documents(spark, single, SF).cache()
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    hit = decontaminate.brute_force([(r["doc_id"], r["text"]) for r in single.collect()], items)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, v in hit.items() if not v[4])
    assert clean.columns == docs.columns

    rows = corpus_pipeline.pack(spark, clean, SF).collect()
    left = [(r["doc_id"], r["text"]) for r in clean.collect()]
    check_packing(rows, left, packing.encode_texts(TOKENIZER))
    # How rows lie in tasks decides which are cut, so a whole run may have other pieces of the same documents.
    check_packing(corpus_pipeline.run(spark, SF).collect(), left, packing.encode_texts(TOKENIZER))


def test_line_dedup_stays_in_the_engine(spark):
    plan = lines.dedup_report(table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow", "CartesianProduct"))


def test_a_filter_on_what_line_dedup_leaves_does_not_repeat_it(spark):
    plan = corpus_pipeline.dedup_lines(spark, table(spark, SF, "documents"), SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("flatten(") == 1

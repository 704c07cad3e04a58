"""Cases that every operator meets: nulls, empty and very long texts, ties, repeated rows, empty tables, other columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from litscreen.llm import decontaminate, extract, licences, lines, minhash, neighbours, packing, quality, repeats, toxicity

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
COPY = " ".join(f"copy{i}" for i in range(120))
ROWS = [
    (1, None, "a"), (2, "", "b"), (3, COPY, "c"), (4, COPY, "c"), (4, COPY, "c"), (None, COPY, None), (5, LONG, None), (6, "one two", "x"),
    (7, "a\nb\nc\nd", "x"), (8, "q\na\nb\nc", "x"), (9, "   \n\n ", "x"), (10, "line é ß \U0001f600\nzwei", "x"),
]
# Columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, source string"
CLASHES = {"score": 1, "version": 2, "spans": 3, "n_words": 4, "class": 5, "length": 6, "anchor": 7, "found": 8}
CLASHES |= {name: 9 for name in ("_lines", "_kept", "_at", "_spans", "_version", "_searched_text", "_v", "_id", "_way", "_ways", "row", "searched")}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(3, 1, 0), (5, 0, 1), (6, 1, 0), (9, None, None), (None, 1, 1), (12, 0, 0), (12, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, COPY[:300]), (2, None), (3, ""), (4, "ONE two"), (None, "zwei"), (4, "ONE two")], "item_id long, text string")


def test_lines(docs):
    got = {(r["doc_id"], r["n_lines"], r["n_removed"]) for r in lines.dedup_report(docs).collect()}
    assert (1, 0, 0) in got and (2, 1, 0) in got and (9, 3, 0) in got
    assert (7, 4, 0) in got and (8, 4, 3) in got
    assert (3, 1, 1) in got and (4, 1, 1) in got and (None, 1, 0) in got  # one line of many words is a run
    kept = lines.dedup_lines(docs)
    assert kept.count() == len(ROWS)
    assert kept.columns == [*docs.columns, "n_lines", "n_removed"]
    assert all(r[k] == v for r in kept.collect() for k, v in CLASHES.items())
    assert [r["text"] for r in kept.filter("doc_id = 8").collect()] == ["q"]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_lines_blank_lines_and_order(spark):
    rows = [(2, "x\n\ny\nz\nend"), (1, "x\ny\n \nz"), (3, "x\ny\nz\nx\ny\nz"), (3, "x\ny\nz\nx\ny\nz")]
    got = {(r["doc_id"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "x\ny\n \nz"), (2, "end"), (3, "")}


def test_lines_of_many_words(spark):
    long, half, other = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 60), ("b", 30), ("c", 30)))
    rows = [(1, f"start\n{long}\nx"), (2, f"{long}"), (3, f"p\n{half}\n{other}\nq"), (4, f"r\n{half}\n \n{other}\ns\n{half}"), (5, f"{long}\n\n{long}")]
    got = {(r["doc_id"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Blank lines go only inside a run; one short line, wherever it repeats, stays.
    assert got == {(1, rows[0][1]), (2, ""), (3, rows[2][1]), (4, f"r\ns\n{half}"), (5, "")}


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
    assert [r["doc_tokens"] for r in rows if r["doc_id"] == 1] == [1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 3)
    assert packing.pack_documents(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, path, capacity=1000)


def test_repeats(docs):
    rows = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.repeats_report(docs).collect()}
    assert (1, 0, 0) in rows and (2, 0, 0) in rows
    n = len(COPY)
    assert {(3, n, n), (4, n, n), (None, n, n)} <= rows
    assert repeats.repeats_report(docs.limit(0)).count() == 0


def test_repeated_row_alone_is_one_place(spark):
    rows = spark.createDataFrame([(1, COPY), (1, COPY)], "doc_id long, text string")
    assert [r["n_removed"] for r in repeats.repeats_report(rows).collect()] == [0, 0]


@pytest.mark.parametrize("most", [2000, 1])
def test_repeated_row_with_a_variant_is_one_place(spark, most):
    same = " ".join(f"same{i}" for i in range(30))
    texts = {None: f"{'left ' * 3}" + " ".join(f"l{i}" for i in range(200)) + same + " ".join(f"m{i}" for i in range(200))}
    texts[2] = " ".join(f"n{i}" for i in range(200)) + same + " ".join(f"o{i}" for i in range(200))
    rows = spark.createDataFrame([(None, texts[None])] * 2 + [(2, texts[2])], "doc_id long, text string")
    got = [tuple(r) for r in repeats.repeats_report(rows, most=most).collect()]
    want = repeats.brute_force(list(texts.items()))
    assert sorted(got, key=str) == sorted([(d, *want[d]) for d in (None, None, 2)], key=str)


@pytest.mark.parametrize("report", [quality.quality_report, toxicity.toxicity_report])
def test_scores(docs, labels, report):
    rows = report(docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert all(r["held_out"] is not None for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (3, 4)}
    assert len(same) == 1
    assert report(docs.limit(0), labels).count() == 0
    unlabelled = report(docs, labels.limit(0)).collect()
    assert len(unlabelled) == len(ROWS) and all(0 <= r["score"] <= 1 for r in unlabelled)


def test_licences(docs, spark):
    scanner = licences.fit([["alpha", "beta"]])
    assert licences.scan_licences(docs, scanner).count() == len(ROWS)
    text = "Intro\n\nReleased under the MIT License.\nunder the\nLicensed under CC BY-NC 4.0."
    found = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string"), scanner).first()
    assert found["n_paragraphs"] == 4
    assert [(f["paragraph"], f["family"]) for f in found["found"]] == [(2, "MIT"), (4, "CC-BY-NC-4.0")]
    assert licences.licence_report(docs.limit(0)).count() == 0


def test_contamination(docs, items):
    rows = decontaminate.contamination_report(decontaminate.find_benchmark(docs, items)).collect()
    got = {(r["doc_id"], r["n_words"], r["n_items"], r["contaminated"]) for r in rows}
    assert len(rows) == len(ROWS)
    assert (1, 0, 0, False) in got and (6, 2, 1, True) in got and (3, 120, 1, True) in got
    assert (10, 5, 0, True) in got  # a window of an item without id counts, but names none
    parts = decontaminate.contamination_report(decontaminate.find_benchmark(docs, items, max_windows=3)).collect()
    assert sorted(map(str, parts)) == sorted(map(str, rows))
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert all(r[k] == v for r in left.collect() for k, v in CLASHES.items())
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 5, 7, 8, 9]
    assert decontaminate.find_benchmark(docs, items.limit(0)).filter("size(spans) > 0").count() == 0


def test_parts_are_bounded_by_bytes_and_released(spark, monkeypatch):
    from pyspark import Broadcast

    held, most = [], []
    destroy, sent = Broadcast.destroy, decontaminate._sent
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (held.remove(self), destroy(self, *a))[1])
    monkeypatch.setattr(decontaminate, "_sent", lambda windows: (held.append(sent(windows)), most.append(len(held)), held[-1])[2])
    items = [(f"i{k}", " ".join("x" * 500 + f"{k}y{j}" for j in range(12))) for k in range(4)]
    docs = [(k, f"before {text} after") for k, (_, text) in enumerate(items)] + [(9, "none of it"), (None, None)]
    texts, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: ([tuple(s) for s in r["spans"]], r["items"]) for r in decontaminate.find_benchmark(texts, bench, max_bytes=20_000).collect()}
    assert got == {**{k: ([(1, 13)], [f"i{k}"]) for k in range(4)}, 9: ([], []), None: ([], [])}
    assert len(most) > 2 and set(most) == {1} and not held
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(texts, bench, max_bytes=20_000).collect()} == {9, None}
    assert set(most) == {1} and not held


def test_neighbours_edges(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]),
        (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0]), (10, [1.0, 2.0, 3.0]), (50, [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("old"))
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [
        (0, 1, 1, 1.0), (0, 2, 3, 1.0), (0, 3, 50, 1.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 3, 1.0),
    ]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") >= 0).count() == 0


def test_near_duplicates(docs):
    rows = minhash.near_duplicates(docs).collect()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == len(ROWS)
    assert {(1, 0, 1, True), (2, 0, 2, True), (9, 0, 9, True), (6, 1, 6, True)} <= got
    assert {(3, 116, 3, True), (4, 116, 3, False), (None, 116, 3, False)} <= got
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_pages(spark):
    pages = [
        (1, None, "u"), (2, "", "u"), (3, "just words &amp; more", None), (4, "<p>open <b>bold", "u"), (None, "<nav>menu</nav><p>body text here</p>", "u"),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string, url string").withColumn("text", F.lit("old"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract.extract_text(df).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("just words & more", 17), 4: ("open bold", 9), None: ("body text here", 14)}
    assert extract.extract_text(df.limit(0)).count() == 0


def test_licence_negatives_count_repeats_once(spark):
    rows = [(i, "Same text.") for i in range(50)] + [(99, "Other text.\nAll rights reserved."), (100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(licences.negatives(docs, 60)) == [[b"other", b"text"], [b"same", b"text"]]
    assert len(licences.negatives(spark.range(5000).selectExpr("concat('line ', id) AS text"), 40)) == 40
    assert licences.negatives(docs.limit(0)) == []


def test_pipeline_stages(docs, labels, items, spark, tmp_path):
    import corpus_pipeline

    for name, df in (("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for function in (f for _, f in corpus_pipeline.STAGES[:-1]):
        left = function(spark, docs, str(tmp_path))
        assert left.columns == docs.columns
        assert all(r[k] == v for r in left.collect() for k, v in CLASHES.items())
        assert function(spark, docs.limit(0), str(tmp_path)).count() == 0

from litscreen.functions import scale
from litscreen.operators import results
from litscreen.spec import InputItem, InputParameter, OutputFeature, ReviewSpec

SPEC = ReviewSpec(
    question="{drug}", goal="g", inputs=[InputParameter("drug", [InputItem("a")], 20)], features=[OutputFeature("n", "int")]
)
KEYS = SPEC.keys


def rows(spark, *values):
    data = [(p, "PUBMED", "{}", d, n, i) for i, (d, p, n) in enumerate(values)]
    return spark.createDataFrame(data, "pubmed_id string, format string, sections string, drug string, n long, seq int")


def content(spark, table):
    return sorted((r["id"], r["drug"], r["pubmed_id"], r["n"]) for r in results.read_results(spark, table).collect())


def test_create_is_repeatable_and_reset_empties(spark):
    results.create_result_table(spark, "made", SPEC, 4)
    results.write_results(spark, "made", rows(spark, ("a", "1", 1)), SPEC, "seq")
    results.create_result_table(spark, "made", SPEC, 4)
    assert content(spark, "made") == [(1, "a", "1", 1)]
    assert spark.table("made").columns == ["id", "pubmed_id", "format", "sections", "drug", "n", "key_bucket"]
    results.reset_result_table(spark, "made", SPEC, 4)
    assert content(spark, "made") == []


def test_writes_keep_keys_unique_and_ids_stable(spark):
    results.reset_result_table(spark, "kept", SPEC, 4)
    first = rows(spark, ("b", "2", 20), ("a", "1", 10), ("a", "2", 12), ("a", "1", 11))
    written = results.write_results(spark, "kept", first, SPEC, "seq")
    expected = [(1, "a", "1", 10), (2, "a", "2", 12), (3, "b", "2", 20)]
    assert content(spark, "kept") == expected
    assert sorted(r["id"] for r in written.collect()) == [1, 2, 3]
    # The same rows again, and again: nothing changes.
    assert results.write_results(spark, "kept", first, SPEC, "seq").count() == 0
    assert content(spark, "kept") == expected
    # Overwriting keeps ids, takes the last of a key, and appends what is new.
    second = rows(spark, ("a", "1", 100), ("a", "1", 101), ("c", "9", 90))
    for _ in range(2):
        written = results.write_results(spark, "kept", second, SPEC, "seq", overwrite=True)
        assert content(spark, "kept") == [(1, "a", "1", 101), (2, "a", "2", 12), (3, "b", "2", 20), (4, "c", "9", 90)]
    assert sorted((r["id"], r["is_new"]) for r in written.collect()) == [(1, False), (4, False)]
    assert results.write_results(spark, "kept", second.limit(0), SPEC, "seq").count() == 0


def test_lowest_id_of_duplicates_is_found_and_updated(spark):
    stored = spark.createDataFrame([(7, "a", "1", 1), (3, "a", "1", 2), (9, "b", "1", 3)], "id long, drug string, pubmed_id string, n long")
    pairs = spark.createDataFrame([("a", "1"), ("c", "1")], "drug string, pubmed_id string")
    found = {r["drug"]: r["id"] for r in results.find_existing(pairs, stored, KEYS).collect()}
    assert found == {"a": 3, "c": None}
    incoming = spark.createDataFrame([("a", "1", 50, 0)], "drug string, pubmed_id string, n long, seq int")
    after = results.upsert_results(stored, incoming, KEYS, "seq", overwrite=True).collect()
    assert sorted((r["id"], r["n"]) for r in after) == [(3, 50), (7, 1), (9, 3)]


def test_pending_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(scale, "fits_broadcast", lambda *_: False)
    stored = spark.createDataFrame([("a", "1"), ("a", "1")], "drug string, pubmed_id string")
    pairs = spark.createDataFrame([("a", "1"), ("a", "2")], "drug string, pubmed_id string")
    assert [tuple(r) for r in results.pending_extractions(pairs, stored, KEYS).collect()] == [("a", "2")]
    assert results.pending_extractions(pairs, stored, KEYS, overwrite=True).count() == 2


def test_ids_are_dense_and_ordered_over_many_partitions(spark):
    new = spark.range(5_000).selectExpr("format_string('%05d', (id * 7919) % 5000) AS pubmed_id", "'a' AS drug")
    stored = spark.createDataFrame([(41,)], "id long")
    out = results.assign_record_ids(new.repartition(16), stored, ["drug", "pubmed_id"]).collect()
    assert sorted((r["id"], r["pubmed_id"]) for r in out) == [(42 + i, f"{i:05d}") for i in range(5_000)]


def test_one_key_holding_most_rows(spark):
    incoming = spark.range(30_000).selectExpr(
        "'a' AS drug", "IF(id % 3 = 0, CAST(id AS string), 'hot') AS pubmed_id", "id AS n", "id AS seq"
    )
    one = results.one_per_key(incoming, KEYS, "seq", overwrite=False)
    assert one.count() == 10_001
    assert one.filter("pubmed_id = 'hot'").first()["n"] == 1
    last = results.one_per_key(incoming, KEYS, "seq", overwrite=True)
    assert last.filter("pubmed_id = 'hot'").first()["n"] == 29_999


def test_nested_columns_become_json(spark):
    df = spark.createDataFrame([([1, 2], {"k": "é"}, 5, None)], "l array<int>, m map<string,string>, n int, e array<int>")
    assert tuple(results.serialise_record(df).first()) == ("[1,2]", '{"k":"é"}', 5, None)


def test_rows_at_a_location_survive_the_catalog_and_reset_stays_there(spark, tmp_path):
    place = str(tmp_path / "table")
    results.create_result_table(spark, "first_name", SPEC, 4, place)
    results.write_results(spark, "first_name", rows(spark, ("a", "1", 1), ("b", "2", 2)), SPEC, "seq")
    results.create_result_table(spark, "second_name", SPEC, 4, place)  # as after a restart without a metastore
    assert [r[1:] for r in content(spark, "second_name")] == [("a", "1", 1), ("b", "2", 2)]
    added = results.write_results(spark, "second_name", rows(spark, ("a", "1", 1)), SPEC, "seq")
    assert added.count() == 0
    results.reset_result_table(spark, "second_name", SPEC, 4)
    assert content(spark, "second_name") == []
    results.write_results(spark, "second_name", rows(spark, ("c", "3", 3)), SPEC, "seq")
    assert spark.read.parquet(place).select("drug").collect()[0][0] == "c"


def test_only_buckets_of_the_pairs_are_read(spark):
    results.create_result_table(spark, "near", SPEC, 64)
    results.write_results(spark, "near", rows(spark, *[("a", str(i), i) for i in range(200)]), SPEC, "seq")
    near = results.results_near(spark, "near", rows(spark, ("a", "7", 7)), KEYS)
    assert "7" in [r["pubmed_id"] for r in near.collect()] and near.count() < 30


def test_ids_come_from_the_mark_and_are_never_given_twice(spark, monkeypatch):
    results.reset_result_table(spark, "marked", SPEC, 4)
    results.write_results(spark, "marked", rows(spark, ("a", "1", 1), ("b", "1", 2)), SPEC, "seq")

    def unread(*_):
        raise AssertionError("the stored ids were looked up")

    with monkeypatch.context() as m:
        m.setattr(results, "_largest_id", unread)
        results.write_results(spark, "marked", rows(spark, ("c", "1", 3)), SPEC, "seq")
        # A write that fails after it took its ids: they are lost, not given again.
        assert results.claim_ids(spark, "marked", 5) == 4
        results.write_results(spark, "marked", rows(spark, ("d", "1", 4), ("a", "1", 9)), SPEC, "seq")
    assert content(spark, "marked") == [(1, "a", "1", 1), (2, "b", "1", 2), (3, "c", "1", 3), (9, "d", "1", 4)]


def test_a_table_attached_with_its_rows_goes_on_from_the_largest_id(spark):
    where = scale.stage_path(spark, "attached")
    results.create_result_table(spark, "attached", SPEC, 4, where)
    results.write_results(spark, "attached", rows(spark, ("a", "1", 1), ("b", "1", 2)), SPEC, "seq")
    spark.sql("DROP TABLE attached")
    results.create_result_table(spark, "attached", SPEC, 4, where)
    results.write_results(spark, "attached", rows(spark, ("c", "1", 3)), SPEC, "seq")
    assert content(spark, "attached") == [(1, "a", "1", 1), (2, "b", "1", 2), (3, "c", "1", 3)]


def n_files(spark, table):
    place = results._location(spark, table)
    return [len(scale.file_sizes(spark, f"{place}/{results.BUCKET}={b}")) for b in range(results._n_buckets(spark, table))]


def test_many_small_writes_leave_few_files(spark, monkeypatch):
    results.reset_result_table(spark, "scattered", SPEC, 2)
    monkeypatch.setattr(results, "MAX_SMALL_FILES", 3)
    for i in range(12):
        results.write_results(spark, "scattered", rows(spark, ("a", str(i), i), ("b", str(i), i)), SPEC, "seq")
        assert max(n_files(spark, "scattered")) <= 3
    kept = content(spark, "scattered")
    assert sorted(r[0] for r in kept) == list(range(1, 25))
    assert sorted(r[1:] for r in kept) == sorted((d, str(i), i) for i in range(12) for d in "ab")
    assert results.compact_results(spark, "scattered") == []
    held = [b for b, n in enumerate(n_files(spark, "scattered")) if n > 1]
    assert results.compact_results(spark, "scattered", max_small_files=1) == held
    assert max(n_files(spark, "scattered")) == 1 and content(spark, "scattered") == kept


def test_compaction_leaves_other_buckets_and_empty_tables(spark):
    results.reset_result_table(spark, "calm", SPEC, 4)
    assert results.compact_results(spark, "calm", max_small_files=0) == []
    results.write_results(spark, "calm", rows(spark, *[("a", str(i), i) for i in range(40)]), SPEC, "seq")
    before = content(spark, "calm")
    assert results.compact_results(spark, "calm", [1], max_small_files=0) == [1]
    assert content(spark, "calm") == before


def test_a_bucket_of_large_files_is_rewritten_for_as_many_small_ones():
    large, small = results.SMALL_FILE_BYTES, 10
    assert not results._is_scattered([small] * 8, 8)
    assert results._is_scattered([small] * 9, 8)
    assert not results._is_scattered([large] * 20 + [small] * 20, 8)
    assert results._is_scattered([large] * 20 + [small] * 21, 8)

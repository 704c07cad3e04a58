"""Full texts that land after their abstracts."""

from datetime import datetime, timedelta

import pytest

from litscreen.functions.scale import stage_path
from litscreen.sources.articles import ARTICLES
from litscreen.streaming.resolve import stream_resolved

START = datetime(2024, 1, 1)
LANDED = f"{', '.join(f.name + ' ' + f.dataType.simpleString() for f in ARTICLES.fields)}, landed_at timestamp, extra string"


def article(number, day, sections, text="a", doi=None):
    return (number, doi, [text], [("", f"part {i}") for i in range(sections)], START + timedelta(days=day), "x")


@pytest.fixture
def land(spark):
    """A folder per stream; each call adds a file and runs what is new through the join, with the state kept."""
    brief, full, out, state = (stage_path(spark, n) for n in ("brief", "full", "out", "state"))

    def run(abstracts=(), full_texts=(), pdf=None):
        for path, rows in ((brief, abstracts), (full, full_texts)):
            spark.createDataFrame(list(rows), LANDED).coalesce(1).write.mode("append").parquet(path)
        streams = [spark.readStream.schema(LANDED).parquet(path) for path in (brief, full)]
        joined = stream_resolved(*streams, pdf, wait="7 days", lateness="1 day")
        writer = joined.writeStream.format("parquet").option("checkpointLocation", state)
        query = writer.trigger(availableNow=True).start(out)
        query.awaitTermination()
        assert query.exception() is None
        rows = spark.read.schema(joined.schema).parquet(out).collect()
        return sorted((r["article_id"], r["format"], r["abstract"][0], len(r["sections"])) for r in rows if r["article_id"] < 90)

    return run


def test_late_full_text_counts_and_a_missing_one_is_not_waited_for_forever(land):
    first = [article(1, 0, 0), article(2, 0, 0), article(4, 0, 0), (None, None, ["no id"], [], START, "x"),
             (6, None, ["no time"], [], None, "x"), (7, None, None, None, START, "x"), (8, None, [], [], START, "x")]
    assert land(first) == []
    whole = (1, "PMC", "full", 9)
    # the full text of 1 lands three days later; that of 2 has too few sections; 3 has no abstract of its own
    assert land([article(5, 3, 0)], [article(1, 3, 9, "full"), article(2, 3, 1, "short"), article(3, 3, 9, "full")]) == [whole]
    later = [whole, (2, "PUBMED", "a", 0), (3, "PMC", "full", 9), (4, "PUBMED", "a", 0), (5, "PUBMED", "a", 0)]
    assert land([article(98, 30, 0)], [article(99, 30, 9)]) == later
    # beyond the wait the full text is a second row
    assert land([article(97, 60, 0)], [article(4, 31, 9, "full"), article(96, 60, 9)]) == later[:3] + [(4, "PMC", "full", 9)] + later[3:]


def test_pdf_text_of_known_articles(spark, land, make_articles):
    pdf = make_articles({1: (["p"], ["x", "y"]), 2: (["p"], ["x", "y"]), 3: (["p"], [])})
    first = [article(1, 0, 0, doi="10.1/1"), article(2, 0, 0), article(3, 0, 0, doi="10.1/3"), article(95, 40, 0)]
    assert land(first, [article(94, 40, 9)], pdf) == [(1, "PUBMED | PDF", "a", 2), (2, "PUBMED", "a", 0), (3, "PUBMED", "a", 0)]


def test_files_that_land_grow_with_the_table(spark, tmp_path):
    """A file holds about what one task reads of the table, and as many land at once as make up a third."""
    from checks import queries

    rows = spark.range(0, 100, 1, 10).selectExpr("id AS article_id")
    assert [queries._at_once(rows.coalesce(n)) for n in (1, 3, 4, 10)] == [1, 1, 2, 4]
    path = queries._landed(rows, 4)
    assert len(spark.read.parquet(path).inputFiles()) == 12

"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder with the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` (comma separated) a choice
of queries. The session is warmed up on the first query; then every query runs once, all of its rows being produced.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import queries as q  # noqa: E402
from litscreen.functions.scale import stage  # noqa: E402
from litscreen.operators import ranking  # noqa: E402

HEADLINE = (
    "search_corpus", "section_term_stats", "bm25_scores", "top_sections", "top_sections_stemmed", "label_sections",
    "build_prompts", "run_extractor", "parse_responses", "sections_from_markup", "resolve_articles", "format_question",
    "find_existing", "assign_record_ids", "upsert_results_overwrite", "result_table", "stream_screen",
)


def rank_every_document(spark: SparkSession, sf: str) -> DataFrame:
    """The measurement of the baseline: the first ten questions against every document, top five sections each."""
    docs = stage(q.documents(spark, sf), "articles")
    questions = q.questions(spark, sf).filter("question_id < 10")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("question_id")
    pairs = docs.select("article_id", numbers)
    return ranking.rank_sections(pairs, docs, questions, 5, stem=False)


def session() -> SparkSession:
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("litscreen-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = {name: q.QUERIES[name] for name in HEADLINE} | {"rank_10_questions_every_document": rank_every_document}
    chosen = os.environ.get("BENCH_QUERIES")
    if chosen:
        runs = {name: runs[name] for name in chosen.split(",")}
    spark = session()
    next(iter(runs.values()))(spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name, query in runs.items():
        start = time.perf_counter()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()

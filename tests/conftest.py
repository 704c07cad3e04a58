import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(scratch / "shared"))
        .config("spark.sql.warehouse.dir", str(scratch / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_articles(spark):
    """Articles from ``{id: ([abstract paragraphs], [section texts])}``."""
    from litscreen.sources.articles import ARTICLES

    def make(texts, doi=None):
        rows = [(i, doi, list(a), [("", t) for t in s]) for i, (a, s) in texts.items()]
        return spark.createDataFrame(rows, ARTICLES)

    return make

"""Line deduplication by winnowing over line hashes. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.functions.scale import once, stage
from litscreen.llm.common import rows_apart, rows_together, split_join

WINDOW = 3  # lines of a run that counts, however short they are
WORDS = 50  # a run of fewer lines counts with so many words

ORACLE = f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, generate_subscripts(lines, 1) - 1 AS i, unnest(lines) AS line FROM cut),
solid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, 1 + strlen(line) - strlen(replace(line, ' ', '')) AS words
  FROM line WHERE trim(line) <> ''
),
ahead AS (
  SELECT doc_id, k, i AS first_i, line AS l1, words AS w1, lead(line, 1) OVER w AS l2, lead(words, 1) OVER w AS w2,
    lead(i, 1) OVER w AS i2, lead(line, 2) OVER w AS l3, lead(i, 2) OVER w AS i3
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY k)
),
win AS (
  SELECT doc_id, k, first_i, CASE WHEN w1 >= {WORDS} THEN first_i WHEN w1 + w2 >= {WORDS} THEN i2 ELSE i3 END AS last_i,
    CASE WHEN w1 >= {WORDS} THEN [l1] WHEN w1 + w2 >= {WORDS} THEN [l1, l2] ELSE [l1, l2, l3] END AS run
  FROM ahead
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS nth FROM win WHERE last_i IS NOT NULL
),
gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM line l JOIN ranked r ON l.doc_id = r.doc_id AND r.nth > 1 AND l.i BETWEEN r.first_i AND r.last_i
),
left_over AS (
  SELECT l.doc_id, count(*) AS kept, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM line l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT c.doc_id, coalesce(len(c.lines), 0) AS n_lines, coalesce(len(c.lines) - coalesce(o.kept, 0), 0) AS n_removed,
  CASE WHEN c.lines IS NOT NULL THEN md5(coalesce(o.text, '')) END AS kept_md5
FROM cut c LEFT JOIN left_over o ON c.doc_id = o.doc_id
"""


def _fingerprints(docs: DataFrame, window: int, words: int) -> DataFrame:
    """``print, doc_id, version, at, runs``: a row for each selected minimum, with the runs it is the fingerprint of.

    At each solid line a run starts: the fewest lines, up to ``window``, that hold ``words`` words, or ``window`` lines. Its
    fingerprint is its smallest hash, the last of equal ones, so equal runs have equal fingerprints at the same place in
    them; neighbouring runs mostly share one. Around a selected line are kept the lines that its runs can reach.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    n_words = lambda x: F.lit(1) + F.octet_length(x) - F.octet_length(F.translate(x, " ", ""))
    hashed = docs.select("doc_id", "version", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), n_words(x).alias("w"))).alias("l"))
    reach = F.lit(window - 1)

    def around(x: Column, i: Column) -> Column:
        back = F.least(i, reach)
        return F.struct(x["h"].alias("print"), i.alias("at"), back.alias("back"), F.slice("l", i - back + 1, back + window).alias("near"))

    rows = hashed.select("doc_id", "version", F.explode(F.transform("l", around)).alias("p")).select("doc_id", "version", "p.*")
    hashes = F.transform("near", lambda x: x["h"])

    def run(lead: int) -> Column:
        """The run that starts ``lead`` lines before this one, if this line is its fingerprint."""
        start = F.col("back") - lead
        lengths = F.lit(None).cast("int")
        for n in reversed(range(1, window + 1)):
            held = sum((F.get("near", start + j)["w"] for j in range(1, n)), F.get("near", start)["w"])
            enough = (held >= words) if n < window else F.col("near").isNotNull()
            lengths = F.when((start + n <= F.size("near")) & enough, n).otherwise(lengths)
        lines = F.slice("h", start + 1, lengths)
        own = (start >= 0) & (lengths > lead) & (F.array_min(lines) == F.col("print"))
        last = F.array_position(F.reverse(lines), F.col("print")) == lengths - lead
        return F.when(own & last, F.struct((F.col("at") - lead).alias("start"), lines.alias("lines")))

    runs = F.filter(F.array(*[F.when(F.col("back") >= lead, run(lead)) for lead in range(window)]), lambda r: r.isNotNull())
    found = rows.withColumn("h", hashes).select("print", "doc_id", "version", "at", runs.alias("runs"))
    return found.filter(F.size("runs") > 0)


def repeated_runs(docs: DataFrame, window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """``doc_id, version, spans``: for each document with repeats, the runs of its solid lines that occurred earlier.

    Fingerprints that stand at one place only end here. The places of each other one are joined with the first place that
    has the same lines around it: from the fingerprint the match is extended line by line, back and ahead, to the ends of
    the run. First places are found by a partial minimum, so a line or passage that a third of all documents hold is folded
    before it is shuffled, and its places are dealt over many tasks for the joins; no pairs of later places are listed.
    Matches that overlap in a document make up one longer run.
    """
    prints = stage(_fingerprints(docs, window, words), "prints")
    place = F.struct("doc_id", "version", "at")
    twice = prints.groupBy("print").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.count(F.lit(1)).alias("n"))
    twice = stage(twice.filter("NOT p <=> q").select("print", "n"), "prints")
    some = split_join(prints, twice, ["print"], "n", ["doc_id", "version", "at"])
    found = stage(some.select("doc_id", "version", F.explode("runs").alias("r")).select("doc_id", "version", "r.*"), "runs")
    where = F.struct("doc_id", "version", "start")
    first = found.groupBy("lines").agg(F.min(where).alias("first"), F.max(where).alias("last"), F.count(F.lit(1)).alias("n"))
    first = stage(first.filter("NOT first <=> last").select("lines", "first", "n"), "runs")
    pairs = split_join(found, first, ["lines"], "n", ["doc_id", "version", "start"])
    later = pairs.filter(~where.eqNullSafe(F.col("first"))).select("doc_id", "version", F.struct("start", (F.col("start") + F.size("lines") - 1).alias("end")).alias("run"))
    # A run that starts later never ends earlier, so the one before tells whether a run overlaps with what precedes it.
    runs = later.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("run")).alias("s"))
    opens = F.filter("s", lambda x, i: (i == 0) | (x["start"] > F.get("s", i - 1)["end"]))
    closes = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (F.get("s", i + 1)["start"] > x["end"]))
    spans = F.zip_with(opens, closes, lambda a, b: F.struct(a["start"].alias("open"), b["end"].alias("close")))
    return runs.select("doc_id", "version", spans.alias("spans"))


def _kept(lines: Column, spans: Column) -> Column:
    """The lines outside the spans, which are ascending pairs of first and last line number."""

    def piece(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["close"] + 1)
        end = F.when(i == F.size(spans), F.size(lines)).otherwise(F.get(spans, i)["open"])
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), piece))


def dedup_lines(
    docs: DataFrame, window: int = WINDOW, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Delete later repeats of runs of ``window`` lines, or of fewer that hold ``words`` words; add ``n_lines``, ``n_removed``.

    A run of consecutive lines is a later repeat if an equal one starts at a smaller (id, place); ids are compared first,
    null ids being smallest. Words are parted by single spaces. Blank lines (empty or spaces) don't count in runs; those
    inside a deleted run go with it, all others stay. Shorter texts are left alone. A null text stays null with 0 lines, an
    empty one has one empty line. Rows that share an id are ordered by a hash of their text; repeated rows are one
    document, not repeats of each other. An empty table gives no rows. All other columns are kept, whatever their names,
    but for older ``n_lines`` and ``n_removed``.
    """
    docs = docs.drop("n_lines", "n_removed")
    base = rows_apart(docs, id_col, text_col)
    found = repeated_runs(base.select("doc_id", "version", "text"), window, words)
    runs = found.select(F.col("doc_id").alias("id"), F.col("version").alias("v"), "spans")
    out = base.join(runs, base["doc_id"].eqNullSafe(runs["id"]) & (base["version"] == runs["v"]), "left")
    out = out.select("row", "spans", F.split("text", "\n").alias("lines"))
    solid = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: F.trim(p["x"]) != "")
    out = out.withColumn("at", F.when(F.col("spans").isNotNull(), F.transform(solid, lambda p: p["i"])))
    spans = F.transform("spans", lambda s: F.struct(F.get("at", s["open"]).alias("open"), F.get("at", s["close"]).alias("close")))
    out = out.withColumn("spans", spans)
    # Worked out once: a caller's filter on the text or the counts would otherwise repeat it.
    kept = F.when(F.col("spans").isNull(), F.col("lines")).otherwise(_kept(F.col("lines"), F.col("spans")))
    out = out.select("row", "lines", once(kept).alias("kept"))
    n = F.size("lines")
    return out.select(
        *rows_together(docs, F.array_join("kept", "\n"), text_col),
        F.when(F.col("lines").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(n - F.size("kept")).cast("long").alias("n_removed"),
    )


def dedup_report(docs: DataFrame, window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_md5`` for every document."""
    cut = dedup_lines(docs.select("doc_id", "text"), window, words)
    return cut.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))

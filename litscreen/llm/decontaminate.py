"""Benchmark decontamination by multi-pattern search with shift tables over words (Wu and Manber)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.functions.scale import stage
from litscreen.llm.common import keyed_text, map_texts, rows_apart, rows_together

# Lower-cases A-Z and turns every byte that is no part of a word into a space; bytes of 0x80 and above belong to words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The patterns sent to the tasks at a time: so many windows of ten words take some tens of megabytes there.
MAX_WINDOWS = 100_000
MAX_BYTES = 16_000_000  # of the words and item ids of a part


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def benchmark_windows(
    benchmark: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """The distinct windows of all items: ``words`` (array of words) and ``items`` (ids of the items that hold it).

    An item shorter than ``window`` is one window; an item without words, a null text included, has none. Repeated items
    are one item. Windows of a null ``item_id`` are searched for too; they have an empty list of items.
    """
    words = F.expr(f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD_PATTERN}', 0)".replace("\\", "\\\\"))
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).select("item_id", words.alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        rows.filter(F.size("w") > 0)
        .select("item_id", "w", F.explode(starts).alias("s"))
        .groupBy(F.slice("w", F.col("s"), window).alias("words"))
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )


class Searcher:
    """Finds all patterns of one length. The last words of a window decide how far the search may move on."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], tuple]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            by_prefix = self.buckets.setdefault(pattern[length - self.block :], {})
            by_prefix.setdefault(pattern[: self.block], []).append((pattern, items))

    def find(self, words: list[bytes]):
        """Yield (start, items) of every occurrence, starts ascending."""
        length, block, far, shift, buckets = self.length, self.block, self.far, self.shift, self.buckets
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            step = shift.get(key, far)
            if step:
                end += step
                continue
            start = end - length
            same_prefix = buckets[key].get(tuple(words[start : start + block]), ())
            if same_prefix:
                found = tuple(words[start:end])
                for pattern, items in same_prefix:
                    if pattern == found:
                        yield start, items
            end += 1


def searchers(windows: list[tuple[list[bytes], list[str]]]) -> list[Searcher]:
    """One search per length: short items would otherwise take the shifts of all others away."""
    by_length: dict[int, dict] = {}
    for words, items in windows:
        by_length.setdefault(len(words), {})[tuple(words)] = tuple(items)
    return [Searcher(n, patterns) for n, patterns in sorted(by_length.items())]


def scan(searches: list[Searcher], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """The maximal runs of hit words as (start, end), and the items that occur."""
    spans, items = [], set()
    for search in searches:
        for start, found in search.find(words):
            items.update(found)
            spans.append((start, start + search.length))
    spans.sort()
    runs: list[list[int]] = []
    for start, end in spans:
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(a, b) for a, b in runs], items


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    max_windows: int = MAX_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items``; spans are the maximal runs of hit words.

    Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased. A null text has no
    words, and no document is left out. Null ids stay null, repeated rows give repeated results, an empty benchmark finds
    nothing, and extra columns play no part. Documents are searched where they are read: nothing is shuffled. Up to
    ``max_windows`` windows of ``max_bytes`` in all are counted and sent to the tasks; a larger benchmark is searched in
    several parts of about that size. The result of each is stored and its windows released before the next is read, and
    the parts of a document are put together by one grouping on a key that is unique to the row.
    """
    windows = benchmark_windows(benchmark, window, item_col)
    parts = _parts(windows, max_windows, max_bytes)
    texts = keyed_text(docs, id_col, text_col)
    if parts == 1:
        return _search(texts, _sent(windows))
    # Stored, so that every part sees the same number for a row, whatever order the rows are read in.
    texts = stage(texts.withColumn("row", F.monotonically_increasing_id()), "benchmark-rows")
    found = None
    for part in range(parts):
        sent = _sent(windows.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == part))
        one = stage(_search(texts, sent), "benchmark-part")
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    grouped = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(hit)))).alias("h"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    starts = F.filter("h", lambda x, i: (i == 0) | (F.get("h", i - 1) < x - 1))
    ends = F.filter("h", lambda x, i: (i == F.size("h") - 1) | (F.get("h", i + 1) > x + 1))
    spans = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    return grouped.select("doc_id", "n_words", spans.alias("spans"), "items")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_windows: int = MAX_WINDOWS, text_col: str = "text",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs. Nothing is shuffled.

    Nulls, repeated rows and empty tables are treated as by ``find_benchmark``; a benchmark of more than ``max_windows``
    windows, or of ``max_bytes``, is searched in parts, one after another, and what a part finds isn't searched again:
    what it leaves is stored, and its windows are released.
    """
    windows = benchmark_windows(benchmark, window)
    parts = _parts(windows, max_windows, max_bytes)
    left = rows_apart(docs, docs.columns[0], text_col).select("row", "text")
    for part in range(parts):
        sent = _sent(windows.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == part))
        rows = left.withColumn("searched", F.col("text"))
        found = map_texts(rows, "searched", "spans array<struct<start: long, end: long>>", _maker(sent, ["spans"]))
        left = found.filter(F.size("spans") == 0).drop("spans")
        if parts > 1:
            left = stage(left, "benchmark-part")
            sent.destroy()
    return left.select(*rows_together(docs, F.col("text"), text_col))


def _collected(windows: DataFrame) -> list[tuple[list[bytes], list[str]]]:
    return [([w.encode("utf-8", "surrogatepass") for w in r["words"]], r["items"]) for r in windows.toLocalIterator()]


def _parts(windows: DataFrame, max_windows: int, max_bytes: int) -> int:
    size = F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " "))
    got = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return max(1, -(-got["n"] // max_windows), -(-got["bytes"] // max_bytes))


def _sent(windows: DataFrame) -> Broadcast:
    """The windows, sent to all tasks once."""
    return windows.sparkSession.sparkContext.broadcast(_collected(windows))


def _search(texts: DataFrame, sent: Broadcast) -> DataFrame:
    schema = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    return map_texts(texts, "text", schema, _maker(sent, ["n_words", "spans", "items"]))


def _maker(sent: Broadcast, columns: list[str], prefix: str = "") -> Callable[[], Callable]:
    """What a task does with the windows."""

    def make() -> Callable[[list[str | None]], dict[str, list]]:
        searches = searchers(sent.value)

        def work(batch: list[str | None]) -> dict[str, list]:
            out: dict[str, list] = {"n_words": [], "spans": [], "items": []}
            for text in batch:
                words = words_of(text)
                runs, items = scan(searches, words)
                out["n_words"].append(len(words))
                out["spans"].append([{"start": a, "end": b} for a, b in runs])
                out["items"].append(sorted(items))
            return {prefix + c: out[c] for c in columns}

        return work

    return make


def contamination_report(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items for each document of ``find_benchmark``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = 10) -> dict:
    """The definition, word by word: for tests."""
    out = {}
    grams: dict[tuple, set] = {}
    for item, text in items:
        w = words_of(text)
        for s in range(max(len(w) - window + 1, min(1, len(w)))):
            grams.setdefault(tuple(w[s : s + window]), set()).add(str(item))
    lengths = {len(g) for g in grams}
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in grams:
                    hit.update(range(s, s + n))
                    found |= grams[g]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit))
    return out

"""Near-duplicate documents by MinHash with tensored tables, verified on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.functions.scale import stage
from litscreen.llm.common import giving_back, keyed_text, map_texts, ship_package, text_version
from litscreen.llm.graph import components, follow

SHINGLE = 5
# Two collections of so many hash tuples, of so many minimum hashes each. All pairs of a left and a right tuple are table
# keys: 100 tables of four hashes from 40 minimum hashes. Documents of similarity s share a table with probability
# (1 - (1 - s^2)^10)^2, which is 0.9994 at 0.75.
TUPLES, ROWS = 10, 2
BLOCK = 256  # documents of a side that are compared in one task at a time
CHUNK = 1 << 20

LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_RANDOM = np.random.default_rng(20)
LETTERS = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACES = _RANDOM.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
TIMES = _RANDOM.integers(1, 1 << 63, (2 * TUPLES * ROWS, 1), dtype=np.uint64) | np.uint64(1)
PLUS = _RANDOM.integers(1, 1 << 63, (2 * TUPLES * ROWS, 1), dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all of them (the finalizer of a public hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = _powers(BASE, CHUNK + 1), _powers(INVERSE, CHUNK + 1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``data``, whose white space is spaces only; long texts go in parts."""
    out, start = [], 0
    while start < len(data):
        end = min(start + CHUNK, len(data))
        if end < len(data):
            cut = data.rfind(b" ", start, end)
            if cut > start:
                end = cut
            elif cut < start:  # a word longer than a part is hashed by itself
                end = data.find(b" ", start)
                end = len(data) if end < 0 else end
                out.append(np.frombuffer(hashlib.blake2b(data[start:end], digest_size=8).digest(), np.uint64))
                start = end
                continue
            else:
                start += 1
                continue
        part = np.frombuffer(data, np.uint8, end - start, start)
        inside = np.concatenate([[False], part != 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTERS[part] * UP[: len(part)], dtype=np.uint64)])
        out.append(mix((sums[last] - sums[first]) * DOWN[first] + (last - first).astype(np.uint64)))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of all runs of five words, or of all the words of a shorter text."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if len(words) == 0:
        return words
    if len(words) < SHINGLE:
        return mix((words * PLACES[: len(words)]).sum(keepdims=True, dtype=np.uint64) + PLACES[SHINGLE] * np.uint64(len(words)))
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += words[i : i + n] * PLACES[i]
    return np.unique(mix(total))


def identity(found: np.ndarray) -> bytes:
    """Texts of equal sets are one class from here on."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def tuples(found: np.ndarray) -> np.ndarray:
    """The left and right hash tuples of a set, as one row of 64-bit numbers."""
    least = np.full(len(TIMES), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 4096):
        least = np.minimum(least, (found[start : start + 4096] * TIMES + PLUS).min(axis=1))
    pairs = least.reshape(-1, ROWS)
    return mix((pairs * PLACES[:ROWS]).sum(axis=1, dtype=np.uint64)).view(np.int64)


def signatures(texts: DataFrame) -> DataFrame:
    """``doc_id, version, n_shingles, class, left, right`` for each row of ``doc_id, text``."""

    def make() -> Callable[[list[str | None]], dict[str, list]]:
        def work(batch: list[str | None]) -> dict[str, list]:
            out: dict[str, list] = {"n_shingles": [], "class": [], "left": [], "right": []}
            for text in batch:
                found = shingles(text)
                sides = tuples(found) if len(found) else None
                out["n_shingles"].append(len(found))
                out["class"].append(identity(found) if len(found) else None)
                out["left"].append(None if sides is None else sides[:TUPLES])
                out["right"].append(None if sides is None else sides[TUPLES:])
            return out

        return work

    schema = "n_shingles long, class binary, left array<long>, right array<long>"
    return map_texts(texts.withColumn("version", text_version(F.col("text"))), "text", schema, make)


def table_members(classes: DataFrame) -> DataFrame:
    """``bucket, class, n`` for every table key that two or more classes share; equal buckets appear once.

    Left tuples that no two classes share can't be part of a shared key and go first. A bucket's members are never
    brought together here: its size and a fingerprint of its members come from partial sums.
    """
    each = F.posexplode("left").alias("i", "l")
    rows = classes.select("class", "right", each)
    shared = rows.groupBy("i", "l").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("i", "l")
    keys = (
        rows.join(shared, ["i", "l"])
        .select("class", "i", "l", F.posexplode("right").alias("j", "r"))
        .select("class", F.struct(F.xxhash64("i", "j", "l", "r").alias("h"), F.col("l").bitwiseXOR(F.col("r")).alias("s")).alias("key"))
    )
    buckets = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("class")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit("two"), "class")).alias("y"),
    )
    distinct = buckets.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return keys.join(distinct.select("key", "n"), "key").select(F.col("key").alias("bucket"), "class", "n")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) of classes whose full sets are similar enough; ``texts`` has ``class, text``."""
    first = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                out = []
                for a, b, one, two in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if b != last:
                        last, held = b, shingles(two)
                    found = shingles(one)
                    both = len(np.intersect1d(found, held, assume_unique=True))
                    if 100 * both >= percent * (len(found) + len(held) - both):
                        out.append((a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])

    return joined.mapInArrow(giving_back(run), "a binary, b binary")


def _star(members: DataFrame, seed: int) -> DataFrame:
    """In each bucket of several components, one member of each is paired with one member of the bucket."""
    order = F.struct(F.xxhash64(F.lit(seed), "component"), F.xxhash64(F.lit(seed), "class"), F.col("class").alias("c"))
    one = members.groupBy("bucket", "component").agg(F.min(order)["c"].alias("a"))
    head = members.groupBy("bucket").agg(F.min(order)["c"].alias("b"), F.min("component").alias("p"), F.max("component").alias("q"))
    pairs = one.join(head.filter("p <> q").select("bucket", "b"), "bucket").filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rest(members: DataFrame, texts: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """All links between components of a bucket that the stars have not found, without listing pairs.

    Buckets of the same crowd have the same largest component, so they are taken together under its name, each member
    once. There the members outside that component are compared with all others, in blocks of bounded size on either
    side: a task counts the shared shingles of one block of each and returns links alone.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    top = sizes.groupBy("bucket").agg(
        F.max(F.struct("k", "component"))["component"].alias("top"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("parts")
    )
    top = top.filter("parts > 1 AND n > 2").select("bucket", "top")
    crowds = stage(members.join(top, "bucket").select(F.col("top").alias("bucket"), "class", "component").distinct(), "crowds")
    outside = F.col("component") != F.col("bucket")
    counts = crowds.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("c"))
    counts = counts.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("tb"), F.ceil(F.col("c") / block).cast("int").alias("qb"))
    rows = crowds.join(counts, "bucket")
    spot = F.xxhash64(F.lit("spot"), "class")
    asked = rows.filter(outside).select(
        "bucket", "class", "component", F.lit(True).alias("asked"), F.pmod(spot, "qb").cast("int").alias("q"),
        F.explode(F.sequence(F.lit(0), F.col("tb") - 1)).alias("t"),
    )
    against = rows.select(
        "bucket", "class", "component", F.lit(False).alias("asked"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"),
        F.pmod(spot, "tb").cast("int").alias("t"),
    )
    loaded = asked.unionByName(against).join(texts, "class")

    def compare(table: pa.Table) -> pa.Table:
        rows = table.select(["class", "component", "asked", "text"]).to_pylist()
        sets = {r["class"]: shingles(r["text"]) for r in rows}
        targets = [r for r in rows if not r["asked"]]
        sizes = np.array([len(sets[r["class"]]) for r in targets], np.int64)
        owner = np.repeat(np.arange(len(targets)), sizes)
        held = np.concatenate([sets[r["class"]] for r in targets]) if targets else np.zeros(0, np.uint64)
        out = []
        for r in rows:
            if not r["asked"] or not len(held):
                continue
            own = sets[r["class"]]
            at = np.minimum(np.searchsorted(own, held), len(own) - 1)
            both = np.bincount(owner[own[at] == held], minlength=len(targets))
            near = 100 * both >= percent * (sizes + len(own) - both)
            # One link joins two components; further ones between them would say nothing new.
            joined = {targets[i]["component"]: targets[i]["class"] for i in np.flatnonzero(near)}
            out += [(r["class"], other) for component, other in joined.items() if component != r["component"]]
        columns = list(zip(*out, strict=True)) or [(), ()]
        return pa.table({"a": pa.array(columns[0], pa.binary()), "b": pa.array(columns[1], pa.binary())})

    return loaded.groupBy("bucket", "q", "t").applyInArrow(compare, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, percent: int = 75, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, version, n_shingles, component_id, kept``.

    Documents are linked when 100 * |A and B| >= ``percent`` * |A or B| for their sets of five-word shingles, A-Z
    lower-cased; every link is confirmed on the full sets. ``component_id`` is the smallest id that links reach, and
    ``kept`` says that it is the document's own.

    Texts of equal sets are one class, so a group of copies of any size is one node. A bucket of a table names one head,
    and its other components are each compared with it; later rounds take other heads and skip buckets that have become
    one component. What is still apart is compared exhaustively, in bounded blocks. So neither all pairs of a bucket are
    emitted nor is any partner dropped.

    Null, empty and word-free texts have no shingles and are linked with nothing. A null id never names a component that
    has another id; a component of null ids alone has a null id and is kept. Rows that share an id are separate texts;
    repeated rows give the same result each. An empty table gives no rows. ``version`` tells texts of one id apart. Extra
    columns play no part.
    """
    ship_package(docs.sparkSession)
    texts = keyed_text(docs, id_col, text_col)
    rows = stage(signatures(texts), "signatures")
    classes = (
        rows.filter("n_shingles > 0")
        .groupBy("class")
        .agg(F.min("doc_id").alias("first_id"), F.first("left").alias("left"), F.first("right").alias("right"), F.min(F.struct("doc_id", "version")).alias("where"))
    )
    classes = stage(classes, "classes")
    members = stage(table_members(classes.select("class", "left", "right")), "buckets")
    wanted = members.select("class").distinct().join(classes.select("class", "where"), "class")
    wanted = wanted.select("class", F.col("where.doc_id").alias("doc_id"), F.col("where.version").alias("version"))
    keyed = texts.withColumn("version", text_version(F.col("text")))
    match = keyed["doc_id"].eqNullSafe(wanted["doc_id"]) & (keyed["version"] == wanted["version"])
    found = keyed.join(wanted, match).select(wanted["class"], keyed["text"]).dropDuplicates(["class"])
    candidates = stage(found, "candidates")

    labels = classes.select("class", F.col("class").alias("component"))

    def merge(members: DataFrame, labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links between components join those; buckets that are one component by then are done."""
        of = members.select("class", "component").distinct()
        ends = [of.select(F.col("class").alias(x), F.col("component").alias("_" + x)) for x in ("a", "b")]
        between = links.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        joined = components(between).select("node", F.col("component").alias("up"))
        moved = stage(follow(members, joined, "component"), "buckets")
        apart = moved.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q")
        return moved.join(apart.select("bucket"), "bucket", "left_semi"), follow(labels, joined, "component")

    members = members.withColumn("component", F.col("class"))
    for seed in range(rounds):
        links = stage(verified(_star(members, seed), candidates, percent), "links")
        if links.isEmpty():
            break
        members, labels = merge(members, labels, links)
    links = stage(_rest(members, candidates, percent), "links")
    if not links.isEmpty():
        _, labels = merge(members, labels, links)

    joined = classes.select("class", "first_id").join(labels, "class")
    ids = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    owners = joined.join(ids, "component").select("class", "component_id")
    out = rows.select("doc_id", "version", "n_shingles", "class").join(owners, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "version", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def brute_force(docs: list[tuple], percent: int = 75) -> dict:
    """All pairs of all documents: for tests. ``{doc_id: (n_shingles, component_id, kept)}``."""
    def words(text):
        return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()

    sets = {}
    for doc, text in docs:
        w = words(text)
        sets[doc] = {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()
    index: dict = {}
    for doc, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(doc)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for doc, s in sets.items():
        shared: dict = {}
        for x in s:
            for other in index[x]:
                if other < doc:
                    shared[other] = shared.get(other, 0) + 1
        for other, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = sorted((root(doc), root(other)))
                parent[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}

"""Long repeated byte strings, by merging Burrows-Wheeler transforms of shards within content-defined buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.functions.scale import stage
from litscreen.llm.common import bounded, keyed_text, ship_package, split_join, text_version
from litscreen.llm.minhash import BASE, DOWN, INVERSE, LETTERS, UP, mix

LENGTH = 400
GRAM = 16  # bytes of an anchor, and of a symbol
MOST_VARIANTS = 2_000  # different strings of a bucket that one task takes; larger buckets are split by more content
PART = 1 << 19  # window starts handled at a time
BATCH_ROWS = 6_000  # strings merged at a time
SHARD = 1_000  # strings of a shard


# ---------------------------------------------------------------- anchors


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes that start at each place."""
    n = len(data) - GRAM + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * UP[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[GRAM:] - sums[:n]) * DOWN[:n])


def smallest_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its smallest one, the first of equals."""
    n = len(values)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    keys = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    least = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def segments(data: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Cut the windows of a text into runs that share an anchor: ``(anchor, content, place, first, last)``.

    The anchor of a window is its gram with the smallest hash, so equal windows have equal anchors at the same distance.
    ``content`` is a hash of all bytes of the run's windows, whose first bytes are at ``first`` to ``last``.
    """
    out = []
    for start in range(0, len(data) - length + 1, PART):
        part = np.frombuffer(data, np.uint8, min(len(data) - start, PART + length - 1), start)
        grams = gram_hashes(part)
        # Places must not tell windows apart: the bits they take are the same for every part of every text.
        places = _smallest(grams, length - GRAM + 1)
        ends = np.flatnonzero(np.diff(places)) + 1
        firsts = np.concatenate([[0], ends])
        lasts = np.concatenate([ends, [len(places)]]) - 1
        anchors = grams[places[firsts]].view(np.int64)
        for anchor, place, first, last in zip(anchors.tolist(), places[firsts].tolist(), firsts.tolist(), lasts.tolist(), strict=True):
            content = data[start + first : start + last + length]
            digest = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)
            out.append((anchor, digest, start + place, start + first, start + last))
    return out


def _smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """As ``smallest_places``, with hashes cut to 44 bits whatever the size of the part."""
    return smallest_places(grams >> np.uint64(20) << np.uint64(20), width)


def find_segments(texts: DataFrame, length: int) -> DataFrame:
    """``doc_id, version, anchor, content, place, first, last``: a row for each segment of each text."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    keyed = texts.select("doc_id", text_version(F.col("text")).alias("version"), "text")
    schema = f"doc_id {kind}, version long, anchor long, content long, place long, first long, last long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in bounded(batch, "text"):
                owner, rows = [], []
                for i, text in enumerate(piece.column("text").to_pylist()):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    found = segments(data, length) if len(data) >= length else []
                    owner += [i] * len(found)
                    rows += found
                if rows:
                    at = pa.array(owner, pa.int64())
                    keys = [piece.column(c).take(at) for c in ("doc_id", "version")]
                    values = np.array(rows, np.int64).T
                    names = ["doc_id", "version", "anchor", "content", "place", "first", "last"]
                    yield pa.RecordBatch.from_arrays(keys + [pa.array(v) for v in values], names=names)

    return keyed.mapInArrow(run, schema)


# ---------------------------------------------------------------- transforms of shards and their merging


class Shard:
    """Suffixes of short strings of symbols, sorted, with the symbol before each (0 before a whole string).

    ``lines`` is a matrix of symbols from 1 on; 0 stands outside a string. Every string ends with a sign of its own; those
    signs sort first, in the order of the strings.
    """

    def __init__(self, lines: np.ndarray):
        self.strings = len(lines)
        row, column = np.nonzero(lines)
        rank = np.zeros((lines.shape[0], lines.shape[1] + 1), np.int64)
        rank[:, :-1] = lines
        step = 1
        while step < lines.shape[1]:  # ranks by 1, 2, 4, ... symbols
            after = np.zeros_like(rank)
            after[:, :-step] = rank[:, step:]
            keys = rank[row, column] * (after.max() + 1) + after[row, column]
            rank[row, column] = np.unique(keys, return_inverse=True)[1] + 1
            step *= 2
        order = np.argsort(rank[row, column], kind="stable")
        self.row, self.column = row[order], column[order]
        before = np.zeros_like(self.row)
        inside = self.column > 0
        before[inside] = lines[self.row[inside], self.column[inside] - 1]
        self.before = before
        last = np.where((lines != 0).any(axis=1), lines.shape[1] - 1 - np.argmax(lines[:, ::-1] != 0, axis=1), 0)
        self.final = lines[np.arange(len(lines)), last]  # the symbol before each end sign


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave the shards' suffixes: ``(row, column, interval)`` in merged order, rows counted through all shards.

    The interleave says which shard the next suffix comes from; within a shard the order is known and never sorted again.
    It starts as the shards one after another, and each round deals it out anew by the symbols before the suffixes,
    keeping the order of equals, so that after h rounds suffixes stand in the order of their first h symbols. Where two
    neighbours part in a round, their common prefix ends; what has not parted after ``depth`` rounds are the intervals of
    suffixes with ``depth`` symbols in common, and suffixes of one string alone don't count.
    """
    ends = np.repeat(np.arange(len(shards)), [s.strings for s in shards])
    body = np.repeat(np.arange(len(shards)), [len(s.row) for s in shards])
    order = np.concatenate([ends, body])
    interval = np.zeros(len(order), np.int64)
    symbols = np.empty(len(order), np.int64)
    befores = [np.concatenate([s.final, s.before]) for s in shards]
    for _ in range(depth):
        for k, before in enumerate(befores):
            symbols[order == k] = before
        some = np.flatnonzero(symbols)
        dealt = some[np.argsort(symbols[some], kind="stable")]
        sign, old = symbols[dealt], interval[dealt]
        parts = np.ones(len(dealt), np.int64)
        parts[1:] = (sign[1:] != sign[:-1]) | (old[1:] != old[:-1])
        order = np.concatenate([ends, order[dealt]])
        interval = np.concatenate([np.arange(len(ends)), len(ends) - 1 + np.cumsum(parts)])
    order, interval = order[len(ends) :], interval[len(ends) :]
    row, column = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    base = 0
    for k, shard in enumerate(shards):
        own = order == k
        row[own], column[own] = shard.row + base, shard.column
        base += shard.strings
    return row, column, interval


def covered(groups: np.ndarray, strings: list[bytes], before: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For strings whose anchors are equal within a group: the bytes of each that a window shared with another covers.

    Returns the first covered byte of each string, or -1, and the one after the last. ``before`` is how many bytes of a
    string precede its anchor. Strings are laid out with their anchors in one column and cut there into symbols of
    ``GRAM`` bytes, so a shared window holds a run of shared symbols; the merged transform finds those runs, and the few
    bytes on either side are then compared as they are.
    """
    n, left = len(strings), length - GRAM
    width = left + length
    cells = np.zeros((n, width), np.uint8)
    start = left - before
    end = start + np.array([len(s) for s in strings])
    for i, s in enumerate(strings):
        cells[i, start[i] : end[i]] = np.frombuffer(s, np.uint8)
    words = cells.reshape(n, width // GRAM, GRAM).view(np.uint64)
    place = np.arange(width // GRAM)
    whole = (place * GRAM >= start[:, None]) & ((place + 1) * GRAM <= end[:, None])
    mixed = mix(words[:, :, 0] * np.uint64(BASE)) + mix(words[:, :, 1] * np.uint64(INVERSE))
    mixed = mix(mixed + mix(groups.astype(np.uint64) * np.uint64(BASE))[:, None] + place.astype(np.uint64) * LETTERS[1])
    symbols = np.zeros(whole.shape, np.int64)
    symbols[whole] = np.unique(mixed[whole], return_inverse=True)[1] + 1
    depth = (length - GRAM) // GRAM
    row, column, interval = merge([Shard(symbols[i : i + SHARD]) for i in range(0, n, SHARD)], depth)
    enough = np.bincount(interval)[interval] > 1
    row, column, interval = row[enough], column[enough], interval[enough]
    first, last = np.full(n, width + length), np.full(n, -1)
    padded = np.concatenate([np.zeros((n, GRAM), np.uint8), cells, np.zeros((n, GRAM), np.uint8)], axis=1)
    near = np.arange(GRAM)
    for lead in range(GRAM):  # windows that start so many bytes before the shared symbols
        begin = column * GRAM - lead
        fits = (begin >= start[row]) & (begin + length <= end[row])
        r, b = row[fits], begin[fits]
        # In the padded layout: ``lead`` bytes before the symbols, then the rest of the window after them.
        spots = np.where(near < lead, b[:, None] + near, b[:, None] + depth * GRAM + near) + GRAM
        margin = np.ascontiguousarray(padded[r[:, None], spots]).view(np.uint64)
        keys = np.stack([interval[fits].astype(np.uint64), margin[:, 0], margin[:, 1]], axis=1)
        sort = np.lexsort(keys.T)
        keys = keys[sort]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        same = np.cumsum(new) - 1
        shared = sort[(np.bincount(same)[same] > 1)] if len(keys) else sort
        np.minimum.at(first, r[shared], b[shared])
        np.maximum.at(last, r[shared], b[shared] + length)
    found = last >= 0
    return np.where(found, first - start, -1), np.where(found, last - start, -1)


# ---------------------------------------------------------------- buckets


BUCKET = "bucket long, doc_id {id}, version long, at long, before long, shared boolean, content binary"


def _load(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of segments, from one join of the documents with their own segments; of repeated rows one is read.

    The rows that remain are grouped by the columns that they are joined on, so they aren't shuffled again.
    """

    def keys(doc_id: Column) -> list[Column]:
        return [doc_id.isNull().alias("_null"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("_key")]

    kind = texts.schema["doc_id"].dataType.simpleString()
    lists = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct("anchor", "n", "place", "first", "last", "shared")).alias("s"))
    lists = lists.select(*keys(F.col("doc_id")), "version", "s")
    keyed = texts.select(*keys(F.col("doc_id")), text_version(F.col("text")).alias("version"), "doc_id", "text")
    on = ["_null", "_key", "version"]
    one = keyed.join(lists, on).groupBy(*on).agg(*[F.first(c).alias(c) for c in ("doc_id", "s", "text")])
    rows = one.select("doc_id", "version", "s", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in bounded(batch, "text", 2_000_000):
                owner, out = [], []
                for i, (found, text) in enumerate(zip(piece.column("s").to_pylist(), piece.column("text").to_pylist(), strict=True)):
                    data = text.encode("utf-8", "surrogatepass")
                    for s in found:
                        owner.append(i)
                        out.append((s["anchor"], s["n"], s["first"], s["place"] - s["first"], s["shared"], data[s["first"] : s["last"] + length]))
                at = pa.array(owner, pa.int64())
                bucket, n, first, before, shared, content = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int64()), piece.column("doc_id").take(at), piece.column("version").take(at), pa.array(first, pa.int64()),
                     pa.array(before, pa.int64()), pa.array(shared, pa.bool_()), pa.array(content, pa.binary()), pa.array(n, pa.int64())],
                    names=["bucket", "doc_id", "version", "at", "before", "shared", "content", "n"],
                )

    return rows.mapInArrow(run, BUCKET.format(id=kind) + ", n long")


def _compare(rows: DataFrame, length: int) -> DataFrame:
    """``doc_id, version, open, close``: what each string shares with another of its bucket. A bucket is in one task."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")

    def done(table: pa.Table) -> pa.RecordBatch | None:
        groups = table.column("bucket").to_numpy()
        strings = table.column("content").to_pylist()
        first, last = covered(np.unique(groups, return_inverse=True)[1], strings, table.column("before").to_numpy(), length)
        keep = np.flatnonzero((first >= 0) & ~np.array(table.column("shared").to_pylist(), bool))
        if not len(keep):
            return None
        part = table.take(pa.array(keep)).combine_chunks()
        at = part.column("at").to_numpy()
        columns = [part.column("doc_id"), part.column("version"), pa.array(at + first[keep]), pa.array(at + last[keep])]
        made = pa.table(columns, names=["doc_id", "version", "open", "close"]).combine_chunks()
        return made.to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                held.append(batch.slice(start, BATCH_ROWS))
                count += held[-1].num_rows
                if count < BATCH_ROWS:
                    continue
                table = pa.Table.from_batches(held)
                buckets = table.column("bucket").to_numpy()
                whole = int(np.searchsorted(buckets, buckets[-1], "left"))  # the last bucket may go on
                if whole and (got := done(table.slice(0, whole))) is not None:
                    yield got
                held = table.slice(whole).to_batches()
                count = table.num_rows - whole
        if count and (got := done(pa.Table.from_batches(held))) is not None:
            yield got

    return dealt.mapInArrow(run, f"doc_id {kind}, version long, open long, close long")


def _split(rows: DataFrame, length: int, width: int) -> DataFrame:
    """Cut strings into pieces of at most ``width`` window starts, in buckets of the bytes that all windows there hold."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in bounded(batch, "content", 2_000_000):
                owner, out = [], []
                for i, r in enumerate(piece.select(["bucket", "at", "before", "shared", "content"]).to_pylist()):
                    data, before = r["content"], r["before"]
                    for block in range(-before // width, (len(data) - length - before) // width + 1):
                        low, high = max(0, block * width + before), min(len(data) - length, block * width + width - 1 + before)
                        core = data[block * width + width - 1 + before : block * width + before + length]
                        key = hashlib.blake2b(b"%d %d " % (r["bucket"], block) + core, digest_size=8).digest()
                        owner.append(i)
                        out.append((int.from_bytes(key, "little", signed=True), r["at"] + low, before - low, r["shared"], data[low : high + length]))
                at = pa.array(owner, pa.int64())
                bucket, first, gap, shared, content = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int64()), piece.column("doc_id").take(at), piece.column("version").take(at), pa.array(first, pa.int64()),
                     pa.array(gap, pa.int64()), pa.array(shared, pa.bool_()), pa.array(content, pa.binary())],
                    names=["bucket", "doc_id", "version", "at", "before", "shared", "content"],
                )

    return rows.mapInArrow(run, BUCKET.format(id=kind))


def _sized(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return split_join(rows, stage(sizes, "sizes"), ["bucket"], "n", ["doc_id", "version", "at"])


def repeated_spans(texts: DataFrame, length: int = LENGTH, most: int = MOST_VARIANTS) -> DataFrame:
    """``doc_id, version, open, close``: byte ranges covered by strings of ``length`` bytes that also start elsewhere.

    A segment, the windows around one anchor, whose anchor stands at one place only is settled by a count. A segment
    whose whole content stands at two places is covered whole, which settles exact copies however many there are: places
    of one content are folded by a partial minimum and maximum. Only different segments around equal anchors are loaded,
    one of each content, and compared in buckets. A bucket of more than ``most`` is split by the bytes its windows have
    in common, down to single windows, which need no comparing: equal ones are in one bucket by then.
    """
    found = stage(find_segments(texts, length), "segments")
    where = F.struct("doc_id", "version", "first")
    here = F.struct("doc_id", "version", "first", "last", "place")
    folded = found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("places"), F.max(where).alias("two"), F.min(here).alias("here"))
    one = F.struct(*[F.col("here")[c].alias(c) for c in ("doc_id", "version", "first")])
    contents = stage(folded.withColumn("shared", ~one.eqNullSafe(F.col("two"))).drop("two"), "contents")
    copies = contents.filter("shared").select("anchor", "content", "places")
    same = split_join(found, copies, ["anchor", "content"], "places", ["doc_id", "version", "first"])
    spans = same.select("doc_id", "version", F.col("first").alias("open"), (F.col("last") + length).alias("close"))
    variants = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("shared").alias("all_shared")).filter("n > 1 AND NOT all_shared")
    variants = stage(variants.select("anchor", "n"), "variants")
    wanted = split_join(contents, variants, ["anchor"], "n", ["content"]).select("anchor", "n", "shared", "here.*")
    rows = stage(_load(wanted, texts, length), "buckets")
    width = 64
    while True:
        spans = spans.unionByName(_compare(rows.filter(F.col("n") <= most).drop("n"), length))
        large = rows.filter(F.col("n") > most).drop("n")
        if large.isEmpty():
            return spans
        rows = stage(_sized(stage(_split(large, length, width), "pieces")), "buckets")
        if width == 1:
            single = rows.filter(~F.col("shared"))
            return spans.unionByName(single.select("doc_id", "version", F.col("at").alias("open"), (F.col("at") + length).alias("close")))
        width //= 8


# ---------------------------------------------------------------- the operator


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, most: int = MOST_VARIANTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: each document's maximal removed byte ranges, and its remaining bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts at another place, in this or another document.
    Texts are UTF-8; a null text is empty. Strings never cross documents and are judged on the input. Every document
    gives a row; rows that share an id are separate texts unless they are equal, and repeated rows count as one place but
    give a row each. Null ids stay. An empty table gives no rows. Extra columns play no part. ``length`` is a multiple
    of 16, of 64 at least.
    """
    if length % GRAM or length < 4 * GRAM:
        raise ValueError("length must be a multiple of 16 and at least 64")
    ship_package(docs.sparkSession)
    texts = keyed_text(docs, id_col, text_col)
    spans = repeated_spans(texts, length, most)
    lists = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("open", "close")).alias("spans"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("version").alias("_v"), "spans")
    keyed = texts.withColumn("version", text_version(F.col("text")))
    joined = keyed.join(lists, keyed["doc_id"].eqNullSafe(lists["_id"]) & (keyed["version"] == lists["_v"]), "left")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in bounded(batch, "text"):
                sizes, runs, kept = [], [], []
                for found, text in zip(piece.column("found").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    merged: list[dict] = []
                    for s in sorted(found or [], key=lambda s: s["open"]):
                        if merged and s["open"] <= merged[-1]["close"]:
                            merged[-1]["close"] = max(merged[-1]["close"], s["close"])
                        else:
                            merged.append(dict(s))
                    edges = [0, *[x for s in merged for x in (s["open"], s["close"])], len(data)]
                    sizes.append(len(data))
                    runs.append(merged)
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                span = pa.struct([("open", pa.int64()), ("close", pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(span)), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    schema = f"doc_id {kind}, n_bytes long, spans array<struct<open: long, close: long>>, kept binary"
    return joined.select("doc_id", F.col("spans").alias("found"), "text").mapInArrow(run, schema)


def repeats_report(docs: DataFrame, length: int = LENGTH, most: int = MOST_VARIANTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every document."""

    def removed(spans: Column) -> Column:
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["close"] - s["open"])

    return remove_repeats(docs, length, most).select(
        "doc_id", "n_bytes", removed(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(docs: list[tuple], length: int = LENGTH) -> dict:
    """Every window of every text: for tests."""
    places: dict[bytes, int] = {}
    datas = {d: (t or "").encode("utf-8", "surrogatepass") for d, t in docs}
    for data in datas.values():
        for i in range(len(data) - length + 1):
            key = hash(data[i : i + length])
            places[key] = places.get(key, 0) + 1
    out = {}
    for doc, data in datas.items():
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if places[hash(data[i : i + length])] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out

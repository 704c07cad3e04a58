"""Phrases whose words come together more often than apart, counted in tries whose hash containers burst as they grow."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litscreen.functions.scale import stage
from litscreen.llm.common import bounded, ship_package, split_join

LONGEST = 4  # words; the most that the numbers of a phrase leave room for
LEAST = 30
BEST = 2_000  # phrases of a language
HELD = 600_000  # phrases that a task holds before it spills
BURST = 8_192  # phrases of a container
AT_ONCE = 1_000_000  # words that wait to be sorted together before they go into the trie
READ = 256 << 10  # bytes of texts whose words are looked up at a time: few enough to stay in a core's cache
RUN = 200_000  # phrases of a run that are written at a time
NAMES_HELD = 64 << 20  # bytes of different words that a task holds before it begins anew
RANGES = 512  # of prefixes, at least; as many as twice the tasks of a shuffle if that is more
SAMPLED = 1_000  # texts that tell where ranges are cut
MERGED = 2_000_000  # partial counts of a range that wait to be added up
FILTER_BITS = 1 << 26  # of the filter of frequent shorter phrases that is sent to the tasks: 8 MB, whatever the corpus

BREAK = b"\n"
# A-Z lower-cased; what parts pieces becomes a line feed, and a tab a space.
BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256)
)


# ---------------------------------------------------------------- the trie

WORD = 21  # bits of a word's number in a phrase; a task begins anew long before it holds so many words


class Node:
    """Below a prefix: ``found`` counts the rests, until it bursts into ``below``, a node for each next word."""

    __slots__ = ("found", "below", "left")

    def __init__(self, left: int):
        self.found: dict[int, int] | None = {}
        self.below: dict[int, Node] = {}
        self.left = left  # words that follow the prefix

    def add(self, rests: list[int], times: list[int], burst: int) -> int:
        """Count ascending ``rests``; returns how many of them are new here."""
        found = self.found
        if found is None:
            return self._below(rests, times, burst)
        size = len(found)
        get = found.get
        for r, t in zip(rests, times, strict=True):
            found[r] = get(r, 0) + t
        new = len(found) - size
        if len(found) > burst and self.left > 1:  # a last word needs no node of its own
            self.found = None
            ordered = sorted(found)
            self._below(ordered, [found[r] for r in ordered], burst)
        return new

    def _below(self, rests: list[int], times: list[int], burst: int) -> int:
        shift, new, i = WORD * (self.left - 1), 0, 0
        mask = (1 << shift) - 1
        while i < len(rests):
            word, j = rests[i] >> shift, i + 1
            while j < len(rests) and rests[j] >> shift == word:
                j += 1
            lower = self.below.get(word)
            if lower is None:
                lower = self.below[word] = Node(self.left - 1)
            new += lower.add([r & mask for r in rests[i:j]], times[i:j], burst)
            i = j
        return new

    def walk(self, prefix: int = 0) -> Iterator[tuple[int, dict[int, int]]]:
        """``(prefix, container)`` of each container, with the prefix moved to its place in a rest."""
        if self.found is not None:
            yield prefix, self.found
        else:
            for word, lower in self.below.items():
                yield from lower.walk(prefix | word << WORD * (self.left - 1))


class Trie:
    """Counts of phrases of ``length`` words, given as numbers. A first word is a subtree, and spilled whole."""

    def __init__(self, length: int, burst: int = BURST):
        self.roots: dict[int, Node] = {}
        self.sizes: dict[int, int] = {}
        self.size, self.length, self.burst = 0, length, burst

    def add(self, firsts: np.ndarray, rests: np.ndarray, times: np.ndarray) -> None:
        """Count different phrases, ascending: the number of the first word, and those of the others in ``WORD`` bits each."""
        rests, times = rests.tolist(), times.tolist()
        starts = np.flatnonzero(np.r_[True, firsts[1:] != firsts[:-1]]) if len(firsts) else firsts
        for first, i, j in zip(firsts[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(rests)], strict=True):
            node = self.roots.get(first)
            if node is None:
                node = self.roots[first] = Node(max(1, self.length - 1))
                self.sizes[first] = 0
            new = node.add(rests[i:j], times[i:j], self.burst)
            self.sizes[first] += new
            self.size += new

    def spill(self, leave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take out whole subtrees, the largest first, until at most ``leave`` phrases are held: as added, in any order."""
        firsts, rests, times = [], [], []
        for first in sorted(self.sizes, key=self.sizes.__getitem__, reverse=True):
            if self.size <= leave:
                break
            self.size -= self.sizes.pop(first)
            for prefix, found in self.roots.pop(first).walk():
                firsts.append(np.full(len(found), first))
                rests.append(np.fromiter(found, np.int64, len(found)) | prefix)
                times.append(np.fromiter(found.values(), np.int64, len(found)))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *x]) for x in (firsts, rests, times))


# ---------------------------------------------------------------- counting in a task


word_hash = zlib.crc32  # what only chooses bits of a filter need not be longer


_A, _B = np.uint64(0x9E37_79B9_7F4A_7C15), np.uint64(0xC2B2_AE3D_27D4_EB4F)


def slots(hashes: list[np.ndarray], lang: str, bits: int) -> np.ndarray:
    """The place in the filter of phrases, given the hashes of their first, second, ... words."""
    x = np.full(len(hashes[0]), word_hash(b"lang " + lang.encode("utf-8", "surrogatepass")), np.uint64)
    for h in hashes:
        x = x * _A + h
        x = (x ^ (x >> np.uint64(31))) * _B
    x ^= x >> np.uint64(29)
    return (x % np.uint64(bits)).astype(np.int64)


def folded(firsts: np.ndarray, rests: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different phrases, ascending, and how often each occurs."""
    if length <= 3:
        shift = WORD * max(1, length - 1)
        both, times = np.unique(firsts << shift | rests, return_counts=True)
        return both >> shift, both & ((1 << shift) - 1), times
    order = np.lexsort((rests, firsts))
    firsts, rests = firsts[order], rests[order]
    new = np.flatnonzero(np.r_[True, (firsts[1:] != firsts[:-1]) | (rests[1:] != rests[:-1])])
    return firsts[new], rests[new], np.diff(np.r_[new, len(firsts)])


class Numbers(dict):
    """Numbers of words, given in order of first use."""

    def __init__(self):
        super().__init__({b"": -2, BREAK: -1})
        self.words: list[bytes] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        self.bytes += len(word) + 150
        return n


class Counter:
    """Counts the phrases of some lengths of a task's texts, holding at most about ``held`` different ones.

    ``known`` has a bit for each phrase of one word less than the shortest that may be frequent.
    """

    def __init__(self, lengths: tuple[int, ...], known: np.ndarray | None, held: int, burst: int, at_once: int = AT_ONCE):
        self.lengths, self.known, self.held, self.burst, self.at_once = lengths, known, held, burst, at_once
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.hashes = np.zeros(0, np.uint64)
        self.tries: dict[tuple[str, int], Trie] = {}
        self.lines: dict[str, list[np.ndarray]] = {}
        self.waiting = 0

    def add(self, lang: str, data: bytes) -> None:
        """Read a text, or several with line feeds between them, and count what is waiting if that is enough."""
        words = data.translate(BYTES).replace(b"\n", b" \n ").split(b" ")
        line = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.lines.setdefault(lang, []).append(np.r_[line[line != -2], np.int32(-1)])
        self.waiting += len(words)
        if self.waiting >= self.at_once:
            self.count()

    def count(self) -> None:
        for lang, lines in self.lines.items():
            line = np.concatenate(lines)
            frequent = self.frequent(lang, line)
            for k in self.lengths:
                firsts, rests = self.phrases(line, k, frequent)
                if len(firsts):
                    self.tries.setdefault((lang, k), Trie(k, self.burst)).add(*folded(firsts, rests, k))
        self.lines.clear()
        self.waiting = 0

    def frequent(self, lang: str, line: np.ndarray) -> np.ndarray | None:
        """Whether the known phrase that starts at each place may be frequent."""
        k = self.lengths[0] - 1
        if self.known is None or len(line) < k:
            return None
        words = self.numbers.words
        if len(self.hashes) < len(words):
            more = np.fromiter(map(word_hash, words[len(self.hashes) :]), np.uint64, len(words) - len(self.hashes))
            self.hashes = np.concatenate([self.hashes, more])
        hashes, m = self.hashes[np.maximum(line, 0)], len(line) - k + 1
        at = slots([hashes[j : j + m] for j in range(k)], lang, len(self.known) * 8)
        return ((self.known[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    def phrases(self, line: np.ndarray, k: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The phrases that may be frequent: the number of the first word, and those of the others in one integer.

        A phrase can't be frequent unless every shorter one that it holds is.
        """
        n = len(line) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = np.ones(n, bool)
        for j in range(k):
            inside &= line[j : j + n] >= 0
        if frequent is not None:
            for j in range(k - self.lengths[0] + 2):
                inside &= frequent[j : j + n]
        starts = np.flatnonzero(inside)
        rests = np.zeros(len(starts), np.int64)
        for j in range(1, k):
            rests = rests << WORD | line[starts + j]
        if k == 1:  # single words need no subtrees
            return rests, line[starts].astype(np.int64)
        return line[starts].astype(np.int64), rests

    def spilled(self, everything: bool = False) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
        """Sorted runs, as (language, length, phrases, counts), if more is held than allowed."""
        new_words = self.numbers.bytes > NAMES_HELD
        if everything or new_words:
            self.count()
        total = sum(t.size for t in self.tries.values())
        if not everything and not new_words and total <= self.held:
            return
        words = pa.array(self.numbers.words, pa.binary())
        for (lang, k), trie in self.tries.items():
            leave = 0 if everything or new_words else trie.size * self.held // (2 * total)
            firsts, rests, times = trie.spill(leave)
            for i in range(0, len(firsts), RUN):
                some, n = rests[i : i + RUN], times[i : i + RUN]
                places = [some >> WORD * j & (1 << WORD) - 1 for j in reversed(range(max(1, k - 1)))]
                own = [words.take(pa.array(x)) for x in ([firsts[i : i + RUN], *places] if k > 1 else places)]
                phrases = (pc.binary_join_element_wise(*own, b" ") if len(own) > 1 else own[0]).cast(pa.string())
                order = pc.sort_indices(phrases)
                yield lang, k, phrases.take(order), n[order.to_numpy()]
        if new_words:
            self.clear()


def sample_texts(docs: DataFrame) -> list[tuple[str, bytes]]:
    """The beginnings of some ``SAMPLED`` texts, twice as many at most: they only say where ranges are best cut.

    Texts are chosen by a hash before they meet, so a task sends few of them, however many tasks there are.
    """
    one_in = max(1, docs.count() // SAMPLED)
    some = docs.filter((F.col("text") != "") & (F.pmod(F.xxhash64("lang", "text"), F.lit(one_in)) == 0))
    few = some.select("lang", F.substring("text", 1, 2_000)).limit(2 * SAMPLED).coalesce(1)
    return [(r[0], r[1].encode("utf-8", "surrogatepass")) for r in few.collect()]


def range_ends(sample: list[tuple[str, bytes]], lengths: tuple[int, ...], known: np.ndarray | None, ranges: int) -> list[tuple[str, str]]:
    """Where to cut all (language, phrase) into at most ``ranges`` ranges of about as many phrases of the sample."""
    counter = Counter(lengths, known, HELD, BURST)
    for lang, text in sample:
        counter.add(lang, text)
    found = sorted((lang, p) for lang, _, phrases, _ in counter.spilled(everything=True) for p in phrases.to_pylist())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def cut_run(phrases: pa.Array, lang: str, ends: list[tuple[str, str]]) -> tuple[int, np.ndarray]:
    """The first range that a language has a part in, and where each range's phrases begin in a sorted run of it, with the run's end."""
    low, high = bisect.bisect_left(ends, (lang, "")), bisect.bisect_left(ends, (lang + "\0", ""))
    cuts, at = [0], 0
    for _, end in ends[low:high]:
        at = bisect.bisect_left(range(len(phrases)), end.encode(), at, key=lambda i: phrases[i].as_py().encode())
        cuts.append(at)
    return low, np.array([*cuts, len(phrases)])


def phrase_runs(
    docs: DataFrame, lengths: tuple[int, ...], ends: list[tuple[str, str]], known: np.ndarray | None = None, held: int = HELD, burst: int = BURST
) -> DataFrame:
    """``lang, k, range, phrases, times``: partial counts of the phrases of ``lengths`` words, as each task's sorted runs.

    ``docs`` has ``lang`` and ``text``. A task holds at most about ``held`` phrases: then the largest subtrees are written out
    until half remains, and what is left at the end follows. A run is cut at ``ends``, and each part is one row: its phrases,
    a line each, and their counts in as few bytes as the largest needs. With ``known``, a bit set of frequent phrases of one
    word less than the shortest of ``lengths``, phrases that can't be frequent are skipped; a bit that is set by chance only
    costs a count.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((known, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filtered, own_ends = sent.value
        counter = Counter(lengths, filtered, held, burst)

        def out(everything: bool = False) -> Iterator[pa.RecordBatch]:
            for lang, k, phrases, times in counter.spilled(everything):
                if not len(phrases):
                    continue
                low, cuts = cut_run(phrases, lang, own_ends)
                some = np.flatnonzero(np.diff(cuts))
                places = np.r_[cuts[some], len(phrases)]  # empty parts have no row
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(places, pa.int32()), phrases), "\n")
                packed = [times[i:j].astype(np.min_scalar_type(times[i:j].max())).tobytes() for i, j in zip(places[:-1], places[1:], strict=True)]
                columns = [
                    pa.array([lang] * len(some), pa.string()), pa.array(np.full(len(some), k, np.int32)), pa.array((some + low).astype(np.int32)),
                    joined, pa.array(packed, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "k", "range", "phrases", "times"])

        for batch in batches:
            for piece in bounded(batch, "text", READ):
                texts: dict[str, list[bytes]] = {}
                for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    if text:
                        texts.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
                for lang, own in texts.items():
                    counter.add(lang, BREAK.join(own))
                yield from out()
        yield from out(everything=True)

    return docs.select("lang", "text").mapInArrow(run, "lang string, k int, range int, phrases string, times binary")


def merged(runs: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, k, f``: the runs' counts added up, of phrases that occur ``least`` times, with a row of ``k`` 0 and no
    phrase for the sum of all counts of a range.

    Each task gets ranges of prefixes and merges the runs there, one range after another. Ranges are cut between whole
    phrases, so a frequent prefix is spread over tasks, and a phrase meets one count per run, however frequent it is.
    """
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(tasks, "range").sortWithinPartitions("range", "lang", "k")

    def added(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
        return sums.select(["phrase", "n_sum"]).rename_columns(["phrase", "n"])

    def frequent(key: tuple, parts: list[pa.Table]) -> pa.RecordBatch:
        sums = added(parts)
        total, sums = pc.sum(sums.column("n")).as_py(), sums.filter(pc.greater_equal(sums.column("n"), least))
        _, lang, k = key
        phrases, times = sums.column("phrase").to_pylist(), sums.column("n").to_pylist()
        columns = [
            pa.array([lang] * (len(times) + 1), pa.string()), pa.array([*phrases, None], pa.string()),
            pa.array([k] * len(times) + [0], pa.int32()), pa.array([*times, total], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "k", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, held = None, [], 0
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "k")), strict=True)
            for i, key in enumerate(keys):
                if last is not None and key != last:
                    yield frequent(last, parts)
                    parts, held = [], 0
                last = key
                phrases = pc.split_pattern(batch.column("phrases").slice(i, 1), "\n").flatten()
                packed = batch.column("times")[i].as_py()
                times = np.frombuffer(packed, f"<u{len(packed) // len(phrases)}").astype(np.int64)
                parts.append(pa.table({"phrase": phrases, "n": times}))
                held += len(phrases)
                if held > MERGED:
                    parts = [added(parts)]
                    held = 0
        if last is not None:
            yield frequent(last, parts)

    return dealt.mapInArrow(run, "lang string, phrase string, k int, f long")


def phrase_filter(frequent: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The places of ``frequent`` phrases (``lang, phrase``) as bits, put together by bitmap aggregation in blocks of 4 kB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                hashes = [np.array([word_hash(w)], np.uint64) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")]
                found.append(int(slots(hashes, lang, bits)[0]) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["slot"])

    ship_package(frequent.sparkSession)
    placed = frequent.select("lang", "phrase").mapInArrow(run, "slot long")
    blocks = placed.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.toLocalIterator():
        start = (r["block"] - 1) * 4096
        own = np.frombuffer(r["bits"], np.uint8)[: len(out) - start]
        out[start : start + len(own)] = own
    return out


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, held: int = HELD, burst: int = BURST, bits: int = FILTER_BITS
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f`` of every phrase of up to ``longest`` words that occurs ``least`` times, and ``lang, n`` of words.

    Three passes over the texts: all words are counted; pairs only of words that may be frequent; longer phrases only where
    every pair in them may be. That leaves no frequent one out.
    """
    passes = [(1,), (2,), tuple(range(3, longest + 1))]
    found = words = all_found = None
    sample = sample_texts(docs)
    ranges = max(RANGES, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for lengths in passes[: longest if longest < 3 else 3]:
        known = None if found is None else phrase_filter(found, bits)
        runs = phrase_runs(docs, lengths, range_ends(sample, lengths, known, ranges), known, held, burst)
        sums = stage(merged(runs, least), "phrases")
        if found is None:
            words = sums.filter("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
        found = sums.filter("k > 0")
        all_found = found if all_found is None else all_found.unionByName(found)
    return all_found, words


# ---------------------------------------------------------------- scores


def _part(words: Column, start: int | Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _wide(x: str) -> Column:
    return F.col(x).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, lang_col: str = "lang", text_col: str = "text",
    held: int = HELD, burst: int = BURST, bits: int = FILTER_BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language that most clearly belong together.

    A-Z are lower-cased; texts are split at . , ; : ! ? and U+000A to U+000D, pieces at spaces and tabs. A candidate has 2 to
    ``longest`` words and occurs ``a >= least`` times, overlaps included. Cut in two, its parts occur ``l`` and ``r`` times; the
    cut with the smallest score floor(2000000 a / (l + r)) counts, the first of equals. A candidate goes if a longer one
    that holds its words side by side occurs at least 0.8 times as often. The first ``best`` of a language stay, by score, then
    ``a``, both descending, then the phrase in byte order.

    Null texts are empty, a null language is ``und``, repeated rows count each time, an empty table gives no rows, and other
    columns play no part. Counts are exact, over whole texts; scores are exact whatever the counts. A frequent part of very
    many candidates is dealt over tasks, and a language keeps its best per share before they meet.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts, totals = frequent_phrases(texts, least, longest, held, burst, bits)
    words = F.split("phrase", " ")
    candidates = counts.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))

    inner = [
        F.struct(_part(F.col("w"), i, F.lit(m)).alias("sub"), F.lit(m).alias("m"), F.lit(i).alias("i"))
        for m in range(2, longest) for i in range(1, longest - m + 2)
    ]
    held_in = candidates.filter("k > 2").select("lang", "k", "a", F.explode(F.array(*inner)).alias("s")).filter("s.m < k AND s.i + s.m - 1 <= k")
    most = held_in.groupBy("lang", F.col("s.sub").alias("phrase")).agg(F.max("a").alias("longer"))
    left = candidates.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (5 * _wide("longer") < 4 * _wide("a")))

    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(
        c.alias("cut"), F.array_join(F.slice("w", 1, c), " ").alias("first"), F.array_join(F.slice("w", c + 1, F.col("k") - c), " ").alias("rest")))
    cut = stage(left.select("lang", "phrase", "k", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "k", "a", "c.*"), "cuts")
    parts = cut.select("lang", F.explode(F.array("first", "rest")).alias("phrase")).groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("uses"))
    parts = stage(parts.join(counts.select("lang", "phrase", "f"), ["lang", "phrase"]), "parts")
    for part, name in (("first", "l"), ("rest", "r")):
        known = parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name), "uses")
        cut = split_join(cut, known, ["lang", part], "uses", ["phrase", "cut"]).drop("uses")
    score = F.expr("(2000000 * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    lowest = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("s"))
    scored = lowest.select("lang", "phrase", "s.score", "s.a", "s.l", "s.r").withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    few = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    out = ranked.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH text AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM text),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
spot AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0),
gram AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM spot, (VALUES (1), (2), (3), (4)) t(k) WHERE i + k - 1 <= len(w)
),
freq AS (SELECT lang, phrase, k, count(*) AS f FROM gram GROUP BY lang, phrase, k HAVING count(*) >= 30),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k >= 2),
longer AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS f
  FROM cand, (VALUES (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)) t(m, i) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2
),
kept AS (SELECT c.* FROM cand c LEFT JOIN longer o ON c.lang = o.lang AND c.phrase = o.phrase WHERE o.f IS NULL OR 100 * o.f::HUGEINT < 80 * c.a::HUGEINT),
cut AS (
  SELECT c.lang, c.phrase, c.a, t.c AS place, p.f AS l, q.f AS r, (2000000 * c.a::HUGEINT) // (p.f::HUGEINT + q.f::HUGEINT) AS score
  FROM kept c JOIN (VALUES (1), (2), (3)) t(c) ON t.c < c.k
  JOIN freq p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1 : t.c], ' ')
  JOIN freq q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[t.c + 1 : c.k], ' ')
),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) AS nth FROM cut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low WHERE nth = 1)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, CAST(r.score AS BIGINT) AS score FROM ranked r JOIN total t ON r.lang = t.lang WHERE r.rank <= 2000
"""


def brute_force(docs: list[tuple], least: int = LEAST, longest: int = LONGEST, best: int = BEST) -> list[tuple]:
    """The definition, phrase by phrase: for tests. ``docs`` are (language, text)."""
    import re
    from collections import Counter as Counts

    counts: dict[str, Counts] = {}
    for lang, text in docs:
        own = counts.setdefault("und" if lang is None else lang, Counts())
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            own.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        n = sum(f for p, f in own.items() if len(p) == 1)
        some = {p: f for p, f in own.items() if len(p) > 1 and f >= least}
        rows = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * f >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in some.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:c]] + own[p[c:]]), c, own[p[:c]], own[p[c:]]) for c in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out

"""Scores of texts by a language model with deleted interpolation (Jelinek and Mercer).

Relative frequencies of n-grams are mixed, level by level, with weights that depend on how often the context was seen;
the weights are learned by expectation maximisation on documents that were left out of the counts they are mixed from.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.functions.scale import stage
from litscreen.llm.common import bounded, keyed_text, ship_package

ORDER = 2
ROUNDS = 15  # of expectation maximisation
LEVELS = 24  # context frequencies fall into classes by powers of two: unseen, 1, 2-3, 4-7, ...
CHUNK_BYTES = 2 << 20  # of text that a task counts at a time
PART_BYTES = 6 << 20  # of text whose n-grams one task adds up
COUNTED, DELETED, HELD_OUT = 0, 1, 2  # the documents of a chunk are of one kind

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
START = np.uint64(0x51A7_0000_0000_0007)
END = b"\n"  # no word: words hold no white space
_A, _B = np.uint64(0x9E37_79B9_7F4A_7C15), np.uint64(0xC2B2_AE3D_27D4_EB4F)
_LOW = np.uint64(7)


# ---------------------------------------------------------------- keys of n-grams


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def word_key(word: bytes) -> int:
    """64 bits of a hash; the lowest three tell the length of the n-gram, here one."""
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little") & ~7 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


class Grams:
    """The n-grams of a run of documents, given the numbers of their tokens, the words' keys, and the documents' lengths.

    ``keys`` are the keys of all different n-grams in order: of words, of longer ones, and of the start signs before each
    document. ``sizes`` says how many there are of each kind.
    """

    def __init__(self, numbers: np.ndarray, words: np.ndarray, lengths: np.ndarray, order: int, inverse: bool = True):
        pad = order - 1
        self.order = order
        self.first = np.cumsum(lengths) - lengths  # the first token of each document
        at = np.arange(len(numbers)) + pad * (np.repeat(np.arange(len(lengths)), lengths) + 1)
        line = np.full(len(numbers) + pad * len(lengths), START)
        line[at] = words[numbers]
        found, counts = [words], [np.bincount(numbers, minlength=len(words))]
        heads, before = [START], line
        self.where: dict[int, np.ndarray] = {1: numbers}
        for k in range(2, order + 1):
            grown = before.copy()
            grown[1:] = _mix(before[:-1] * _A + line[1:]) & ~_LOW | np.uint64(k)
            before = grown
            if inverse:
                values, self.where[k], times = np.unique(before[at], return_inverse=True, return_counts=True)
            else:
                values, times = np.unique(before[at], return_counts=True)
            found.append(values)
            counts.append(times)
            if k < order:
                heads.append(before[at[0] - 1])
        found.append(np.array(heads, np.uint64))
        counts.append(np.full(len(heads), len(lengths)))
        self.sizes = [len(f) for f in found]
        every = np.concatenate(found)
        self.sorted = np.argsort(every)
        self.keys, self.counts = every[self.sorted], np.concatenate(counts)[self.sorted]

    def per_token(self, values: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """From a value for each key: those of the k-gram that ends at each token, and of the k - 1 tokens before it."""
        every = np.empty_like(values)
        every[self.sorted] = values
        *shares, heads = np.split(every, np.cumsum(self.sizes)[:-1])
        full = {k: shares[k - 1][self.where[k]] for k in range(1, self.order + 1)}
        context = {}
        for k in range(2, self.order + 1):
            context[k] = np.concatenate([full[k - 1][:1], full[k - 1][:-1]])
            context[k][self.first] = heads[k - 2]
        return full, context


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes before all second ones, so that what is always zero compresses away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


# ---------------------------------------------------------------- chunks of documents


class _Numbers(dict):
    """Numbers of words, given in order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Chunk:
    """Documents of one kind, as numbers of words in order of first use."""

    def __init__(self):
        self.numbers = _Numbers()
        self.docs: list = []
        self.lengths: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc, text: str | None) -> None:
        words = words_of(text)
        words.append(END)
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.docs.append(doc)
        self.lengths.append(len(words))
        self.bytes += len(text or "")

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the tokens, keys of the words, lengths of the documents."""
        words = np.fromiter(map(word_key, self.numbers), np.uint64, len(self.numbers))
        return np.concatenate(self.tokens), words, np.array(self.lengths, np.int64)

    def name(self, kind: int, arrays: tuple) -> int:
        """A hash of the content, so that it is the same if the chunk is built again."""
        digest = blake2b(digest_size=8)
        for part in arrays:
            digest.update(part)
        digest.update(repr((kind, self.docs)).encode())
        return int.from_bytes(digest.digest(), "little", signed=True)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Chunk]]:
    """Chunks of the rows of a task (``doc_id, kind, text``), each of about ``CHUNK_BYTES`` or of one longer document."""
    open_: dict[int, _Chunk] = {}
    for batch in batches:
        for piece in bounded(batch, "text", 1 << 20):
            for doc, kind, text in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "kind", "text")), strict=True):
                chunk = open_.setdefault(kind, _Chunk())
                chunk.add(doc, text)
                if chunk.bytes >= CHUNK_BYTES:
                    yield kind, open_.pop(kind)
    yield from open_.items()


def _counts(texts: DataFrame, order: int, parts: int) -> DataFrame:
    """``part, chunk, kind, keys, counts``: the sorted n-gram keys of each chunk, cut into ranges of equal width."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, chunk in _chunks(batches):
            arrays = chunk.arrays()
            name = chunk.name(kind, arrays)
            del chunk
            grams = Grams(*arrays, order, inverse=False)
            keys, counts = grams.keys, grams.counts
            cuts = np.searchsorted(keys, edges)
            rows = []
            for part, (own, n) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)):
                if len(own):
                    rows.append((part, name, kind, _planes(np.diff(own, prepend=np.uint64(0))), _planes(n.astype(np.uint32))))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "kind", "keys", "counts"])

    return texts.mapInArrow(run, "part int, chunk long, kind int, keys binary, counts binary")


def _totals(counts: DataFrame) -> DataFrame:
    """What each chunk's n-grams count in all training documents (``total``) and in the ``counted`` ones alone.

    The rows of a part are added up in one task: a range of hashes, of a size that doesn't grow with the corpus, in which
    every n-gram, however frequent, has one entry per chunk. An answer lists the counts in the order of the chunk's keys.
    A row without chunk has the tokens and different words of the part.
    """

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = [np.cumsum(_unplanes(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        keys = np.unique(np.concatenate(own))
        sums = np.zeros((2, len(keys)), np.int64)
        at = [np.searchsorted(keys, k) for k in own]
        for r, where in zip(rows, at, strict=True):
            if r["kind"] != HELD_OUT:
                sums[r["kind"]][where] += _unplanes(r["counts"], np.uint32)
        counted, total = sums[COUNTED], sums.sum(axis=0)
        words = (keys & _LOW) == 1
        out = [(r["chunk"], r["kind"], r["part"], _planes(total[w]), _planes(counted[w]) if r["kind"] == DELETED else None, 0, 0, 0)
               for r, w in zip(rows, at, strict=True)]
        out.append((None, None, rows[0]["part"], None, None, int(total[words].sum()), int(counted[words].sum()), int((total[words] > 0).sum())))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["chunk", "kind", "part", "total", "counted", "n_total", "n_counted", "n_words"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "chunk long, kind int, part int, total binary, counted binary, n_total long, n_counted long, n_words long"
    return counts.groupBy("part").applyInArrow(add, schema)


def _chunk_rows(texts: DataFrame) -> DataFrame:
    """``chunk, kind, docs, tokens, lengths, words``: a row for each chunk."""
    kind_of_id = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def seen(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in items:
                id_type = batch.column("doc_id").type
                yield batch

        for kind, chunk in _chunks(seen(batches)):
            tokens, words, lengths = arrays = chunk.arrays()
            packed = (zlib.compress(_planes(tokens), 1), lengths.tobytes(), words.tobytes())
            columns = [pa.array([chunk.name(kind, arrays)], pa.int64()), pa.array([kind], pa.int32()), pa.array([chunk.docs], pa.list_(id_type)),
                       *(pa.array([x], pa.binary()) for x in packed)]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "kind", "docs", "tokens", "lengths", "words"])

    return texts.mapInArrow(run, f"chunk long, kind int, docs array<{kind_of_id}>, tokens binary, lengths binary, words binary")


def _answered(row: dict, answers: pa.Table, column: str, order: int) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, np.ndarray]]:
    """The lengths of a chunk's documents, and for each token what its n-grams and their contexts count."""
    sizes = np.frombuffer(row["lengths"], np.int64)
    numbers = _unplanes(zlib.decompress(row["tokens"]), np.uint32)
    grams = Grams(numbers, np.frombuffer(row["words"], np.uint64), sizes, order)
    by_part = dict(zip(answers.column("part").to_pylist(), answers.column(column).to_pylist(), strict=True))
    values = np.concatenate([np.zeros(0, np.int64), *[_unplanes(by_part[p], np.int64) for p in sorted(by_part)]])
    if len(values) != len(grams.keys):
        raise RuntimeError("the documents were read in another order than when they were counted; store them first")
    return sizes, *grams.per_token(values)


# ---------------------------------------------------------------- weights


def bucket(count: Column) -> Column:
    """The class of a context frequency: 0 for none, else the number of its binary digits."""
    return F.when(count <= 0, 0).otherwise(F.least(F.length(F.bin(count)), F.lit(LEVELS - 1)))


def _buckets(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(counts, 0))[1], LEVELS - 1)


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a table, and how often each stands there."""
    order = np.lexsort(columns)
    rows = np.stack(columns, axis=1)[order]
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    return rows[new], np.diff(np.r_[new, len(rows)])


def _events(chunks: DataFrame, answers: DataFrame, order: int) -> DataFrame:
    """The tokens of the deleted documents, as the counts that the others give: equal ones are one row with ``times``."""
    names = [f"c{k}" for k in range(1, order + 1)] + [f"d{k}" for k in range(2, order + 1)]

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            _, full, context = _answered(row, right, "counted", order)
            columns = [*[full[k] for k in range(1, order + 1)], *[context[k] for k in range(2, order + 1)]]
            rows, times = _distinct(columns)
            out.append(np.concatenate([rows, times[:, None]], axis=1))
        found = np.concatenate(out) if out else np.zeros((0, len(names) + 1), np.int64)
        return pa.table([pa.array(c) for c in np.ascontiguousarray(found.T)], names=[*names, "times"])

    schema = ", ".join(f"{n} long" for n in [*names, "times"])
    found = chunks.filter(F.col("kind") == DELETED).groupBy("chunk").cogroup(answers.filter(F.col("kind") == DELETED).groupBy("chunk"))
    return found.applyInArrow(look, schema).groupBy(*names).agg(F.sum("times").alias("times"))


def learn_weights(events: DataFrame, order: int, n_counted: int, n_words: int, rounds: int = ROUNDS) -> dict[int, list[float]]:
    """For each level the weight of its relative frequency, by class of context frequency, against all levels below.

    Level 1 has one class. Each round is one aggregation of the events, whose sums, a pair per level and class, come to the
    driver: how often a token was reached at that level, and how often it was drawn there. Half a token of each kind is
    added, so a class without tokens has weight 0.5.
    """
    weights = {k: [0.5] * (LEVELS if k > 1 else 1) for k in range(1, order + 1)}
    uniform = F.lit(1.0 / (n_words + 1))
    where = {k: bucket(F.col(f"d{k}")) if k > 1 else F.lit(0) for k in weights}
    ml = {k: F.when(F.col(f"d{k}") > 0, F.col(f"c{k}") / F.col(f"d{k}")).otherwise(0.0) for k in range(2, order + 1)}
    ml[1] = F.col("c1") / F.lit(float(max(1, n_counted)))
    base = events.select("times", *[where[k].alias(f"b{k}") for k in weights], *[ml[k].cast("double").alias(f"m{k}") for k in weights])
    base = stage(base, "events")
    for _ in range(rounds):
        weight = {k: F.get(F.array(*[F.lit(w) for w in weights[k]]), F.col(f"b{k}")) for k in weights}
        p = {0: uniform}
        rows = base
        for k in range(1, order + 1):
            p[k] = F.col(f"p{k}")
            rows = rows.withColumn(f"p{k}", weight[k] * F.col(f"m{k}") + (1 - weight[k]) * p[k - 1])
        reached = F.col("times").cast("double")
        sums = []
        for k in range(order, 0, -1):
            drawn = reached * weight[k] * F.col(f"m{k}") / p[k]
            sums.append(F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("b"), drawn.alias("drawn"), reached.alias("reached")))
            reached = reached - drawn
        got = rows.select(F.explode(F.array(*sums)).alias("s")).select("s.*").groupBy("k", "b").agg(F.sum("drawn").alias("drawn"), F.sum("reached").alias("reached"))
        new = {k: [0.5] * len(w) for k, w in weights.items()}
        for r in got.collect():  # at most a row for each level and class
            new[r["k"]][r["b"]] = (r["drawn"] + 0.5) / (r["reached"] + 1)
        moved = max(abs(a - b) for k in new for a, b in zip(new[k], weights[k], strict=True))
        weights = new
        if moved < 1e-4:
            break
    return weights


# ---------------------------------------------------------------- the operator


def _kinds(id_col: str) -> Column:
    """Held out; or, of the others, one of eight by another digit of the same hash, whose counts teach the weights."""
    code = F.crc32(F.col(id_col).cast("string"))
    return F.when(code % 7 == 2, HELD_OUT).when(F.floor(code / 7) % 8 == 0, DELETED).otherwise(COUNTED)


def score_texts(
    docs: DataFrame, order: int = ORDER, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Documents whose crc32(id as text) mod 7 is 2 are held out; all others are counted. Tokens are runs of other characters
    than space and U+0009 to U+000D, A-Z lower-cased, and one end. ``score`` is the model's log10 probability of the text,
    ``base_score`` that of word counts with one added. A null or empty text is its end alone. A document with a null id is
    not held out. Repeated rows are documents of their own and get equal scores. An empty table gives no rows; without any
    training document the base is 0 and words are all unknown. Extra columns play no part. ``order`` is 2 to 6.

    Every n-gram of every training document is counted. A task packs its documents into chunks and sorts each chunk's
    n-grams; the counts of a range of hashes are added up in one task, which answers every chunk, held out or not, in
    the order it asked. So neither texts nor words per document are shuffled for counting, no n-gram is a hot key,
    and no table of n-grams is ever in one place. ``docs`` is read twice, in the same order; store a plan that isn't stable.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    ship_package(docs.sparkSession)
    texts = keyed_text(docs, id_col, text_col).withColumn("kind", _kinds("doc_id"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    answers = stage(_totals(_counts(texts, order, max(1, -(-size // PART_BYTES)))), "totals")
    sums = answers.filter("chunk IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_total", "n_counted", "n_words")]).first()
    n_total, n_counted, n_words = sums
    answers = answers.filter("chunk IS NOT NULL").select("chunk", "kind", "part", "total", "counted")
    chunks = _chunk_rows(texts)
    deleted = _chunk_rows(texts.filter(F.col("kind") == DELETED))
    weights = learn_weights(_events(deleted, answers, order), order, n_counted, n_words, rounds)
    table = {k: np.array(w) for k, w in weights.items()}
    id_kind = texts.schema["doc_id"].dataType.simpleString()

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = []
        id_type = left.schema.field("docs").type.value_type
        for row in left.to_pylist():
            sizes, full, context = _answered(row, right, "total", order)
            ones = full[1].astype(np.float64)
            p = np.full(len(ones), 1.0 / (n_words + 1))
            p = table[1][0] * ones / max(1, n_total) + (1 - table[1][0]) * p
            for k in range(2, order + 1):
                seen, own = context[k].astype(np.float64), full[k].astype(np.float64)
                weight = table[k][_buckets(seen)]
                p = weight * np.divide(own, seen, out=np.zeros_like(own), where=seen > 0) + (1 - weight) * p
            base = np.log10((ones + 1) / (n_total + n_words + 1))
            starts = np.cumsum(sizes) - sizes
            held = [row["kind"] == HELD_OUT] * len(sizes)
            sums = [np.add.reduceat(x, starts) for x in ((ones > 0).astype(np.int64), base, np.log10(p))]
            pieces.append(pa.table({
                "doc_id": pa.array(row["docs"], id_type), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(sizes),
                "n_known": pa.array(sums[0]), "train_tokens": pa.array([n_total] * len(sizes), pa.int64()),
                "base_score": pa.array(sums[1]), "score": pa.array(sums[2]),
            }))
        return pa.concat_tables(pieces) if pieces else _none(id_type)

    def _none(id_type: pa.DataType) -> pa.Table:
        kinds = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array([], k) for k in kinds], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(look, schema)


# ---------------------------------------------------------------- the definition, for tests


def brute_force(docs: list[tuple], order: int = ORDER, rounds: int = ROUNDS) -> dict:
    """Counted, learned and scored token by token: ``{doc_id: (held_out, n_tokens, n_known, train_tokens, base, score)}``."""
    from collections import Counter

    kinds, lines = {}, {}
    for doc, text in docs:
        code = zlib.crc32(str(doc).encode())
        kinds[doc] = HELD_OUT if code % 7 == 2 else DELETED if code // 7 % 8 == 0 else COUNTED
        lines[doc] = [b"\t"] * (order - 1) + words_of(text) + [END]

    def count(wanted: tuple) -> Counter:
        out: Counter = Counter()
        for doc, line in lines.items():
            if kinds[doc] in wanted:
                for i in range(order - 1, len(line)):
                    out.update(tuple(line[i - k + 1 : i + 1]) for k in range(1, order + 1))
                out.update((b"\t",) * k for k in range(1, order))
        return out

    counted, total = count((COUNTED,)), count((COUNTED, DELETED))
    n_counted, n_total = (sum(n for g, n in c.items() if len(g) == 1 and g != (b"\t",)) for c in (counted, total))
    n_words = sum(1 for g in total if len(g) == 1 and g != (b"\t",))

    def level(n: int) -> int:
        return min(n.bit_length(), LEVELS - 1)

    def steps(line: list, i: int, counts: Counter, n: int) -> list[tuple[int, int, float]]:
        out = [(1, 0, counts[(line[i],)] / max(1, n))]
        for k in range(2, order + 1):
            seen = counts[tuple(line[i - k + 1 : i])]
            out.append((k, level(seen), counts[tuple(line[i - k + 1 : i + 1])] / seen if seen else 0.0))
        return out

    events = [steps(line, i, counted, n_counted) for doc, line in lines.items() if kinds[doc] == DELETED for i in range(order - 1, len(line))]
    weights: dict = {}

    def chances(event: list) -> list[float]:
        p = [1 / (n_words + 1)]
        for k, b, m in event:
            w = weights.get((k, b), 0.5)
            p.append(w * m + (1 - w) * p[-1])
        return p

    for _ in range(rounds):
        drawn, reached = Counter(), Counter()
        for event in events:
            p, left = chances(event), 1.0
            for k, b, m in reversed(event):
                reached[k, b] += left
                part = left * weights.get((k, b), 0.5) * m / p[k]
                drawn[k, b] += part
                left -= part
        new = {key: (drawn[key] + 0.5) / (n + 1) for key, n in reached.items()}
        moved = max((abs(w - weights.get(key, 0.5)) for key, w in new.items()), default=0)
        weights = new
        if moved < 1e-4:
            break
    out = {}
    for doc, line in lines.items():
        own = range(order - 1, len(line))
        ones = [total[(line[i],)] for i in own]
        base = sum(math.log10((c + 1) / (n_total + n_words + 1)) for c in ones)
        score = sum(math.log10(chances(steps(line, i, total, n_total))[-1]) for i in own)
        out[doc] = (kinds[doc] == HELD_OUT, len(ones), sum(c > 0 for c in ones), n_total, base, score)
    return out

"""Packing documents into training sequences by minimum bin slack."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from litscreen.llm.common import bounded, giving_back, keyed_text, ship_package

CAPACITY = 4096
POOL = 1024  # pieces that wait to be packed; twice as many start a round of packing

# Characters whose lower case, normal form and class need no context: printable ASCII and Latin-1 letters.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿß]+")
PLAIN_TEXT = re.compile(r"[!-~À-ÖØ-öø-ÿß \n]+")
# How the tokenizer file splits such text, lower-cased.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zßà-öø-ÿ]+|[0-9]|[^a-z0-9ßà-öø-ÿ \n]+")
# A worker process keeps these tables for as long as it lives, beside whatever other stages hold then: with entries of at
# most ``KEPT_CHARS`` characters they are some tens of megabytes.
CHUNKS_KEPT, WORDS_KEPT, KEPT_CHARS = 150_000, 80_000, 32


class WordTable(dict):
    """Ids of lower-cased plain words. When the table is full, further words go to that of the chunks, while it has room."""

    def __init__(self, tokenizer, chunks: dict[str, bytes]):
        self.model, self.chunks = tokenizer.model, chunks
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.byte_letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, word: str) -> bytes:
        got = self.chunks.get(word)  # a word alone is a chunk of the same ids
        if got is None:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_letters)
            ids = [x.id for x in self.model.tokenize(letters)]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= KEPT_CHARS:
                if len(self) < WORDS_KEPT:
                    self[word] = got
                elif len(self.chunks) < CHUNKS_KEPT:
                    self.chunks[word] = got
        return got


class ChunkEncoder:
    """Ids of a tokenizer whose words never cross a space, as little-endian unsigned 32-bit integers.

    A text of plain characters goes word by word to the tokenizer's model, and each distinct word is encoded once per
    process while the tables have room. Any other text is cut at spaces and line ends: its plain pieces go the same way,
    the others through the whole tokenizer, so the ids are those of the whole text in every case.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.chunks: dict[str, bytes] = {"": b""}
        self.words = WordTable(self.tokenizer, self.chunks)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, SPLIT.findall(text.lower())))

    def chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk):
            got = self.plain(chunk)
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.chunks) < CHUNKS_KEPT and len(chunk) <= KEPT_CHARS:
            self.chunks[chunk] = got
        return got

    def __call__(self, text: str) -> bytes:
        if PLAIN_TEXT.fullmatch(text):
            return self.plain(text)
        pieces = text.replace("\n", " ").split(" ")
        known, chunk = self.chunks.get, self.chunk
        found = [known(p) for p in pieces]
        return b"".join(f if f is not None else chunk(p) for f, p in zip(found, pieces, strict=True))


_ENCODERS: dict[int, ChunkEncoder] = {}


def encoder(tokenizer_json: str) -> ChunkEncoder:
    """One encoder per Python process and tokenizer, so tasks that follow find its tables filled."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(tokenizer_json)
    return _ENCODERS[key]


def fullest(counts: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """Which lengths, and how many of each, come closest to ``capacity`` without passing it.

    ``counts`` lists (length, how many are left). The set of reachable sums is one integer, a bit per sum; a length joins
    it by shifts and ors, and the sets in between are kept for going back from the best sum to the counts. No further
    length is looked at once the capacity itself is reached.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, kept, used = 1, [], []
    for length, n in counts:
        if length > capacity:
            continue
        kept.append(reach)
        used.append((length, n))
        step, left = 1, min(n, capacity // length)
        while left:  # 1, 2, 4, ... and the rest: every count up to n
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        if reach >> capacity & 1:
            break
    best = reach.bit_length() - 1
    chosen = []
    for (length, n), before in zip(reversed(used), reversed(kept), strict=True):
        k = 0
        while not before >> best & 1:
            best -= length
            k += 1
        if k:
            chosen.append((length, k))
    return chosen


class Packer:
    """Pieces of token ids in, filled sequences out: lists of (document, start, ids), gapless from 0.

    Every sequence holds exactly ``capacity`` tokens but the last ones of a task, which hold a power of two.
    """

    def __init__(self, capacity: int = CAPACITY, pool: int = POOL):
        self.capacity, self.pool = capacity, pool
        self.by_length: dict[int, list[tuple]] = {}
        self.waiting = self.tokens = 0

    def add(self, doc, ids: bytes) -> Iterator[list[tuple]]:
        n, full = len(ids) // 4, self.capacity
        cut = n - n % full
        for start in range(0, cut, full):
            yield [(doc, start, ids[4 * start : 4 * (start + full)])]
        if n > cut:
            self._hold(doc, cut, ids[4 * cut :])
        if self.waiting >= 2 * self.pool:
            yield from self._fill(self.pool)

    def _hold(self, doc, start: int, ids: bytes) -> None:
        self.by_length.setdefault(len(ids) // 4, []).append((doc, start, ids))
        self.waiting += 1
        self.tokens += len(ids) // 4

    def _take(self, length: int) -> tuple:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
        self.waiting -= 1
        self.tokens -= length
        return piece

    def _fill(self, leave: int) -> Iterator[list[tuple]]:
        while self.waiting > leave and self.tokens >= self.capacity:
            first = max(self.by_length)  # the longest piece is the hardest to place
            out = [self._take(first)]
            room = self.capacity - first
            counts = [(n, len(self.by_length[n])) for n in sorted(self.by_length, reverse=True)]
            for length, k in fullest(counts, room):
                out += [self._take(length) for _ in range(k)]
                room -= length * k
            if room:  # no set of whole pieces fits exactly: one piece is cut, and its rest waits on
                doc, start, ids = self._take(max(self.by_length))
                out.append((doc, start, ids[: 4 * room]))
                self._hold(doc, start + room, ids[4 * room :])
            yield out

    def finish(self) -> Iterator[list[tuple]]:
        """Whole sequences while there are tokens for one, then powers of two, so that nothing is padded."""
        yield from self._fill(0)
        rest = [self._take(max(self.by_length)) for _ in range(self.waiting)]
        tokens, size = sum(len(p[2]) // 4 for p in rest), self.capacity
        while tokens:
            while size > tokens:
                size //= 2
            out, room = [], size
            while room:
                doc, start, ids = rest.pop(0)
                n = len(ids) // 4
                out.append((doc, start, ids[: 4 * room]))
                if n > room:
                    rest.insert(0, (doc, start + room, ids[4 * room :]))
                room -= min(n, room)
            tokens -= size
            yield out


PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    pool: int = POOL,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: where it starts in its document and where it lies in which sequence.

    Each task packs the rows it reads, so nothing is shuffled, no task sees more than its own split, and a retried task
    gives the same pieces again. ``sequence_id`` counts on within the task, whose number is in its upper bits. A null text
    is empty and gives the end id alone; null ids stay null; repeated rows are packed once each; an empty table gives no
    sequence; extra columns play no part. ``capacity`` must be a power of two. ``with_ids`` adds ``ids`` (binary, the
    piece's tokens). The tokenizer file's bytes are sent to the tasks, which need not see its path.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    texts = keyed_text(docs, id_col, text_col)
    ship_package(texts.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = texts.sparkSession.sparkContext.broadcast(file.read())
    end = struct.pack("<I", end_id)
    schema = PIECES.format(id=texts.schema["doc_id"].dataType.simpleString()) + (", ids binary" if with_ids else "")
    kinds = [pa.int64()] * 6 + ([pa.binary()] if with_ids else [])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(sent.value), Packer(capacity, pool)
        sequence = TaskContext.get().partitionId() << 40
        id_type = pa.null()
        rows: list[tuple] = []

        def lay(filled: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for (doc, total), start, ids in filled:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset, *([ids] if with_ids else [])))
                offset += n
            sequence += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            arrays = [pa.array(c, type=k) for c, k in zip(columns, [id_type, *kinds], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for piece in bounded(batch, "text"):
                id_type = piece.column("doc_id").type
                ids = piece.column("doc_id").to_pylist()
                for doc, text in zip(ids, piece.column("text").to_pylist(), strict=True):
                    tokens = (encode(text) if text else b"") + end
                    for filled in packer.add((doc, len(tokens) // 4), tokens):
                        lay(filled)
                if rows:
                    yield flushed()
        for filled in packer.finish():
            lay(filled)
        if rows:
            yield flushed()

    return texts.mapInArrow(giving_back(run), schema)


def encode_texts(tokenizer_path: str) -> Callable[[str], list[int]]:
    """The plain tokenizer, for tests."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids

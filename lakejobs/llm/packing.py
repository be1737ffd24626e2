"""Cost-balanced packing of tokenised documents into training sequences.

Documents are tokenised where they are read and packed in blocks of about
``block_tokens`` tokens of one input partition, so no token is shuffled and a
block's size is bounded whatever the input. Within a block every document
piece has a cost linear in its length plus quadratic in it (attention), and
pieces go, costliest first, to the cheapest sequence with room left. A piece
that fits nowhere whole is cut: it fills the cheapest open sequence, and the
rest goes on as a piece of its own. Capacities of a block's sequences add up to
its tokens exactly: full ones, and for the remainder sequences of lengths that
are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.llm.common import raw

SEQUENCE_TOKENS = 4096
LINEAR_COST = 1.0
QUADRATIC_COST = 1.0 / 4096
BLOCK_TOKENS = 1 << 21
CACHE_CHUNKS = 400_000
# Texts of these characters only are split here; others go to the tokenizer whole.
PLAIN_CHARS = 0x180


def _char_class(*kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_CHARS) if unicodedata.category(chr(c)).startswith(kinds))


def _byte_chars() -> dict[int, str]:
    """The vocabulary's character for each byte: printable Latin-1 characters
    stand for themselves, the other bytes for U+0100 onwards in their order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (c for c in range(256) if c not in printable)
    return {c: chr(c) for c in printable} | {c: chr(0x100 + i) for i, c in enumerate(rest)}


class _Chunks(dict):
    """Ids of white-space-free chunks, worked out on first use."""

    def __init__(self, tokenizer: WordTokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> bytes:
        t = self.tokenizer
        ids = self[chunk] = b"".join(map(t.word_ids, t.word.findall(chunk)))
        return ids


class WordTokenizer:
    """Token ids of whole texts, with the ids of single words remembered.

    The vocabulary's rules lower-case a text, split it at white space and cut
    the chunks into words that are encoded on their own, so the ids of a chunk
    can be reused. Both caches are emptied when they reach ``CACHE_CHUNKS``;
    ids don't depend on them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        letters, digits = _char_class("L"), _char_class("N")
        # characters whose case, composition or white space Python treats in another way
        self.odd = re.compile(f"[^\\x00-\\x1b\\x20-\u012f\u0131-{chr(PLAIN_CHARS - 1)}]")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.word = re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{letters}{digits}]+")
        self.byte_chars = _byte_chars()
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def word_ids(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            spelled = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.byte_chars)
            ids = self.words[word] = b"".join(t.id.to_bytes(4, "little") for t in self.merge(spelled))
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks.clear()
        if len(self.words) > CACHE_CHUNKS:
            self.words.clear()
        get = self.chunks.__getitem__
        out = [None if self.odd.search(t) or any(s in t for s in self.special)
               else b"".join(map(get, t.lower().split())) for t in texts]
        odd = iter(self.whole([t for t, ids in zip(texts, out) if ids is None]))
        return [next(odd) if ids is None else ids for ids in out]


def capacities(tokens: int, size: int) -> list[int]:
    """Sequence lengths that hold ``tokens`` exactly without padding: full
    sequences, then the powers of two of the remainder."""
    rest = tokens % size
    return [size] * (tokens // size) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill
    ``capacities(sum(lengths), size)``."""
    room = capacities(sum(lengths), size)
    used = [0] * len(room)
    pieces = []

    def put(doc, start, n, seq):
        pieces.append((doc, start, n, seq, used[seq]))
        used[seq] += n
        room[seq] -= n

    # whole sequences of long documents cost most and come first
    seq, rests = 0, []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= size:
            put(doc, start, size, seq)
            seq += 1
            start += size
        if n > start:
            rests.append((n - start, doc, start))
    # equal lengths cost the same, so descending length is descending cost
    rests = [(-n, doc, start) for n, doc, start in rests]
    heapq.heapify(rests)
    open_ = _Open(size)
    for s in range(seq, len(room)):
        open_.add(room[s], 0.0, s)
    while rests:
        n, doc, start = heapq.heappop(rests)
        n = -n
        found = open_.cheapest(n)
        if found is None:  # fits nowhere whole: fill the cheapest and carry on with the rest
            found = open_.cheapest(1)
            take = room[found[1]]
            heapq.heappush(rests, (take - n, doc, start + take))
            n = take
        cost, s = found
        open_.remove(room[s])
        put(doc, start, n, s)
        if room[s]:
            open_.add(room[s], cost + linear * n + quadratic * n * n, s)
    return pieces


class _Open:
    """Open sequences by remaining room: a heap of (cost, sequence) for each
    room, and over them a tree of minima that gives the cheapest with at least
    so much room."""

    NONE = (float("inf"), -1)

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.heaps: list[list] = [[] for _ in range(self.width)]
        self.least = [self.NONE] * (2 * self.width)

    def _update(self, room: int):
        least, i = self.least, self.width + room
        least[i] = self.heaps[room][0] if self.heaps[room] else self.NONE
        while i > 1:
            i >>= 1
            least[i] = min(least[2 * i], least[2 * i + 1])

    def add(self, room: int, cost: float, seq: int):
        heapq.heappush(self.heaps[room], (cost, seq))
        self._update(room)

    def remove(self, room: int):
        """Take out the cheapest sequence of exactly this room."""
        heapq.heappop(self.heaps[room])
        self._update(room)

    def cheapest(self, room: int) -> tuple[float, int] | None:
        """The cheapest (cost, sequence) with at least this room; None if none has it."""
        i = self.width + room
        best = self.least[i]
        while i > 1:
            if not i & 1:
                best = min(best, self.least[i + 1])
            i >>= 1
        return None if best is self.NONE else best


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in
                       ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
                      + [T.StructField("ids", T.BinaryType())])


def _pack_partition(path: str, end_id: int, size: int, linear: float, quadratic: float, block_tokens: int,
                    with_ids: bool):
    names = [f.name for f in PIECES.fields if with_ids or f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40  # sequence ids of this partition start here
        docs: list[tuple[int | None, bytes]] = []
        held = 0

        def flush():
            nonlocal first, docs, held
            lengths = [len(b) // 4 for _, b in docs]
            cols: list[list] = [[] for _ in PIECES.fields]
            for d, start, n, seq, offset in pack(lengths, size, linear, quadratic):
                doc_id, ids = docs[d]
                piece = ids[4 * start:4 * (start + n)]
                for c, v in zip(cols, (doc_id, start, n, zlib.crc32(piece), lengths[d], first + seq, offset,
                                       piece if with_ids else None)):
                    c.append(v)
            first += len(capacities(sum(lengths), size))
            docs, held = [], 0
            for i in range(0, len(cols[0]), 4096):
                arrays = [pa.array(c[i:i + 4096], pa.binary() if f.name == "ids" else pa.int64())
                          for c, f in zip(cols, PIECES.fields) if with_ids or f.name != "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.encode(texts)):
                    docs.append((doc_id, ids + end))
                    held += len(ids) // 4 + 1
                    if held >= block_tokens:
                        yield from flush()
        if docs:
            yield from flush()
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                   text_col: str = "text", size: int = SEQUENCE_TOKENS, linear: float = LINEAR_COST,
                   quadratic: float = QUADRATIC_COST, block_tokens: int = BLOCK_TOKENS,
                   with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, one row each: ``doc_id``, ``start`` (ids of the
    document before the piece), ``length``, ``ids_crc32``, ``doc_tokens`` (with
    the closing ``end_id``), ``sequence_id``, ``offset`` and, with
    ``with_ids``, ``ids`` (little-endian unsigned 32-bit).

    * every id of every row lies in exactly one piece, every sequence is filled
      without gaps to ``size`` or to a power of two below it;
    * null and empty texts are the ``end_id`` alone;
    * rows of one id, also repeated ones, are packed each on its own; a null id
      stays null; other columns are not read; an empty table gives no pieces;
    * ``tokenizer_path`` must exist on every executor. Blocks follow the input
      partitions, so a re-run task packs the same blocks again; another
      partitioning gives other, equally full sequences.
    """
    schema = PIECES if with_ids else T.StructType(PIECES.fields[:-1])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _pack_partition(tokenizer_path, end_id, size, linear, quadratic, block_tokens, with_ids), schema)

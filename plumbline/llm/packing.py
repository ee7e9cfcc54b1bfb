"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A document of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` in attention. Documents are cut into full sequences
from their start; what is left of them (fewer tokens than a sequence) is packed: within a window, rests go in
descending order to the sequence of lowest cost that still has room for them, and where none has room, the
sequence of lowest cost is filled and the rest of the rest waits its turn. A window closes as many sequences as
its tokens fill, so no sequence is padded; tokens left over go to the next window, and at the end of a partition
to sequences whose lengths are powers of two.

Rows need not meet: every partition packs its own, in windows of ``WINDOW_TOKENS``, so nothing is shuffled, no key
can be hot, and memory is bounded by a window, a batch and one document. Sequence ids are unique over all
partitions (partition number * 2^40 + number in it), not consecutive. A lost task is packed again as a whole.

Defined results: a null or empty text has just the closing id; repeated rows are packed each for itself; ties of
length keep the order of arrival; an empty table gives no rows; further columns are ignored; long texts are packed
whole.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import codec
from plumbline.llm.bpe import SPACES
from plumbline.llm.common import small_batches, table

SEQUENCE_TOKENS = 2048
WINDOW_TOKENS = 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
CLOSING_ID = 1
#: Units whose ids a worker keeps, and marks that end a word.
UNITS, ENDS = 150_000, frozenset(".,;:!?")


@lru_cache(1)
def _byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordEncoder:
    """ids of a lower-casing BPE vocabulary with word ends, where white space only separates words.

    Chunks between spaces are independent; inside a chunk the vocabulary's own model encodes each unit.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.units = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
        self.known: dict[str, list[int]] = {}
        self.alphabet = _byte_alphabet()
        self.chunks = codec.ChunkTable(self.ids)

    def unit(self, u: str) -> list[int]:
        if (ids := self.known.get(u)) is None:
            ids = [t.id for t in self.model.tokenize(u if u.isascii() and u.isalpha() else "".join(map(self.alphabet.__getitem__, u.encode())))]
            if len(self.known) < UNITS and len(u) <= codec.LONGEST:
                self.known[u] = ids
        return ids

    def ids(self, chunk: str) -> list[int]:
        if chunk.isascii():
            if chunk.isalpha():
                return self.unit(chunk)
            if chunk[-1:] in ENDS and chunk[:-1].isalpha():  # a word and its mark, two units
                return self.unit(chunk[:-1]) + self.unit(chunk[-1])
        else:
            chunk = "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
            if chunk.isalpha():
                return self.unit(chunk)
        return [i for u in self.units.findall(chunk) for i in self.unit(u)]

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for _, block in codec.text_blocks(texts):
            yield from codec.encode_chunks(self.chunks, pc.split_pattern(pc.ascii_lower(block), " "))
            self.chunks.forget()


def cost(n: float) -> float:
    return LINEAR * n + QUADRATIC * n * n


def balance(lengths: list[int], bins: int, size: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Fills ``bins`` sequences of ``size``: (document, start in it, length, bin) of each piece, (document, start) left.

    Every bin ends up full: the lengths have to add up to ``bins * size`` at least.
    """
    room, costs = np.full(bins, size), np.zeros(bins)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    queue, at, cut = [(lengths[i], i, 0) for i in order], 0, []
    pieces, left, full = [], [], 0
    while at < len(queue) or cut:
        # What was cut off a document comes back in its place of the descending order.
        if cut and (at == len(queue) or cut[-1][0] >= queue[at][0]):
            n, i, start = cut.pop()
        else:
            (n, i, start), at = queue[at], at + 1
        if full == bins:
            left.append((i, start))
            continue
        fits = np.where(room >= n, costs, np.inf)
        b = int(fits.argmin())
        if fits[b] == np.inf:
            b = int(np.where(room > 0, costs, np.inf).argmin())
        k = min(n, int(room[b]))
        pieces.append((i, start, k, b))
        room[b] -= k
        costs[b] += cost(k)
        full += room[b] == 0
        if n > k:
            cut.append((n - k, i, start + k))
            cut.sort()
    return pieces, left


class Packer:
    """Packs the ids of documents as they come; each method yields (doc, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, size: int = SEQUENCE_TOKENS, window: int = WINDOW_TOKENS):
        self.sequence, self.size, self.window = first_sequence, size, window
        self.rests: list[tuple[object, int, np.ndarray, int]] = []  # document, start, ids, its tokens
        self.held = 0

    def _piece(self, doc, start, ids, total, sequence, offset):
        return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset

    def add(self, doc, ids: np.ndarray):
        n = len(ids)
        whole = n - n % self.size
        for at in range(0, whole, self.size):
            yield self._piece(doc, at, ids[at : at + self.size], n, self.sequence, 0)
            self.sequence += 1
        if n > whole:
            self.rests.append((doc, whole, ids[whole:].copy(), n))
            self.held += n - whole
        if self.held >= self.window:
            yield from self.flush()

    def flush(self):
        bins = self.held // self.size
        if not bins:
            return
        pieces, left = balance([len(r[2]) for r in self.rests], bins, self.size)
        at = [0] * bins
        for i, start, k, b in pieces:
            doc, first, ids, total = self.rests[i]
            yield self._piece(doc, first + start, ids[start : start + k], total, self.sequence + b, at[b])
            at[b] += k
        self.sequence += bins
        self.rests = [(d, first + s, ids[s:], total) for i, s in left for d, first, ids, total in (self.rests[i],)]
        self.held = sum(len(r[2]) for r in self.rests)

    def close(self):
        yield from self.flush()
        room, at = 0, 0
        for doc, start, ids, total in self.rests:
            while len(ids):
                if not room:
                    room, at = 1 << (self.held.bit_length() - 1), 0
                k = min(room, len(ids))
                yield self._piece(doc, start, ids[:k], total, self.sequence, at)
                ids, start, room, at, self.held = ids[k:], start + k, room - k, at + k, self.held - k
                self.sequence += not room
        self.rests = []


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", size: int = SEQUENCE_TOKENS, window: int = WINDOW_TOKENS) -> DataFrame:
    """One row per piece: ``key`` and the columns of ``PIECES``. ``path`` is a vocabulary file on every executor."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in PIECES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.only(path, lambda: WordEncoder(path))
        packer = Packer(TaskContext.get().partitionId() << 40, size, window)
        arrow_kind = None

        def out(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow_kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for b in batches:
            arrow_kind = b.column(0).type
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder.batch(b.column(1)), strict=True):
                rows += packer.add(doc, np.append(ids, np.uint32(CLOSING_ID)))
                if len(rows) > 50_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)
        if rows := list(packer.close()):
            yield out(rows)

    return small_batches(docs.select(key, "text")).mapInArrow(run, f"`{key}` {kind}, {PIECES}")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

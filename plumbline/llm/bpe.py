"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly when each token encodes to itself and each
neighbouring pair encodes to that pair; so a non-deterministic transducer suffices whose states are (last token,
place in the trie of tokens) and which may end a token wherever the trie has one that is compatible with the last.
``Transducer`` determinises it on demand: a deterministic state is the set of live hypotheses with what they have
not agreed on, and a step emits the tokens that all hypotheses share. Every prefix has one encoding, so one
hypothesis always stands between tokens, the others inside one: lookahead is bounded by the longest token chain
still open. Transitions are kept in a table that is dropped when it exceeds ``MAX_TRANSITIONS``.

Decoding. ``Utf8Stream`` takes ids bit by bit and is an incremental UTF-8 state machine: bytes of an unfinished
character wait for the next token, malformed bytes become U+FFFD. ``Decoder`` runs the same machine over whole texts, with
a table of what each token does to its state.

Defined results for ``encode_documents``: null text counts as empty and gives no ids; rows are kept as they are,
repeats included; an empty table gives no rows; further columns are ignored; long texts are encoded whole (a
text is one row, so memory is bounded by the longest text); a null or repeated key is passed on as it is, and columns
of the input named like the result's play no part, as no rows meet there are no ties.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import codec
from plumbline.llm.common import small_batches, table

MAX_TRANSITIONS = 400_000
#: Code points with the property White_Space.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ARROW_SPACES = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def splitter(pattern: str) -> regex.Pattern:
    """``pattern`` with white space as the rank files' library understands it."""
    return regex.compile(pattern.replace("[^\\s", f"[^{SPACES}").replace("\\S", f"[^{SPACES}]").replace("\\s", f"[{SPACES}]"))


def halves(ranks: dict[bytes, int]) -> np.ndarray:
    """For each id the two ids whose merge makes it; (-1, -1) for single bytes, (-2, -2) for ids no merge reaches."""
    out = np.full((max(ranks.values()) + 1, 2), -2, np.int32)
    for token, rank in ranks.items():
        if len(token) == 1:
            out[rank] = -1
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks:
            out[rank] = ranks[parts[0]], ranks[parts[1]]
    return out


class Transducer:
    def __init__(self, ranks: dict[bytes, int], split: np.ndarray, most: int = MAX_TRANSITIONS):
        self.most = most
        self.left, self.right = split[:, 0].tolist(), split[:, 1].tolist()
        self.merge = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if a >= 0}
        # The trie: child[node * 256 + byte] is a node, token[node] its id or -1, more[node] whether it has children.
        self.child: dict[int, int] = {}
        self.token, self.more = [-1], [False]
        for text, rank in ranks.items():
            if self.left[rank] == -2:
                continue
            node = 0
            for byte in text:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.more.append(False)
                    self.more[node] = True
                node = self.child[key]
            self.token[node] = rank
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((-1, 0, ()),)
        self.numbers, self.states, self.ends = {start: 0}, [start], [()]
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` followed by those of ``b`` encode to just (a, b).

        They don't if some merge across the border, of what the border looks like at some time, comes before the
        merges that build the two sides; the sides are taken apart from the latest merge on.
        """
        key = a << 32 | b
        if (known := self.fits.get(key)) is not None:
            return known
        x, y, below, merge, left, right = a, b, 1 << 40, self.merge, self.left, self.right
        while True:
            made = merge.get((x, y))
            if made is not None and made < below:
                good = False
                break
            if left[x] < 0 and left[y] < 0:
                good = True
                break
            # The side that was merged last goes back one merge; at equal ranks the left side was merged first.
            if left[y] < 0 or (left[x] >= 0 and x > y):
                below, x = x, right[x]
            else:
                below, y = y + 1, left[y]
        if len(self.fits) > 2 * self.most:
            self.fits.clear()
        self.fits[key] = good
        return good

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        child, token, more = self.child, self.token, self.more
        live = []
        for last, node, pending in self.states[state]:
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            if more[to]:
                live.append((last, to, pending))
            t = token[to]
            if t >= 0 and (last < 0 or self.compatible(last, t)):
                live.append((t, 0, (*pending, t)))
        first = live[0][2]
        same = min(len(x[2]) for x in live)
        for _, _, p in live[1:]:
            while p[:same] != first[:same]:
                same -= 1
        if same:
            live = [(a, b, p[same:]) for a, b, p in live]
        key = tuple(sorted(live))
        to = self.numbers.get(key)
        if to is None:
            to = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.ends.append(next(p for _, node, p in key if node == 0))
        result = to, first[:same]
        self.steps[state << 8 | byte] = result
        return result

    def encode(self, data: bytes) -> list[int]:
        """ids of one match of the pattern."""
        if len(self.steps) > self.most:
            self.reset()
        out: list[int] = []
        state, get = 0, self.steps.get
        for byte in data:
            state, emitted = get(state << 8 | byte) or self._step(state, byte)
            if emitted:
                out += emitted
        out += self.ends[state]
        return out


class Utf8Stream:
    """Decodes ids as they come; ``feed`` gives the characters that are complete, ``close`` what is left."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        for i in ids:
            for byte in self.tokens[i]:
                self._byte(byte, out)
        return "".join(out)

    def _byte(self, byte: int, out: list[str]) -> None:
        if self.need:
            if self.low <= byte <= self.high:
                self.held += bytes((byte,))
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(self.held.decode())
                    self.held = b""
                return
            out.append("�")
            self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, b""
        if byte < 0x80:
            out.append(chr(byte))
            return
        if 0xC2 <= byte <= 0xDF:
            self.need = 1
        elif 0xE0 <= byte <= 0xEF:
            self.need = 2
            self.low, self.high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
        elif 0xF0 <= byte <= 0xF4:
            self.need = 3
            self.low, self.high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
        else:
            out.append("�")
            return
        self.held = bytes((byte,))

    @property
    def between(self) -> bool:
        return not self.need

    def close(self) -> str:
        left, self.need, self.held = "�" * bool(self.need), 0, b""
        return left


#: States of the UTF-8 machine: between characters, 1 to 3 bytes to come, after E0, ED, F0 and F4, malformed.
_BETWEEN, _ONE, _TWO, _THREE, _E0, _ED, _F0, _F4, _BAD = range(9)


def _byte_table() -> np.ndarray:
    """The machine's next state by state and byte."""
    t = np.full((9, 256), _BAD, np.int8)
    t[_BETWEEN, :0x80] = _BETWEEN
    t[_BETWEEN, 0xC2:0xE0], t[_BETWEEN, 0xE0:0xF0], t[_BETWEEN, 0xF0:0xF5] = _ONE, _TWO, _THREE
    for byte, state in ((0xE0, _E0), (0xED, _ED), (0xF0, _F0), (0xF4, _F4)):
        t[_BETWEEN, byte] = state
    for state, low, high, to in ((_ONE, 0x80, 0xC0, _BETWEEN), (_TWO, 0x80, 0xC0, _ONE), (_THREE, 0x80, 0xC0, _TWO), (_E0, 0xA0, 0xC0, _ONE), (_ED, 0x80, 0xA0, _ONE), (_F0, 0x90, 0xC0, _TWO), (_F4, 0x80, 0x90, _TWO)):
        t[state, low:high] = to
    return t


class Decoder:
    """Bytes of the decoded text of many ids, by the UTF-8 machine folded over tokens.

    ``moves[state, id]`` is the state after all bytes of a token. The machine runs over all ids; from between characters
    tokens of whole characters leave it there, so that it takes a run of them at one step. Where it ends between
    characters without a malformed byte, the bytes are the text; else ``Utf8Stream`` writes the replacements.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.counts = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        table = _byte_table()
        self.moves = np.repeat(np.arange(9, dtype=np.int8)[:, None], len(self.tokens), 1)
        for at in range(int(self.counts.max(initial=0))):
            longer = np.flatnonzero(self.counts > at)
            self.moves[:, longer] = table[self.moves[:, longer], self.flat[self.starts[longer] + at]]

    def _gather(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        counts = self.counts[ids]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.starts[ids] - ends + counts, counts) + np.arange(ends[-1])].tobytes()

    def run(self, ids: np.ndarray) -> int:
        """The machine's state after all ids."""
        moves, at, state = self.moves, 0, _BETWEEN
        for leaves in np.flatnonzero(moves[_BETWEEN][ids] != _BETWEEN).tolist():
            if leaves < at:
                continue
            at = leaves
            while at < len(ids):
                state, at = moves[state, ids[at]], at + 1
                if state in (_BETWEEN, _BAD):
                    break
            if state != _BETWEEN:
                break
        return int(state)

    def decode(self, ids: np.ndarray) -> bytes:
        if self.run(ids) == _BETWEEN:
            return self._gather(ids)
        stream = Utf8Stream(self.tokens)
        return (stream.feed(ids.tolist()) + stream.close()).encode()


class Encoder:
    """ids of whole texts: chunks that begin at a space are independent unless a space stands between white space."""

    odd = f"[{_ARROW_SPACES}] (?:[{_ARROW_SPACES}]|\\z)|\\x00"

    def __init__(self, ranks: dict[bytes, int], split: np.ndarray, pattern: str):
        self.pattern, self.transducer = splitter(pattern), Transducer(ranks, split)
        self.chunks = codec.ChunkTable(self.ids)

    def ids(self, text: str) -> list[int]:
        encode = self.transducer.encode
        return [i for piece in self.pattern.findall(text) for i in encode(piece.encode())]

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for _, block in codec.text_blocks(texts):
            odd = pc.match_substring_regex(block, self.odd).to_numpy(zero_copy_only=False)
            even = iter(())
            if not odd.all():
                marked = pc.replace_substring(block.filter(pa.array(~odd)), " ", "\x00 ")
                even = iter(codec.encode_chunks(self.chunks, pc.split_pattern(marked, "\x00")))
            for i, slow in enumerate(odd.tolist()):
                yield np.array(self.ids(block[i].as_py()), np.uint32) if slow else next(even)
            self.chunks.forget()


def _coder(path: str, pattern: str, split: bytes) -> tuple[Encoder, Decoder]:
    ranks = load_ranks(path)
    return Encoder(ranks, np.frombuffer(split, np.int32).reshape(-1, 2), pattern), Decoder(ranks)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True, key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids (array of int), ids_sha256, decoded_sha256`` of each row's ``text``.

    ``path`` is a file of ranks that every executor has. ``keep_ids=False`` leaves the ids out.
    """
    split = halves(load_ranks(path)).tobytes()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec.only((path, pattern), lambda: _coder(path, pattern, split))
        for b in batches:
            rows = []
            for ids in encoder.batch(b.column(1)):
                rows.append((len(ids), ids.astype(np.int32) if keep_ids else None, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoder.decode(ids)).hexdigest()))
            n, ids, a, c = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(list(ids), pa.list_(pa.int32())), pa.array(a, pa.string()), pa.array(c, pa.string())], [key, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    out = small_batches(docs.select(key, "text")).mapInArrow(run, schema)
    return out if keep_ids else out.drop("ids")


def decode_ids(rows: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key, text`` from ``key, ids``; null ids give empty text."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load_ranks(path))
        for b in batches:
            texts = [decoder.decode(np.array(x or [], np.int64)).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return rows.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)

"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Sets of n distinct shingles are put into bands of similar size. Two sets whose Jaccard similarity is at least t
differ in at most k = floor(n (1 - t) / t) elements, n being the smaller size. The domain of shingle hashes is cut into
parts, more than k differences can spoil: either k + 1 + m parts, of which 1 + m agree, or k / 2 + 1 + m parts of
which 1 + m hold one difference at most, each cut into inner parts of which all but one then agree. A set's signatures
are the hashes of what it has in each part, or in each choice of all inner parts but one (the enumerated subsets);
for small k in each pair of k + 2 parts. A set also signs for the band below if a partner may lie there. A signature
of fewer than two elements (or of none) counts only for sets with more than m parts that have such; other pairs agree
in a part that holds more. So sets that are similar enough share a signature, and a common passage alone seldom makes one.

1. One pass gives size, 128-bit digest and parity sketch of each document's set; equal sets are one class from then on.
2. A second pass signs. A task keeps one document of each set; of each signature one entry a window reaches the shuffle,
   and the sets of a window that share it are passed on as they are, dealt by pair. What meets gives buckets: the
   sets of a signature. Of the signatures that the same sets have, one stays.
3. Sketches (a lower bound on the difference) are joined to the buckets, and the sets of a bucket are compared by them:
   most of what shares a signature by chance ends here, before it could tie groups together. What is left makes links,
   and their components are the groups inside which similar sets can lie.
4. The sets of these groups are made once more and compared exactly, again after size and sketch.
5. Components of the exact links, their smallest doc_id, joined back to all documents.

Buckets and groups of more than ``BLOCK_SETS`` sets are compared in blocks: a few pivots link most of a dense group
directly, and what is still apart is dealt in pairs of blocks, those inside the largest component left out. A task emits
a link only between sets it has not joined yet, so links grow with the sets of a group and not with its pairs.

Defined results: null text counts as empty; an empty set is linked with nothing, not even another empty one; fewer
words than a shingle's make one shingle; a null doc_id gets its class's smallest id, if any; repeated rows are
kept; rows with one doc_id and different texts are sets of their own; an empty table gives no rows; further columns
are ignored; texts are read whole. Shingles are told apart by 64-bit hashes, sets by 128-bit digests of these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, NumericType, StructField, StructType

from plumbline.llm.codec import release, text_blocks
from plumbline.llm.common import erase, small_batches, table, written
from plumbline.llm.components import Forest, components

WINDOW_SIGNATURES = 1_000_000
KNOWN_SETS = 200_000
#: So many elements of sets a part of the signatures, about as many signatures.
PART_ELEMENTS = 2_000_000
BLOCK_SETS = 1_024
#: Broadcasts: rows of a few numbers, and bytes of pivots.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
PIVOT_ROUNDS = 2
PAIRS_UP_TO = 4
#: A band signs by single parts if a part then holds this many elements on average or k is above INNER_UP_TO (where
#: more signatures would cost too much), else by INNER_PARTS - 1 of INNER_PARTS inner parts; a signature stands for
#: LEAST_HELD elements at least, where the spare parts allow it.
FULL_PARTS, INNER_UP_TO, INNER_PARTS, LEAST_HELD = 5, 30, 4, 2
#: Blocks of a large group hold sets of one size class (sizes up to this ratio), about so many bytes each.
CLASS_RATIO, BLOCK_BYTES = 1.12, 8 << 20
#: Widths of sketches (powers of two), and words of sketches compared at once.
LEAST_SKETCH, MOST_SKETCH, SKETCH_PAIRS = 8, 15, 1 << 21
_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _M1
    h = (h ^ (h >> _U(27))) * _M2
    return h ^ (h >> _U(31))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    for _, block in text_blocks(texts):
        block = pc.ascii_lower(block)
        for c in "\t\n\v\f\r":
            block = pc.replace_substring(block, c, " ")
        lists = pc.split_pattern(block, " ")
        codes = lists.flatten().dictionary_encode()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in map(str.encode, codes.dictionary.to_pylist())), np.uint64, len(codes.dictionary))
        h = hashes[codes.indices.to_numpy(zero_copy_only=False)] if len(codes) else np.empty(0, np.uint64)
        full = h != 0
        ends = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        h = h[full]
        n = len(h)
        if n >= words:
            s = np.zeros(n - words + 1, np.uint64)
            for i in range(words):
                s = _mix(s * _U(0x9E3779B97F4A7C15) + h[i : n - words + 1 + i])
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(s[a : b - words + 1])
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for i in range(a, b):
                    one = _mix(one * _U(0x9E3779B97F4A7C15) + h[i])
                yield one
            else:
                yield np.empty(0, np.uint64)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


class Signer:
    """Signatures of sets for a similarity of ``percent`` or more."""

    def __init__(self, percent: int):
        self.percent = percent
        self.first = -(-percent // (100 - percent))  # smaller sets are similar only to equal ones
        self.lower = [self.first]
        self.growth = 1.5 if percent > 85 else 1.25  # wider bands cost more signatures where sets may differ more

    def differ(self, n: int) -> int:
        """How many elements at most are in one of two similar sets only, n being the smaller size."""
        return n * (100 - self.percent) // self.percent

    def _band(self, n: int) -> int:
        while self.lower[-1] <= n:
            self.lower.append(max(self.lower[-1] + 1, int(self.lower[-1] * self.growth)))
        return int(np.searchsorted(self.lower, n, "right")) - 1

    def sign(self, s: np.ndarray) -> list[np.ndarray]:
        n = len(s)
        if n < self.first:
            return []
        i = self._band(n)
        bands = [i]
        if i and n * self.percent <= (self.lower[i] - 1) * 100:
            bands.append(i - 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(s ^ _M1))])
        return [self._family(s, sums, f) for f in bands]

    def _family(self, s: np.ndarray, sums: np.ndarray, band: int) -> np.ndarray:
        lowest, k = self.lower[band], self.differ(self.lower[band + 1] - 1)
        if k <= PAIRS_UP_TO:
            tag, _ = self._tags(s, sums, band, k + 2)
            a, b = np.array(list(combinations(range(k + 2), 2))).T
            return _mix(tag[a] * _M2 + tag[b])
        one = lowest >= FULL_PARTS * k or k > INNER_UP_TO
        inner = 1 if one else INNER_PARTS
        good = k // (1 if one else 2)
        spare = 2 + good // (8 if lowest >= FULL_PARTS * k else 3 if one else 4)
        outer = good + 1 + spare
        tag, held = self._tags(s, sums, band, outer * inner)
        tag, held = tag.reshape(outer, inner), held.reshape(outer, inner)
        if not one:  # each part but one of the inner parts, for each of them
            tag = _mix(tag.sum(1, keepdims=True) - tag + np.arange(outer * inner, dtype=np.uint64).reshape(outer, inner) * _M2)
            held = held.sum(1, keepdims=True) - held
        for least in range(LEAST_HELD, 0, -1):
            enough = held >= least
            if int((~enough.all(1)).sum()) <= spare:
                return tag[enough]
        return tag.ravel()

    def _tags(self, s: np.ndarray, sums: np.ndarray, band: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and number of elements of each part of the domain."""
        at = np.searchsorted(s, (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64))
        at = np.concatenate([[0], at, [len(s)]])
        number = np.arange(parts, dtype=np.uint64) + (_U(band + 1) << _U(32))
        return _mix(sums[at[1:]] - sums[at[:-1]] + _U(0x9E3779B97F4A7C15) * number), np.diff(at)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the set's elements in each of a power of two of places, two an element or more: two sets differ in no
    fewer elements than sketches in places. A sketch folds to one of half the width."""
    width = 1 << max(LEAST_SKETCH, min(MOST_SKETCH, (2 * len(s) - 1).bit_length()))
    places = ((s * _M2) >> _U(40)).astype(np.int64) & (width - 1)
    return np.packbits((np.bincount(places, minlength=width) & 1).astype(np.uint8)).tobytes()


def folded(marks: list[bytes]) -> np.ndarray:
    """Sketches at the width of the narrowest, one a row."""
    least = min(map(len, marks))
    rows = []
    for m in marks:
        x = np.frombuffer(m, np.uint64)
        while x.nbytes > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        rows.append(x)
    return np.stack(rows)


def _sizes(docs: DataFrame, words: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            n, d, m = [], [], []
            for s in shingle_sets(b.column(1), words):
                n.append(len(s))
                d.append(digest(s) if len(s) else None)
                m.append(sketch(s) if len(s) else None)
            nodes = [x and _node(x) for x in d]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(nodes, pa.int64()), pa.array(m, pa.binary())], ["doc_id", "n_shingles", "digest", "node", "mark"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, node long, mark binary")


def _node(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def _signed(docs: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """Signatures packed by part: of each window one entry (with whether others of the window have it) a signature, and
    ``shared``, the pairs (signature, node) of those that several sets of the window have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        signer, known = Signer(percent), set()
        signatures: list[np.ndarray] = []
        nodes: list[int] = []
        counts: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not signatures:
                return
            sig, node = np.concatenate(signatures), np.repeat(np.array(nodes, np.int64), counts)
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            size = np.diff(np.concatenate([np.flatnonzero(new), [len(sig)]]))
            own = np.repeat(size > 1, size)
            shared = np.stack([sig[own].view(np.int64), node[own]], 1)
            # Passed on by pair, so that a signature that very many sets have is in every part.
            to = (_mix(shared[:, 0].view(np.uint64) + _mix(shared[:, 1].view(np.uint64))) % _U(parts)).astype(np.int64)
            by_part = np.argsort(to, kind="stable")
            shared, ends = shared[by_part], np.searchsorted(to[by_part], np.arange(parts + 1))
            sig, node, many = sig[new], node[new], size > 1
            part = (sig % _U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                mine = order[cuts[p] : cuts[p + 1]]
                names, index = np.unique(node[mine], return_inverse=True)
                small = np.uint16 if len(names) < 1 << 16 else np.uint32
                passed = shared[ends[p] : ends[p + 1]]
                if len(mine) or len(passed):
                    rows.append((p, sig[mine].tobytes(), names.tobytes(), index.astype(small).tobytes(), np.packbits(many[mine]).tobytes(), passed.tobytes()))
            signatures.clear()
            nodes.clear()
            counts.clear()
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], _PACKED)

        held = 0
        for b in batches:
            for s in shingle_sets(b.column(0), words):
                if len(s) < signer.first:
                    continue
                d = digest(s)
                if d in known:
                    continue
                if len(known) < KNOWN_SETS:
                    known.add(d)
                own = signer.sign(s)
                for x in own:
                    signatures.append(x)
                    nodes.append(_node(d))
                    counts.append(len(x))
                    held += len(x)
                if held >= WINDOW_SIGNATURES:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.select("text").mapInArrow(run, "part int, signatures binary, nodes binary, index binary, many binary, shared binary")


_PACKED = ["part", "signatures", "nodes", "index", "many", "shared"]


def _meet(rows: list[tuple]) -> np.ndarray:
    """Pairs (signature, node) of one part whose signature other windows have too."""
    signatures, nodes, many = [], [], []
    for sig, names, index, flags, _ in rows:
        names, sig = np.frombuffer(names, np.int64), np.frombuffer(sig, np.uint64)
        small = np.uint16 if len(names) < 1 << 16 else np.uint32
        signatures.append(sig)
        nodes.append(names[np.frombuffer(index, small)])
        many.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=len(sig)).astype(bool))
    sig, node, many = np.concatenate(signatures), np.concatenate(nodes), np.concatenate(many)
    order = np.lexsort((node, sig))
    sig, node, many = sig[order], node[order], many[order]
    if not len(sig):
        return np.empty((0, 2), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.concatenate([starts, [len(sig)]]))
    several = np.repeat(node[starts] != node[starts + size - 1], size)  # nodes are sorted: the first is not the last
    out = several & ~many
    return np.stack([sig[out].view(np.int64), node[out]], 1)


def _buckets(docs: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """``sig, node, n``: the sets of each signature that several have; of signatures with the same sets, one stays."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def out(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["sig", "node"])

        part, rows = None, []
        for b in batches:
            for p, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    if rows:
                        yield out(_meet(rows))
                    part, rows = p, []
                if row[-1]:
                    yield out(np.frombuffer(row[-1], np.int64).reshape(-1, 2))
                rows.append((*row[:-1], None))
        if rows:
            yield out(_meet(rows))

    packed = _signed(docs, words, percent, parts).repartition(parts, "part").sortWithinPartitions("part")
    pairs = written(packed.mapInArrow(meet, "sig long, node long").distinct(), "shared-signatures")
    alike = pairs.groupBy("sig").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"))
    first = alike.where("n > 1").groupBy("n", "lo", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "n")
    out = written(pairs.join(first, "sig"), "buckets")
    erase(pairs)
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 100 * both >= percent * (len(x) + len(y) - both)


def block_links(names: list[bytes], n: np.ndarray, payloads: list[bytes], left: int, alone: bool, percent: int, exact: bool, forest: Forest) -> list[tuple[bytes, bytes]]:
    """Links between different trees of ``forest``, which takes them in: all pairs if ``alone``, else left with right.

    Pairs are told apart by size and sketch; with ``exact`` the payloads are sets, and what is left is compared whole.
    """
    label = np.unique([forest.find(x) for x in names], return_inverse=True)[1]
    if not (label != label[0]).any():
        return []
    sets = [np.frombuffer(x, np.uint64) for x in payloads] if exact else []
    marks = folded([sketch(s) for s in sets] if exact else payloads)
    out, step = [], max(1, SKETCH_PAIRS // (len(names) * marks.shape[1]))
    for at in range(0, left, step):
        to = min(left, at + step)
        first = at + 1 if alone else left
        small, large = np.minimum(n[at:to, None], n[None, first:]), np.maximum(n[at:to, None], n[None, first:])
        near = (small * 100 >= percent * large) & (np.bitwise_count(marks[at:to, None] ^ marks[None, first:]).sum(2, dtype=np.int64) * percent <= small * (100 - percent))
        for i in range(at, to):
            js = first + np.flatnonzero(near[i - at])
            js = js[(js > i) & (label[js] != label[i])]
            while len(js):
                j, js = int(js[0]), js[1:]
                if not exact or similar(sets[i], sets[j], percent):
                    label[label == label[j]] = label[i]
                    forest.join(names[i], names[j])
                    out.append((names[i], names[j]))
                    js = js[label[js] != label[i]]
    return out


def _dealt(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of large groups (``grp, digest, label, n, payload``) for each pair of blocks to compare, with ``lo, hi, later``.

    A block holds sets of one size class, either of the largest component (core) or of the others, so that neither
    sizes too far apart nor two blocks of the core are ever dealt together.
    """
    counts = written(rows.groupBy("grp", "label").count().groupBy("grp").agg(F.max(F.struct("count", "label")).alias("most")), "cores")
    b = rows.join(counts, "grp").select(
        "grp", "digest", "label", "n", "payload",
        ((F.col("label") == F.col("most.label")) & (F.col("most.count") > 1)).alias("core"),
        F.floor(F.log("n") / math.log(CLASS_RATIO)).cast("int").alias("class"),
    )
    per = b.groupBy("grp", "core", "class").agg(F.sum(F.octet_length("payload")).alias("bytes"), F.count("*").alias("sets"))
    subs = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("sets") / BLOCK_SETS), F.lit(1)).cast("int")
    per = written(per.groupBy("grp").agg(F.collect_list(F.struct("core", "class", subs.alias("subs"))).alias("blocks")), "blocks")
    near = math.ceil(math.log(100 / percent) / math.log(CLASS_RATIO))
    b = b.join(per, "grp")
    own = F.element_at(F.filter("blocks", lambda x: (x["core"] == F.col("core")) & (x["class"] == F.col("class"))), 1)["subs"]
    b = b.withColumn("block", F.struct("core", "class", F.pmod(F.xxhash64("digest"), own).cast("int").alias("sub")))
    meets = F.filter("blocks", lambda x: (F.abs(x["class"] - F.col("class")) <= near) & ~(x["core"] & F.col("core")))
    others = F.flatten(F.transform(meets, lambda x: F.transform(F.sequence(F.lit(0), x["subs"] - 1), lambda i: F.struct(x["core"].alias("core"), x["class"].alias("class"), i.alias("sub")))))
    dealt = b.select("grp", "digest", "label", "n", "payload", "block", F.explode(others).alias("other"))
    name = lambda c: F.concat_ws("/", c["core"].cast("string"), c["class"].cast("string"), c["sub"].cast("string"))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    return dealt.select("grp", name(lo).alias("lo"), name(hi).alias("hi"), (F.col("block") > F.col("other")).alias("later"), "digest", "label", "n", "payload")


_LABELLED = ["grp", "digest", "weight", "n", "payload", "label"]


def _links(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links ``a, b`` (digests) that make up the components of near pairs inside groups of ``grp, digest, weight, n, payload``.

    Near: similar if ``exact`` (payloads are sets), else not told apart by size and sketch (payloads are sketches).
    """

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = []
            for d, n, x, label, p in zip(*(b.column(i).to_pylist() for i in (1, 3, 4, 5, 6)), strict=True):
                if label == d != p["digest"] and block_links([d, p["digest"]], np.array([n, p["n"]]), [x, p["payload"]], 1, True, percent, exact, Forest()):
                    label = p["digest"]
                labels.append(label)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(labels, pa.binary())], _LABELLED)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        forest, group, held, links = Forest(), None, [], []

        def close() -> None:
            forest.trim()
            names = [r[1] for r in held]
            for _, d, label, _, _ in held:
                if label != d:
                    forest.join(d, label)
            later = sum(r[0] for r in held)
            if alone := group[1] == group[2]:
                later = 0
            if len(names) > 1 and (alone or 0 < later < len(names)):
                links.extend(block_links(names, np.array([r[3] for r in held]), [r[4] for r in held], len(names) - later, alone, percent, exact, forest))

        for b in batches:
            for grp, lo, hi, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (grp, lo, hi) != group:
                    if held:
                        close()
                    group, held = (grp, lo, hi), []
                held.append(row)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])
                links.clear()
        if held:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    large = written(rows.groupBy("grp").count().where(F.col("count") > BLOCK_SETS).select("grp"), "large-groups")
    n_large = large.count()
    few = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
    plain = rows.join(few, "grp", "left_anti") if n_large else rows
    dealt = plain.select("grp", F.lit("").alias("lo"), F.lit("").alias("hi"), F.lit(False).alias("later"), "digest", F.col("digest").alias("label"), "n", "payload")
    found = None
    if n_large:
        hot = rows.join(few, "grp").select(*_LABELLED[:-1], F.col("digest").alias("label"))
        hot = written(hot, "large-rows")
        for _ in range(PIVOT_ROUNDS):
            # In each large group the set with most partners that no pivot has been linked to yet.
            free = hot.where("digest = label").groupBy("grp").agg(F.max(F.struct("weight", "digest", "n", "payload")).alias("p"))
            pivots = written(free, "pivots")
            size = pivots.agg(F.sum(F.octet_length("p.payload"))).head()[0] or 0
            pairs = hot.join(F.broadcast(pivots) if size <= BROADCAST_BYTES else pivots, "grp", "left").select(*_LABELLED, F.coalesce("p", F.struct("weight", "digest", "n", "payload")).alias("p"))
            before, hot = hot, written(pairs.mapInArrow(star, hot.schema), "large-rows")
            erase(before, pivots)
        found = hot.where("digest <> label").select(F.col("label").alias("a"), F.col("digest").alias("b"))
        dealt = dealt.unionByName(_dealt(hot, percent))
    by_block = dealt.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "later", "digest")
    rest = written(by_block.select("grp", "lo", "hi", "later", "digest", "label", "n", "payload").mapInArrow(compare, "a binary, b binary"), "links")
    return rest if found is None else found.unionByName(rest)


def _few(ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """``ids`` with a hint to broadcast them, if they are numbers and at most ``BROADCAST_ROWS``."""
    return F.broadcast(ids) if isinstance(ids.schema[name].dataType, NumericType) and ids.count() <= BROADCAST_ROWS else ids


def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80, keep_keys: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: components of documents with a similarity of ``percent`` / 100 or more.

    ``keep_keys`` adds ``digest`` (of the row's set) and ``key`` (the class's), by which rows with the same doc_id and
    other texts are told apart; both are null where the set is empty.
    """
    docs = small_batches(docs.select("doc_id", "text"))
    rows = written(_sizes(docs, words), "set-sizes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    elements = rows.agg(F.sum("n_shingles")).head()[0] or 0
    buckets = _buckets(docs, words, percent, max(parts, math.ceil(elements / PART_ELEMENTS)))
    weights = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    known = rows.where("digest IS NOT NULL").groupBy("digest", "node", F.col("n_shingles").alias("n"), "mark").agg(F.min("doc_id").alias("doc_id"))
    chosen = written(known.join(weights, "node"), "candidate-sets")
    entries = written(buckets.select("sig", "node").join(chosen, "node").select(F.col("sig").alias("grp"), "digest", "weight", "n", F.col("mark").alias("payload")), "entries")
    erase(buckets)
    groups = components(_links(entries, percent, exact=False)).select(F.col("node").alias("digest"), F.col("label").alias("grp"))
    grouped = written(chosen.join(groups, "digest").select("digest", "doc_id", "grp", "weight", "n"), "grouped-sets")
    erase(entries, chosen)
    texts = docs.join(_few(grouped.select("doc_id").distinct()), "doc_id", "left_semi")
    if not grouped.where("doc_id IS NULL").isEmpty():  # sets that only rows without a doc_id have
        texts = texts.unionByName(docs.where("doc_id IS NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            found = [(digest(s), s.tobytes()) for s in shingle_sets(b.column(0), words)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["digest", "payload"])

    sets = texts.select("text").mapInArrow(run, "digest binary, payload binary").groupBy("digest").agg(F.min("payload").alias("payload"))
    sets = written(sets.join(grouped.select("digest", "grp", "weight", "n"), "digest").select("grp", "digest", "weight", "n", "payload"), "sets")
    linked = components(_links(sets, percent, exact=True)).select(F.col("node").alias("digest"), "label")
    erase(sets, grouped)
    keyed = rows.drop("mark").join(linked, "digest", "left").withColumn("key", F.coalesce("label", "digest"))
    # Written, so that the join below deals its two sides anew and a key with very many documents can be split.
    least = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    least = written(least.select("key", "component_id"), "components")
    out = keyed.join(least, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *["digest", "key"] * keep_keys)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest doc_id, of several rows with that
    doc_id the one with the smallest digest, and of several with that set too the least in its columns, by their order.

    Rows with a null doc_id stay; so do documents without words, of which rows equal in all columns count once.
    """
    classes = written(jaccard_classes(docs, words, percent, keep_keys=True), "classes")
    gone = written(classes.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    names = docs.columns
    if again.isEmpty():
        return docs.join(_few(gone), "doc_id", "left_anti").select(*names)
    few, own = _few(again), "_" * max(map(len, names))  # longer than the columns that are there
    once = docs.join(few, "doc_id", "left_anti").join(_few(gone), "doc_id", "left_anti").select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digest(s) if len(s) else None for s in shingle_sets(b.column(names.index("text")), words)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], [*names, f"{own}digest"])

    rows = docs.join(few, "doc_id", "left_semi").select(*names)
    rows = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(f"{own}digest", BinaryType())]))
    heads = classes.join(few, "doc_id", "left_semi").where("doc_id = component_id AND key IS NOT NULL").groupBy("doc_id", "key").agg(F.min("digest").alias(f"{own}digest"))
    kept = rows.join(written(heads.select("doc_id", f"{own}digest"), "heads"), ["doc_id", f"{own}digest"], "left_semi")
    kept = kept.groupBy("doc_id", f"{own}digest").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    empty = rows.where(F.col(f"{own}digest").isNull()).select(*names).dropDuplicates()
    return once.unionByName(kept).unionByName(empty)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(l) < 3 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
d AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS f, doc_id AS z FROM documents UNION SELECT r.f, d.y FROM r JOIN d ON d.x = r.z)
SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(z) FROM r WHERE r.f = documents.doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id)
"""

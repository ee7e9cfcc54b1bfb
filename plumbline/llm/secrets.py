"""Secret scans with linking of credentials that come in parts.

Base kinds (``assign``, ``access``, ``hex``) are reported wherever they stand. Three more kinds are too weak to be
reported alone: ``identifier`` (a named client, account, user or key id), ``secret`` (40 characters of base 64 that look
random) and ``endpoint`` (a URL or a cloud host). Every access identifier and every named one opens a scope of ``SCOPE``
characters around it; an interval join (sorted starts, bisection) finds what stands wholly inside. A weak secret is
reported if it shares a scope with an identifier of either sort; a named identifier if its scope holds a secret, an
assignment or a hexadecimal key; an endpoint if it shares a scope with such a complete pair. Candidates are found in
the whole text, so that no edge of a scope cuts them.

Texts that can't match are told apart by one linear-time pass over the Arrow batch; the others are scanned whole.
Nothing is shuffled; memory is bounded by a batch and the longest text.

Defined results: null text counts as empty; a text without matches has zero counts, empty ``spans`` and the digest
of an empty string; repeated rows are kept; an empty table gives no rows; further columns are kept by ``redact`` and
ignored by ``scan``; positions are code points, ends exclusive; spans that start together stand in the order of ``KINDS``;
overlapping scopes report a candidate once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.codec import release
from plumbline.llm.common import small_batches, table

SCOPE = 400
MIN_ENTROPY = 3.6
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: The base patterns and the least length of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
_ENDPOINT = re.compile(r"https?://[^\s\"'<>`,;]+|(?<![\w.-])[a-z0-9][a-z0-9.-]*\.amazonaws\.com(?![\w-])")
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:client|account|user|tenant|app|access[_-]?key|key)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.I | re.A)
_MAYBE = r"""(?i:client|account|user|tenant|app|key)[_-]?(?i:id|name)["']? *[:=]|(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _random_looking(s: str) -> bool:
    n = len(s)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    return entropy >= MIN_ENTROPY and any(c.islower() for c in s) and any(c.isupper() for c in s) and any(c.isdigit() for c in s)


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak candidates whose complementary parts share a scope."""
    access = [(a, b) for a, k, b in base if k == 1]
    named = [(m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    if not access and not named:
        return []
    secrets = [(m.start(), m.end()) for m in _SECRET.finditer(text) if _random_looking(m[0])]
    endpoints = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    strong = [(a, b) for a, k, b in base if k in (0, 2)]

    def inside(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
        """Spans in the scope of (a, b) that don't overlap it."""
        at = bisect_left(spans, (a - scope, 0))
        found = []
        while at < len(spans) and spans[at][0] <= b + scope:
            s, e = spans[at]
            if e <= b + scope and (e <= a or s >= b):
                found.append(spans[at])
            at += 1
        return found

    out = set()
    for kind, anchors in ((1, access), (3, named)):
        for a, b in anchors:
            near = inside(secrets, a, b)
            out.update((s, 4, e) for s, e in near)
            if near or inside(strong, a, b):
                out.update((s, 5, e) for s, e in inside(endpoints, a, b))
                if kind == 3:
                    out.add((a, 3, b))
    return sorted(out)


def spans_of(text: str | None) -> list[Span]:
    base = base_spans(text or "")
    return sorted([*base, *linked_spans(text or "", base)])


def _scanned(texts: pa.Array) -> Iterator[tuple[int, str, list[Span]]]:
    """(row, text, spans) of the texts that have any."""
    maybe = pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False)
    for i in pc.indices_nonzero(maybe).to_pylist():
        text = texts[i].as_py()
        if spans := spans_of(text):
            yield i, text, spans


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, spans``: array of (kind, start, end) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            out: list[list] = [[]] * b.num_rows
            for i, _, spans in _scanned(b.column(1)):
                out[i] = [{"kind": KINDS[k], "start": a, "end": e} for a, k, e in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, struct)], [key, "spans"])

    return small_batches(docs.select(key, "text")).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every stretch that spans cover replaced by ``[secret]``; of an assignment and a named identifier only the value goes."""
    out, at = [], 0
    for a, k, b in spans:
        if k == 0 and (m := ASSIGN.match(text, a)):
            a = m.start(2)
        elif k == 3 and (m := IDENTIFIER.match(text, a)):
            a = m.start(1)
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets taken out of ``text`` and ``n_chars``, where there, counted anew for these rows."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            changed = {i: redacted(text, spans) for i, text, spans in _scanned(b.column(names.index("text")))}
            cols = list(b.columns)
            for name, f in (("text", str), ("n_chars", len)):
                if changed and name in names:
                    c = cols[at := names.index(name)]
                    values = c.to_pylist()
                    for i, t in changed.items():
                        values[i] = f(t)
                    cols[at] = pa.array(values, c.type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return small_batches(docs).mapInArrow(run, docs.schema)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )

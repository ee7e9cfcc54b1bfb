"""Canonical exact fingerprints of documents.

The canonical form of a text is its NFKC form, case-folded, with white space folded to single spaces; its
fingerprint is the 128-bit xxhash (XXH3) of that form in UTF-8. ``equal_classes`` groups documents by fingerprint
and compares bytes inside equal buckets; texts that collide come to classes of their own. Two fingerprints are
alike 1.0 if they are equal and the canonical bytes are, else 0.0.

Defined results: null text counts as empty (a fingerprint of its own); a null doc_id stands after all others in
descending order; ties of doc_id are ordered by a hash of the text and then by text, whatever the partitions; repeated
rows are kept; an empty table gives no rows; further
columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import erase, small_batches, table, written

_PARTS = 1 << 20
#: Fingerprints of buckets (32 characters each) that are broadcast at most.
BROADCAST_BUCKETS = 500_000


def canonical(text: str | None) -> bytes:
    text = text or ""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode()


def fingerprint(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def likeness(a: tuple[str, bytes], b: tuple[str, bytes]) -> float:
    return float(a[0] == b[0] and a[1] == b[1])


def fingerprints(docs: DataFrame, key: str = "doc_id", keep_form: bool = False) -> DataFrame:
    """``key, fingerprint`` and, with ``keep_form``, ``form`` (the canonical bytes)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [canonical(x.as_py()) for x in b.column(1)]
            cols, names = [b.column(0), pa.array(map(fingerprint, forms), pa.string())], [key, "fingerprint"]
            if keep_form:
                cols, names = [*cols, pa.array(forms, pa.binary())], [*names, "form"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return small_batches(docs.select(key, "text")).mapInArrow(run, f"`{key}` {kind}, fingerprint string" + ", form binary" * keep_form)


def equal_classes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, fingerprint, class_id, collision``: the smallest key with the same canonical bytes.

    ``collision`` numbers the classes of one fingerprint, 0 for the first. Fingerprints alone are counted, with partial
    aggregation before the shuffle; canonical bytes are made only for buckets of two rows or more, each compared with
    its bucket's first text by an equi-join that adaptive execution can split. Rows that differ go round again among
    themselves.
    """
    prints = written(fingerprints(docs, key), "fingerprints")
    counted = prints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    several = written(counted.where("n > 1").select("fingerprint"), "buckets")
    few = F.broadcast(several) if several.count() <= BROADCAST_BUCKETS else several
    out = prints.join(few, "fingerprint", "left_anti").select(key, "fingerprint", F.col(key).alias("class_id"), F.lit(0).alias("collision"))
    rest = written(fingerprints(docs, key, keep_form=True).join(few, "fingerprint", "left_semi").select(key, "fingerprint", "form"), "bucket-rows")
    collision = 0
    while not rest.isEmpty():
        least = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "form")).alias("least")
        head = rest.groupBy("fingerprint").agg(least).select("fingerprint", F.col("least.form").alias("head"), F.col("least.key").alias("class_id"))
        compared = rest.join(written(head, "bucket-heads"), "fingerprint")
        same = written(compared.select(key, "fingerprint", "class_id", (F.col("form") == F.col("head")).alias("same"), F.when(F.col("form") != F.col("head"), F.col("form")).alias("form")), "compared")
        out = out.unionByName(same.where("same").select(key, "fingerprint", "class_id", F.lit(collision).alias("collision")))
        erase(rest)
        rest, collision = same.where("NOT same").select(key, "fingerprint", "form"), collision + 1
        if rest.isEmpty():
            break
        rest = written(rest, "bucket-rows")
    return out


def _buckets(docs: DataFrame, n: int) -> tuple[Column, Column]:
    """(bucket, tie) columns: about n ranges of descending doc_id; an id that fills several is cut by a hash of its text."""
    down = F.bitwise_not(F.col("doc_id"))
    shares = F.array(*(F.lit(i / n) for i in range(1, n)))
    cuts, rows, none = docs.select(down.alias("d")).agg(F.percentile_approx("d", shares, 20 * n) if n > 1 else F.lit(None), F.count("*"), F.count_if(F.col("d").isNull())).head()
    cuts = sorted(cuts or [])
    bounds = sorted(set(cuts))
    hot = {c: cuts.count(c) for c in bounds if cuts.count(c) > 1}
    tie = F.pmod(F.xxhash64("text"), F.lit(_PARTS))

    # A balanced tree of comparisons: as many as the logarithm of the bounds.
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(down <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    at = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(tree(0, len(bounds)))
    share = F.when(F.col("doc_id").isNull(), F.floor(tie * max(1, none * n // max(1, rows)) / _PARTS)).otherwise(0)
    for c, m in hot.items():
        share = F.when(down == F.lit(c), F.floor(tie * m / _PARTS)).otherwise(share)
    return (at * n + share).cast("long"), tie


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``bucket, tail, doc_id, text`` dealt and sorted so that each row is followed by the next document.

    One shuffle deals ranges of doc_id in descending order. A range ends with copies of the first rows of the range
    after it (``tail = 1``); the last range ends with those of the first.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket, tie = _buckets(docs, max(1, n))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.col("doc_id")).alias("down"), tie.alias("tie"))
    firsts = docs.groupBy(bucket.alias("bucket")).agg(F.min(place).alias("first")).orderBy("bucket").collect()  # a row for each range
    keyed = docs.withColumns({"bucket": bucket, "tie": tie, "tail": F.lit(0)})
    if not firsts:
        return keyed.select("bucket", "tail", "doc_id", "text")
    # One map of literals, looked up by range: the place of its first row, and the range that ends with a copy of it.
    entries = []
    for r, before in zip(firsts, [firsts[-1], *firsts[:-1]], strict=True):
        none, down, t = r["first"]
        entries += [F.lit(r["bucket"]), F.struct(F.lit(none).alias("none"), F.lit(down).cast("long").alias("down"), F.lit(t).alias("tie"), F.lit(before["bucket"]).alias("before"))]
    keyed = keyed.withColumn("first", F.try_element_at(F.create_map(*entries), F.col("bucket")))
    down = F.bitwise_not(F.col("doc_id"))
    own = (F.col("doc_id").isNull() == F.col("first.none")) & down.eqNullSafe(F.col("first.down")) & (F.col("tie") == F.col("first.tie"))
    here = F.struct(F.col("bucket"), F.lit(0).alias("tail"))
    where = F.when(own, F.array(here, F.struct(F.col("first.before").alias("bucket"), F.lit(1).alias("tail")))).otherwise(F.array(here))
    return (
        keyed.select(F.explode(where).alias("w"), "doc_id", "text", "tie")
        .select("w.bucket", "w.tail", "doc_id", "text", "tie")
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "tie", "text")
        .select("bucket", "tail", "doc_id", "text")
    )


_EDITED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", *(c.split()[0] for c in _EDITED.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the next document: bucket, doc_id, text, (fingerprint, form)

        def row(nxt_text: str, nxt_print: tuple[str, bytes]):
            _, doc, text, own = held
            n = len(text)
            edited = text[: n - n // 3] + nxt_text[: n // 3]
            form = canonical(edited)
            changed = fingerprint(form), form
            return doc, n, hashlib.sha256(edited.encode()).hexdigest(), own[0], changed[0], likeness(own, changed), likeness(own, nxt_print)

        for b in batches:
            rows = []
            for bucket, tail, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), (x.as_py() for x in b.column(3)), strict=True):
                if tail and (held is None or held[0] != bucket):
                    continue  # the bucket's last row has met its next already
                form = canonical(text)
                own = fingerprint(form), form
                if held is not None and held[0] == bucket:
                    rows.append(row(text, own))
                held = None if tail else (bucket, doc, text, own)
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            types = [b.column(2).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    rows = small_batches(with_next(docs)).mapInArrow(run, f"doc_id {kind.simpleString()}, {_EDITED}")
    # Equal fingerprints are looked at byte by byte: another text's class gets a suffix of its own.
    classes = equal_classes(docs).groupBy("doc_id", "fingerprint").agg(F.min("class_id").alias("class_id"), F.min("collision").alias("collision"))
    r, c = rows.alias("r"), written(classes, "classes").alias("c")
    out = r.join(c, F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("r.fingerprint") == F.col("c.fingerprint")), "left")
    named = F.when(F.col("collision") > 0, F.concat_ws("-", "r.fingerprint", "collision")).otherwise(F.col("r.fingerprint"))
    return out.select("r.doc_id", "n_chars", "edited_sha256", named.alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "class_id")

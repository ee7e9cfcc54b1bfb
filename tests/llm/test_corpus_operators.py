"""Packing, BPE, top-k, classifier, Jaccard join, pipeline: edge cases and brute force."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, chat, components, jaccard, packing, quality, registry, topk, warc

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain_words():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def coder():
    ranks = bpe.load_ranks(RANKS)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Encoder(ranks, bpe.halves(ranks), public_tokenizers.PATTERN), bpe.Decoder(ranks), plain


TEXTS = ["", " ", "a   b", "a\n b ", "a \n \n b", "  a", "\n \n", "x" * 400, " " * 50 + "b", "a\x00b c", "Ünïcödé ΑΣ ΣΑΣ İ ½２", "can't WE'LL", "\x1c\x1d a", "<|endoftext|> a", "😀😀 é", "a   b"]


# --- BPE


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abcdehtinorst  \n\té😀ß'1２%$\x1c中 "), max_size=60))
def test_bpe_like_the_library(coder, text):
    encoder, decoder, plain = coder
    ids = next(encoder.batch(pa.array([text])))
    assert ids.tolist() == plain.encode_ordinary(text)
    assert decoder.decode(ids) == text.encode()


def test_bpe_fixed_texts_and_flush(coder):
    encoder, _, plain = coder
    assert [x.tolist() for x in encoder.batch(pa.array(TEXTS))] == [plain.encode_ordinary(x) for x in TEXTS]
    small = bpe.Transducer(bpe.load_ranks(RANKS), bpe.halves(bpe.load_ranks(RANKS)), most=50)
    assert [i for w in ("tokenisation", " straightforward", "tokenisation") for i in small.encode(w.encode())] == [i for w in ("tokenisation", " straightforward", "tokenisation") for i in plain.encode_ordinary(w)]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=12), st.integers(1, 4))
def test_utf8_stream(data, step):
    tokens = [bytes([i]) for i in range(256)]
    s = bpe.Utf8Stream(tokens)
    out = "".join(s.feed(data[i : i + step]) for i in range(0, len(data), step)) + s.close()
    assert out == data.decode("utf-8", "replace")


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "a b"), (2, "a b"), (3, "é" * 30_000)], "doc_id long, text string").withColumn("ids", F.lit(1))
    out = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN)
    assert [r["n_tokens"] for r in out.orderBy("doc_id").collect()][:3] == [0, 2, 2]
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(out, RANKS).collect()}
    assert back == {1: "", 2: "a b", 3: "é" * 30_000}
    assert bpe.encode_documents(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# --- packing


def test_word_ids(plain_words):
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choices("abcdeinor à  \n\téüΣ'sd1２%$\x1c\xa0中́A", k=r.randint(0, 40))) for _ in range(2000)]
    assert [x.tolist() for x in packing.WordEncoder(WORDS).batch(pa.array(texts))] == [plain_words(x) for x in texts]


@pytest.mark.parametrize("size", [16, 64])
def test_packing_is_whole_and_gapless(spark, plain_words, size):
    r = random.Random(size)
    docs = {i: " ".join(r.choices(["alpha", "beta", "gamma", "x,y"], k=r.choice([0, 1, 3, 9, 40, 200]))) or None for i in range(120)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("start", F.lit(1)).repartition(3)
    rows = packing.pack_documents(df, WORDS, size=size, window=size * 20).collect()
    ids = {i: [*plain_words(t or ""), 1] for i, t in docs.items()}
    pieces, places = defaultdict(list), defaultdict(list)
    for p in rows:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["length"] > 0 and p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
        pieces[p["doc_id"]].append((p["start"], p["length"]))
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for i in docs:
        at = 0
        for s, n in sorted(pieces[i]):
            assert s == at
            at += n
        assert at == len(ids[i])
    for v in places.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= size and (at == size or at & (at - 1) == 0)


def test_packing_balances_cost():
    r = random.Random(4)
    lengths = [r.randint(1, 2047) for _ in range(400)]
    bins = sum(lengths) // 2048
    pieces, left = packing.balance(lengths, bins, 2048)
    costs, fill = [0.0] * bins, [0] * bins
    for _, _, k, b in pieces:
        costs[b] += packing.cost(k)
        fill[b] += k
    assert set(fill) == {2048} and sum(lengths[i] - s for i, s in left) == sum(lengths) - bins * 2048
    assert np.std(costs) / np.mean(costs) < 0.25


def test_packing_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


# --- top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.3, (700, 9)).astype(np.float32)
    v[100:140] = v[0]
    rows = [(i, v[i].tolist()) for i in range(700)] + [(1000, None), (1050, [float("nan")] * 9), (1100, [None] * 9), (1150, [1.0, float("inf")] + [0.0] * 7), (7, v[7].tolist()), (5000, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    e = topk.quantised(df)
    got = defaultdict(list)
    for r in topk.top_k(e.where("id % 50 = 0"), e, 5, block_rows=150, block_queries=4).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    q = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    ids = [*range(700), 7]
    for i in range(0, 700, 50):
        want = sorted((-int(q[j] @ q[i]), j) for j in ids if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, -s, j) for k, (s, j) in enumerate(want)]
    assert set(got) == set(range(0, 700, 50))
    assert topk.top_k(e.limit(0), e, 5).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 6), st.integers(0, 4))
def test_index_finds_every_candidate(seed, rows, k, dropped):
    rng = np.random.default_rng(seed)
    v, q = rng.integers(-40, 40, (rows, 4)), rng.integers(-40, 40, 4)
    found, scores = topk.BitSlicedIndex(v, dropped).top(q, k)
    want = np.sort(v @ q)[::-1][:k]
    assert (np.sort(scores)[::-1][:k] == want).all() and (v[found] @ q == scores).all()
    assert {*np.flatnonzero(v @ q >= want[-1])} <= {*found}


# --- classifier


def test_classifier_learns_and_defines_edges(spark):
    r = random.Random(8)
    good = lambda: " ".join(r.choices(["the", "house", "is", "very", "old", "and", "green"], k=30)).capitalize() + "."
    bad = lambda: " ".join(r.choices(["BUY!!", "NOW!!", "$$$", "CHEAP!!"], k=30))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x"), (900, None)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.score_documents(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted").collect()
    assert len(out) == 304 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in out)
    held = [x for x in out if x["doc_id"] is not None and x["doc_id"] < 300 and x["held_out"]]
    assert held and all(x["predicted"] == int(x["doc_id"] % 3 > 0) for x in held)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in out if x["doc_id"] is not None)
    assert len({x["score"] for x in out if x["doc_id"] in (900, 901)}) == 1
    none = quality.train(docs, labels.limit(0))
    assert {x["score"] for x in quality.score_documents(docs, none).collect()} == {0.5}
    swapped = quality.train(docs, labels.where(~quality.held_out()))
    assert np.allclose(swapped.weight, model.weight)
    assert quality.score_documents(docs.limit(0), model).count() == 0


# --- Jaccard


def brute_classes(rows, words, percent):
    sets = []
    for _, t in rows:
        w = [x for x in __import__("re").split("[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        base = r.choices(vocabulary, k=r.choice([2, 3, 5, 11, 12, 15, 25, 60, 200]))
        for _ in range(r.choice([1, 1, 2, 5, 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(r.choice([" ", "\n", "\t "]).join(w).replace("w1", "W1"))
    out += ["", None, "", "É é", "é É", " \x0b "]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, words, percent):
    rows = near_copies(words, 50)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("mine")).repartition(3)
    got = sorted(tuple(r) for r in jaccard.jaccard_classes(df, words, percent).collect())
    assert got == brute_classes(rows, words, percent)


def test_jaccard_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 12)
    r = random.Random(3)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 5, 8])):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(x) for x in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == brute_classes(rows, 3, 90)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([4, 5, 9, 12, 15, 30, 80, 300, 900]), st.sampled_from([80, 90]))
def test_similar_sets_share_a_signature(seed, n, percent):
    rng, signer = np.random.default_rng(seed), jaccard.Signer(percent)
    x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    k = signer.differ(len(x))
    gone = rng.integers(0, min(k, len(x) - 1) + 1)
    y = np.union1d(rng.permutation(x)[gone:], rng.integers(0, 2**64, max(0, k - gone), dtype=np.uint64))
    if jaccard.similar(x, y, percent) and jaccard.digest(x) != jaccard.digest(y):
        assert set(np.concatenate(signer.sign(x)).tolist()) & set(np.concatenate(signer.sign(y)).tolist())


def test_jaccard_edges(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "other words are here"), (9, "a b c d"), (9, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in jaccard.jaccard_classes(df, 3, 90).collect()), key=str)
    assert got == sorted([(0, 4), (4, 4), (4, 4), (9, 4), (9, 4)], key=str)
    assert jaccard.jaccard_classes(df.limit(0), 3, 90).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(200, 100)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(edges).collect()}
    assert set(got.values()) == {1, 100} and len(got) == 62


def test_components_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_EDGES", 7)
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(r.randrange(200, 230), r.randrange(200, 230)) for _ in range(20)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("exact", [False, True])
def test_links_grow_with_the_sets_of_a_group(spark, monkeypatch, exact):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 64)
    rng = np.random.default_rng(2)
    base, made = rng.integers(0, 2**64, 60, dtype=np.uint64), []
    for _ in range(3_000):
        s = base.copy()
        s[rng.integers(0, 60, 3)] = rng.integers(0, 2**64, 3, dtype=np.uint64)
        made.append(np.unique(s))
    rows = [(1, jaccard.digest(s), 1, len(s), s.tobytes() if exact else jaccard.sketch(s)) for s in made]
    links = jaccard._links(spark.createDataFrame(rows, "grp long, digest binary, weight long, n long, payload binary"), 90, exact).collect()
    assert len(links) < 2 * len(rows)


# --- queries and pipeline


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = registry.queries()[name](spark, DATA)
    cur = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"component_id": F.lit("mine"), "score": F.lit("mine"), "predicted": F.lit(7)})
    extra = docs.where("doc_id < 3")
    now = docs.unionByName(extra)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, DATA)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        assert now.count() <= before.count()
    kept = spark.read.parquet(f"{tmp_path}/quality classifier").select("doc_id", "text").collect()
    rows = sorted({(r["doc_id"], r["text"]) for r in kept})
    want = sorted(d for d, _, c in brute_classes(rows, 5, 80) if d == c)
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/n-gram Jaccard join").select("doc_id").collect()) == want
    assert now.where("score <> 'mine' OR predicted <> 7").count() == 0
    assert now.where("text rlike 'AKIA[A-Z0-9]{12}'").count() == 0
    packed = cp.STAGES[-1][1](spark, now, DATA)
    assert packed.select("doc_id").distinct().count() == len(want)
    assert cp.run(spark, DATA).agg(F.sum("length")).head()[0] == packed.agg(F.sum("length")).head()[0]
    assert warc and chat


def test_jaccard_links_through_a_null_id(spark):
    text = lambda i: " ".join(f"w{n}" for n in range(i, i + 10))
    docs = spark.createDataFrame([(1, text(0)), (None, text(1)), (2, text(2)), (3, "else")], "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_classes(docs, 1, 80).collect()}
    assert got == {1: 1, None: 1, 2: 1, 3: 3}

"""Byte-pair tokens against tiktoken, ranked search and whitening against plain versions, and the defined cases of the three."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewake.llm import bytepairs, search, whitening

DOCS = "doc_id long, text string"
CLASHING = ("_row", "at", "word", "ids", "entry", "n", "terms", "times", "item", "rank", "score", "key", "x", "v", "weight", "white")


def clashing(frame):
    return frame.withColumns({name: F.lit(name) for name in CLASHING})


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers
    import tiktoken

    ranks = bytepairs.read_ranks(bytepairs.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    draw = random.Random(7)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [
        None, "", "plain words, 12345 isn't   they'll\n\n \tx  ", "x" * 5000, "中文字符的" * 200, " " * 700 + "a", "a\x01b\x02c \x01\x01 <|endoftext|> +,", "ࡰᲉ \U00013460x \U00010d40",
        "".join(draw.choices("abcdefghij", k=1500)), " ".join(["same"] * 3000),
    ]
    texts += ["".join(draw.choices(every, k=150)) for _ in range(8)]
    return texts + ["".join(draw.choices("ab'sdt re  \n0129é漢😀-_", k=200)) for _ in range(8)]


def test_byte_pairs_equal_those_of_the_library(spark, tokens):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, texts[3])]
    frame = clashing(spark.createDataFrame(rows, DOCS))
    want = sorted((-1 if i is None else i, tokens.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    # With a table of frequent words, with one that holds few of them, and for a decoder of its own.
    for frequent in (10_000, 5):
        found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytepairs.digests(frame, frequent=frequent).collect())
        assert found == [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(content).hexdigest()) for i, ids, content in want]
    ids = bytepairs.encode(frame.filter("doc_id < 8"))
    assert {r.doc_id: list(r.ids) for r in ids.collect()} == {i: tokens.encode_ordinary(t or "") for i, t in enumerate(texts[:8])}
    assert {r.doc_id: bytes(r.content) for r in bytepairs.decode(ids).collect()} == {i: (t or "").encode() for i, t in enumerate(texts[:8])}


def test_pairs_of_the_vocabulary_are_found_in_the_shifted_table():
    ranks = bytepairs.read_ranks(bytepairs.vocabulary_path())
    pairs = bytepairs.halves(ranks)
    assert len(pairs) == len(ranks) - 256
    rows = {}
    for rank, (a, b) in pairs.items():
        rows.setdefault(a, {})[b] = rank
    shifts, slots = bytepairs.shifted(rows)
    assert all(slots[shifts[a] + b] == (a, rank) for rank, (a, b) in pairs.items())
    with pytest.raises(ValueError):
        bytepairs.halves({b"a": 0, b"b": 1, b"c": 2, b"abc": 3})


def test_a_pair_takes_two_reads_of_the_tables_and_only_pairs_have_a_rank(spark):
    ranks = bytepairs.read_ranks(bytepairs.vocabulary_path())
    pairs = bytepairs.halves(ranks)
    encoder = bytepairs.Encoder()
    draw = random.Random(5)
    some = [(a, b, rank) for rank, (a, b) in draw.sample(sorted(pairs.items()), 500)]
    known = set(pairs.values())
    others = [(a, b, None) for a, b in ((draw.randrange(len(ranks)), draw.randrange(len(ranks))) for _ in range(500)) if (a, b) not in known]
    rows = spark.createDataFrame(some + others, "a long, b long, want long").withColumn("rank", encoder.rank(F.col("a"), F.col("b"))).collect()
    assert all(r.rank == r.want if r.want is not None else r.rank is None or r.rank >= bytepairs.NO_RANK for r in rows)
    encoder.shifts, encoder.entries = F.col("shifts"), F.col("entries")
    text = str(encoder.rank(F.col("a"), F.col("b")))
    assert text.count("shifts") == text.count("entries") == 1


def test_no_documents_no_tokens(spark):
    assert bytepairs.digests(spark.createDataFrame([], DOCS)).collect() == []


def plain_search(docs, items, k):
    terms = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def read(text):
        return terms.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    counts = [(i, Counter(read(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    documents, occurrences = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    rows = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c, n in counts:
            m = 100 - 25 + (25 * n * documents) // occurrences
            score = sum(
                math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in read(text) if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i))
        rows += [(item, rank + 1, i, -score) for rank, (score, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(rows, key=str)


@pytest.mark.parametrize("postings", [1, 50, 2_000_000])
@pytest.mark.parametrize("occurrences", [20, 500_000])
def test_search_ranks_all_documents(spark, monkeypatch, postings, occurrences):
    monkeypatch.setattr(search, "POSTINGS", postings)
    draw = random.Random(3)
    words = ["Der", "the", "zebra", "Äpfel", "x1", "42", "no-one", "Straße", "q"]
    odds = [0.4 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, odds, k=draw.randint(1, 30)))) for i in range(120)]
    docs += [(None, "zebra the"), (500, None), (501, ""), (502, "..."), (7, docs[7][1]), (503, "the " * 20_000), (504, "zebra the"), (505, "zebra the")]
    items = [(1, "zebra the"), (2, "THE zebra äpfel Äpfel x1 x1"), (3, None), (4, "unknown words"), (5, ""), (6, "the"), (1, "zebra the"), (7, "q 42 straße Straße")]
    found = search.search(
        clashing(spark.createDataFrame(docs, DOCS)).repartition(3), clashing(spark.createDataFrame(items, "item_id long, text string")), k=5, occurrences=occurrences,
    )
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_search(docs, items, 5)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []


def test_search_stops_creating_accumulators(monkeypatch):
    """With one document far ahead, documents that hold only a common term get none."""
    documents, k = 1000, 1
    lengths = np.ones(documents, np.int64)
    lengths[3] = 2
    terms = np.concatenate([[1] * 3, [0, 1], [1] * (documents - 4)]).astype(np.int32)
    block = search.Block(np.arange(documents), np.full(documents, 5), lengths, terms, np.ones(len(terms), np.int32), documents, 5 * documents)
    made = []
    joined = np.concatenate
    monkeypatch.setattr(search.np, "concatenate", lambda parts: made.append(len(parts[1])) or joined(parts))
    ids, scores = block.best([(0, 7000), (1, 1)], k, 0)
    assert ids.tolist() == [3] and made == [1]
    assert scores[0] == 7001 * (1_000_000_000 // (1000 + 12 * 100))
    assert not block.partial.any()


def plain_whitening(vectors, components, counted=True):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors])
    fit = x if counted else np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, vectors_ = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    order = np.argsort(-values)[:components]
    white = (x - total / n) @ vectors_[:, order] / np.sqrt(values[order])
    return n, ((n * x - total) ** 2).sum(axis=1), white, values[order] / values.sum()


@pytest.mark.parametrize("counted", [True, False])
def test_whitening_against_a_plain_version(spark, counted):
    draw = np.random.default_rng(5)
    base = (draw.normal(size=(60, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]).astype("float32")
    # A third of all rows share one vector.
    vectors = np.concatenate([base, np.repeat(base[:1], 30, axis=0)])
    bad = [(1000, None), (1001, [None] * 6), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, []), (1005, [1.0])]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + bad
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(4)
    found = {r.vec_id: r for r in whitening.whiten(frame, components=4, count_copies=counted).collect()}
    n, deviation, white, explained = plain_whitening(vectors, 4, counted)
    assert sorted(found) == list(range(len(vectors)))
    assert [found[i].deviation for i in range(len(vectors))] == deviation.tolist() and {r.n for r in found.values()} == {n}
    got = np.array([found[i].whitened for i in range(len(vectors))])
    assert np.allclose(got * np.sign((got * white).sum(axis=0)), white, atol=1e-8)
    assert np.allclose(found[0].explained, explained, rtol=1e-9) and found[0].identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    one = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)
    assert [tuple(r) for r in whitening.whiten(one).collect()] == [(i, 3, 0, [None, None], [None, None], None) for i in (1, 1, None)]
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1e300, 2.0])], schema)
    found = {r.vec_id: r for r in whitening.whiten(line).collect()}
    assert all(r.deviation is None and r.whitened[1] is None and r.whitened[0] is not None and r.identity_error < 1e-6 for r in found.values())
    assert whitening.whiten(one.limit(0)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []


def test_whitening_query_covers_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = whitening.op13_whitening(spark, sf_dir)
    assert found.groupBy("component").agg(F.countDistinct("vec_id").alias("n")).filter(F.col("n") == table.count()).count() == whitening.COMPONENTS
    assert found.filter("identity_error > 0.0001 OR explained IS NULL OR whitened IS NULL").count() == 0

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cardloom.llm import packing, queries, token_files
from cardloom.llm.perfect_hash import PerfectHash

SF = "/root/testdata/sf0.01"
EDGES = [(3, None, 1), (1, "", 1), (7, "a b c " * 30_000, 2), (7, "a b c " * 30_000, 2), (7, "other text, same id", 3), (-5, "minus", 4), (None, "no id", 5), (2**62, "large id", 6), (8, "a <|endoftext|> b", 7)]


def library(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*e.ids, end], dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(rows, ids, most_padding):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        options = ids[doc]
        taken = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces)
        want = sum(len(o) for o in options)
        assert sum(t[1] for t in taken) == want
        if len(options) == 1:
            at = 0
            for start, n, crc, total in taken:
                assert start == at and total == want and crc == zlib.crc32(options[0][start : start + n].tobytes())
                at += n
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= most_padding
    return padding


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip((d.doc_id for d in docs), ([i] for i in library("byte_bpe_50k.json", [d.text for d in docs], 0)), strict=True))
    check_packing(queries.op6_packing(spark, SF).collect(), ids, 1023)


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string, length int")
    pieces = packing.pack_documents(df, vocabulary=queries.vocabulary("byte_bpe_50k.json"), group_docs=3)
    rows = pieces.selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    ids = {}
    for (doc, _, _), own in zip(EDGES, library("byte_bpe_50k.json", [e[1] for e in EDGES], 0), strict=True):
        ids.setdefault(doc, []).append(own)
    check_packing(rows, ids, 3 * 1023)
    assert packing.pack_documents(df.limit(0), vocabulary=queries.vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_is_the_same_in_any_order_of_arrival(spark, monkeypatch):
    """The pieces of a group don't depend on how its rows come; long texts are packed by themselves."""
    monkeypatch.setattr(packing, "LONG_BYTES", 2000)
    rows = [(i, f"word {i} " * (1 + 37 * i % 400), 0) for i in range(300)]
    pieces = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, n int").repartition(7)
        found = packing.pack_documents(df, vocabulary=queries.vocabulary("byte_bpe_50k.json"), group_docs=10_000)
        pieces.append(sorted(tuple(r) for r in found.where("sequence_id < 4294967296").select("doc_id", "start", "length", "sequence_id", "offset").collect()))
        long = found.where("sequence_id >= 4294967296")
        assert {r.doc_id for r in long.collect()} == {i for i, t, _ in rows if len(t) > 2000}
        assert long.groupBy("sequence_id").agg({"doc_id": "count"}).where("`count(doc_id)` > 1").count() == 0
    assert pieces[0] == pieces[1] and pieces[0]


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_decreasing(seed):
    r = random.Random(seed)
    sizes = [r.randrange(1, 101) for _ in range(r.choice((1, 2, 37, 300)))]
    plain: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for b in plain:
            if sum(sizes[j] for j in b) + sizes[i] <= 100:
                b.append(i)
                break
        else:
            plain.append([i])
    assert packing.first_fit_decreasing(sizes, 100) == plain


def check_files(rows, docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    own = {}
    for d, ids in zip(order, library("word_bpe_49k.json", [d[1] for d in order], 1), strict=True):
        own.setdefault(d[0], []).append((len(ids), zlib.crc32(ids.tobytes())))
    got, at = {}, 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert list(got) == list(own)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in own.items()}


def test_files_of_documents(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_files(queries.op8_token_files(spark, SF).collect(), docs)


def test_files_of_odd_rows(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string, ids int")
    for rows in (EDGES, []):
        folder = token_files.write_tokens(df if rows else df.limit(0), vocabulary=queries.vocabulary("word_bpe_49k.json"))
        got = token_files.read_tokens(spark, folder).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) AS ids_crc32").collect()
        check_files(got, rows)


@pytest.mark.parametrize("shard_bytes", [1, 3000, 1 << 30])
def test_keyed_access_over_a_folder(spark, shard_bytes):
    """Every key, present, absent, repeated and straddling shards, against the library."""
    rows = [*EDGES, *((100 + 3 * i, f"text of {i} " * (i % 50)) for i in range(200)), *((500, "the same row again") for _ in range(40))]
    rows = [(r[0], r[1]) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = token_files.write_tokens(df, vocabulary=queries.vocabulary("word_bpe_49k.json"), shard_bytes=shard_bytes)
    own = {}
    for (key, _), ids in zip(rows, library("word_bpe_49k.json", [t for _, t in rows], 1), strict=True):
        own.setdefault(key, []).append(ids.tobytes())
    asked = spark.createDataFrame([(k,) for k in (-5, 3, 1, 7, 8, 2**62, 100, 101, 697, 698, 500, 500, 10**15, -(2**60), None)], "doc_id long")
    got = {r.doc_id: r for r in token_files.lookup(spark, folder, asked).collect()}
    assert len(got) == 14
    for key, r in got.items():
        if key is None or key not in own:
            assert r.ids is None and r.n_tokens is None
        else:
            assert bytes(r.ids) in own[key] and r.n_tokens * 4 == len(r.ids)
    shards = spark.read.parquet(f"{folder}/manifest").count()
    assert shards < 5 if shard_bytes == 1 << 30 else shards > 100
    empty = token_files.write_tokens(df.limit(0), vocabulary=queries.vocabulary("word_bpe_49k.json"))
    assert token_files.lookup(spark, empty, asked).where("ids IS NOT NULL").count() == 0


def test_keyed_access_and_damage():
    keys, nulls = np.array([0, -4, -4, 9, 30]), np.array([True, False, False, False, False])
    ids = [np.array([5, 1]), np.array([6, 1, 1]), np.array([7, 7, 1, 1])]
    data = b"".join(token_files.shard_parts(ids, keys, nulls, np.array([2, 2, 1, 3, 1]), 2))
    shard = token_files.Shard(data)
    assert shard.get(-4).tolist() == [6, 1] and shard.get(9).tolist() == [7, 7, 1] and shard.get(0) is None and shard.get(31) is None
    with pytest.raises(ValueError):
        token_files.Shard(data[:-3])


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash_is_minimal(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(-(2**62), 2**62, n))
    index = PerfectHash.of(keys)
    assert sorted(index.find(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(r.integers(-(2**62), 2**62, 5000), keys)
    assert (index.find(others) == -1).all()
    assert len(index.words) * 64 <= 5 * max(64, len(keys)) + 64 * 48

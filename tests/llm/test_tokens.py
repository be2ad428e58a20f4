import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from climekin.llm import packing, token_counts, token_store
from climekin.llm.encoding import encoder
from climekin.llm.scratch import new_path
from tests.llm.common import BYTES, DOCS, EDGE, WORDS, frame


def library(path, text):
    return encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids


ALPHABET = "abcXYZÀéñßÿþ×÷ .,!?'\"&-_|*#$%\n  \t\r\x0b\x1c\x8509<>Σσς́İ中文 "


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(alphabet=ALPHABET, max_size=80), st.text(max_size=40), st.sampled_from(["<|endoftext|> x", "a <|EndOfText|>b", "it's don't we'LL", "###&&& a***"])))
def test_encoder_equals_library(path, text):
    assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == library(path, text)


def test_full_cache(monkeypatch):
    from climekin.llm import encoding

    monkeypatch.setattr(encoding, "CACHE_ENTRIES", 3)
    coder = encoding.Encoder(BYTES)
    text = "one two three four five six one two"
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library(BYTES, text)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    seeds, slots = token_store.build_mph(keys)
    assert sorted(slots) == list(range(len(keys)))
    assert (token_store.mph_slots(keys, seeds, len(keys)) == slots).all()


def test_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 1000)
    docs = frame(spark, EDGE).selectExpr("*", "1 AS k", "2 AS part", "'t' AS t")
    path = new_path(spark, "test-store")
    token_store.write_store(docs, path, BYTES)
    got = token_store.read_store(spark, path).orderBy("start").collect()
    want = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for g, (k, t) in zip(got, want, strict=True):
        ids = [*library(BYTES, t), 0]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids"]) == (k, start, len(ids), ids)
        assert g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    keys = spark.createDataFrame([(1,), (5,), (77,), (-1,), (None,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_store.lookup(keys, path).collect()}
    assert found == {1: [*library(BYTES, EDGE[0][1]), 0], 5: [*library(BYTES, EDGE[4][1]), 0]}


@pytest.mark.parametrize("few", [0, 1000])
def test_lookup_of_many_keys(spark, monkeypatch, few):
    """Keys are grouped by block: a block's payload meets all of its keys at once."""
    monkeypatch.setattr(token_store, "BLOCK_IDS", 50)
    monkeypatch.setattr(token_store, "FEW_BLOCKS", few)
    path = new_path(spark, "test-store")
    rows = [*[(i, f"text number {i}") for i in range(0, 400, 2)], *[(7, f"hot {i}") for i in range(300)], *[(None, f"null {i}") for i in range(50)]]
    token_store.write_store(frame(spark, rows).repartition(5), path, BYTES)
    assert token_store.read_store(spark, path).count() == len(rows)
    keys = spark.createDataFrame([(i,) for i in [*range(-5, 410), 7]], "doc_id long")
    got = token_store.lookup(keys, path).collect()
    want = sorted((i, [*library(BYTES, t), 0]) for i, t in rows if i is not None)
    assert sorted((r["doc_id"], r["ids"]) for r in got) == want


def test_store_of_repeated_keys(spark):
    path = new_path(spark, "test-store")
    token_store.write_store(frame(spark, [(1, "b"), (1, "a"), (1, "a"), (2, "c")]), path, BYTES)
    assert token_store.read_store(spark, path).count() == 4
    assert token_store.lookup(spark.createDataFrame([(1,)], "doc_id long"), path).count() == 3


def test_store_of_nothing(spark):
    path = new_path(spark, "test-store")
    token_store.write_store(spark.createDataFrame([], DOCS), path, BYTES)
    assert token_store.read_store(spark, path).count() == 0


def test_counts(spark):
    cache = new_path(spark, "test-cache")
    docs = frame(spark, EDGE).selectExpr("*", "1 AS digest", "2 AS k", "3 AS n_tokens")
    got = {(r["doc_id"], r["n_bytes"]): r for r in token_counts.count_tokens(docs, BYTES, cache, limit=5).collect()}
    for k, t in EDGE:
        n = len(library(BYTES, t))
        r = got[k, len((t or "").encode())]
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 5)
    # Only distinct texts are encoded, and a second run encodes those it doesn't know.
    kept = spark.read.parquet(cache)
    assert kept.count() == len({t or "" for _, t in EDGE})
    again = token_counts.count_tokens(frame(spark, [*EDGE, (50, "quite new")]), BYTES, cache)
    assert again.count() == len(EDGE) + 1
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in EDGE}) + 1


def test_counts_of_a_sentencepiece_model(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(frame(spark, EDGE[:4]), path, new_path(spark, "test-cache")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: len(model.encode(t or "")) for k, t in EDGE[:4]}


def test_counts_of_repeated_rows(spark):
    """Rows that repeat key and text, or a null key, are encoded once; a later run encodes nothing again."""
    cache = new_path(spark, "test-cache")
    docs = frame(spark, [*[(1, "same text")] * 5, *[(None, "q")] * 3, (2, "alone")])
    assert token_counts.count_tokens(docs, BYTES, cache).count() == 9
    assert spark.read.parquet(cache).count() == 3
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(docs, BYTES, cache).collect()) == [1, 1, 1, 1, 2, 2, 2, 2, 2]
    assert spark.read.parquet(cache).count() == 3


def test_counts_of_nothing(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), BYTES, new_path(spark, "test-cache")).count() == 0


def check_packing(rows, texts, capacity):
    by_sequence = {}
    ids = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] not in ids:
            ids[r["doc_id"]] = [*library(WORDS, texts[r["doc_id"]]), 0]
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["start"] == r["piece"] * capacity
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


def test_packing(spark):
    rows = [r for r in EDGE if r[0] is not None]
    got = packing.pack(frame(spark, rows).selectExpr("*", "1 AS piece", "2 AS k"), WORDS, capacity=64).collect()
    check_packing(got, dict(rows), 64)
    assert sum(r["length"] for r in got) == sum(len(library(WORDS, t)) + 1 for _, t in rows)
    assert packing.pack(frame(spark, EDGE), WORDS).count() >= len(EDGE)
    assert packing.pack(spark.createDataFrame([], DOCS), WORDS).count() == 0


def test_packing_is_tight(spark):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(["word"] * int(r.integers(1, 120)))) for i in range(3000)]
    got = packing.pack(frame(spark, rows), WORDS, capacity=128).collect()
    used = check_packing(got, dict(rows), 128)
    assert len(used) <= 1.05 * -(-sum(x["length"] for x in got) // 128)


@pytest.mark.parametrize("tasks", [4, 32])
def test_packing_is_tight_for_any_number_of_tasks(spark, tasks):
    """Lengths like those of the driver's documents: mostly a few hundred tokens, some far longer."""
    r = np.random.default_rng(7)
    lengths = np.minimum(r.lognormal(5.3, 1.1, 6000), 20_000).astype(int) + 1
    docs = frame(spark, [(i, "word " * n) for i, n in enumerate(lengths.tolist())]).repartition(tasks)
    got = packing.pack(docs, WORDS).select("sequence_id", "length").collect()
    used = len({x["sequence_id"] for x in got})
    assert used <= 1.01 * -(-sum(x["length"] for x in got) // 2048)


@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_best_fit(lengths, limit):
    bins, free, opened = packing.BestFit(50, limit, 0), {}, []
    for n in lengths:
        fits = sorted((free[b], b) for b in opened if free[b] >= n)
        where, offset = bins.put(n)
        if fits:
            assert free[where] == fits[0][0] and where in opened
        else:
            assert where not in free
            if 50 - n > 0 and len(opened) >= limit:
                fullest = min(free[b] for b in opened)
                gone = [b for b in opened if b not in bins.open()]
                assert [free[b] for b in gone] == [fullest]
            free[where] = 50
        assert offset == 50 - free[where]
        free[where] -= n
        opened = [b for b in bins.open()]
        assert len(opened) <= limit

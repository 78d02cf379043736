"""Byte-level BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tokenizers

from sparkshelf.llm import bpe
from sparkshelf.llm.queries import op12_bpe


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def own():
    return bpe.coder(bpe.tokenizer_path())


PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "é", "漢", "🙂", "12", "<|endoftext|>", "<|endof", "\x1c", "\x85", " ", "_", "--", "́", "Word", "xyzzy"]


def test_random_texts_equal_the_library(library, own):
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), np.int32).tolist() == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_one_piece_of_any_length(library, own):
    for piece in ("x" * 30_000, "ab" * 5_000, "=" * 999, " " * 500):
        assert np.frombuffer(own.encode(piece), np.int32).tolist() == library.encode(piece, add_special_tokens=False).ids


def test_ids_that_are_no_text(library, own):
    rng = random.Random(6)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_small_memory_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_BYTES", 2000)
    import json

    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        tight = bpe.Coder(json.load(f))
    for i in range(300):
        text = f"word{i % 7} and number {i}, again word{i % 7}"
        assert np.frombuffer(tight.encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_kinds_of_tokenizers_are_refused():
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        bpe.Coder(json.load(f))


def test_frames(spark, docs, none, library):
    rows = bpe.encode(docs)
    assert bpe.decode(none.selectExpr("doc_id", "cast(null as array<int>) as ids")).count() == 0
    got = sorted(map(repr, map(tuple, rows.collect())))
    assert got == sorted(repr((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted(map(repr, map(tuple, bpe.decode(rows).collect()))) == sorted(repr((r["doc_id"], r["text"] or "")) for r in docs.collect())
    assert bpe.digests(none).count() == 0


def test_ids_outside_the_vocabulary_and_nulls(spark):
    df = spark.createDataFrame([(1, [31373, -5, 99999, 995]), (2, None), (3, []), (4, [None, 31373])], "doc_id int, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(df).collect()} == {1: "hello world", 2: "", 3: "", 4: "hello"}


def test_query_equals_the_library(spark, sf, library):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in texts:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"]] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
    assert {r["doc_id"]: tuple(r)[1:] for r in op12_bpe(spark, sf).collect()} == want


def test_a_batch_is_decoded_in_little_memory(own):
    """Beside the ids and the texts there is nothing that grows with a batch, as masks and sums of all ids would; merges stay with encoding."""
    import tracemalloc

    texts = ["a few plain words, over and over again " * 40] * 2000
    ids = bpe._encoded(own, pa.array(texts))
    c = bpe.strings(bpe.tokenizer_path())
    assert not hasattr(c, "ranks")
    tracemalloc.start()
    got = bpe._decoded(c, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == texts
    assert peak < ids.values.nbytes
    mixed = pa.array([[1, -1, 2, None, 99_999_999], None, [], [3]], pa.list_(pa.int32()))
    assert bpe._decoded(c, mixed).to_pylist() == [c.decode([1, 2]), "", "", c.decode([3])]
    assert bpe._decoded(c, mixed.slice(2)).to_pylist() == ["", c.decode([3])]

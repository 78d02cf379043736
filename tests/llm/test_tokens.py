import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkshelf.llm import idcoder, token_files


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=60), st.integers(0, 70), st.integers(1, 9))
def test_any_ids_come_back(ids, repeat, step):
    ids = np.array((ids * (repeat + 1))[::step], np.int64)
    assert (idcoder.decode(idcoder.encode(ids)) == ids).all()


@pytest.mark.parametrize("ids", [[], [0], [2**32 - 1] * 5000, range(10000), [65534, 65535, 65536] * 900, [7] * (idcoder.BLOCK * 3)])
def test_edges(ids):
    ids = np.array(list(ids), np.int64)
    assert (idcoder.decode(idcoder.encode(ids)) == ids).all()


def test_blocks_are_independent_and_checked():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.4, idcoder.BLOCK * 3) % 5000
    data = bytearray(idcoder.encode(ids))
    data[-100] ^= 255
    with pytest.raises(ValueError, match="block 2"):
        idcoder.decode(bytes(data))
    with pytest.raises(ValueError, match="format"):
        idcoder.decode(b"other!" + bytes(20))


def test_it_compresses_what_repeats():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 49_000, 50)
    ids = np.concatenate([phrase, rng.integers(0, 49_000, 20)] * 100)
    assert len(idcoder.encode(ids)) < 0.5 * 2 * len(ids)


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, token_files.END] for x in texts]


WORDS = token_files.Words(token_files.tokenizer_path())


def test_words_encode_like_the_whole_text():
    texts = ["It's  a\u00a0test\x1c, e\u0301 \u0301x <|endoftext|>y \u2003z\x85q don't", "ΑΣ Σ ΟΔΟΣ.", "\u0130I İ ﬁ ½", "a\tb\x0bc\x0cd\re", "x" * 3000, "😀😀 a\u200db 12345", "\ufeffstart"]
    words = token_files.Words(token_files.tokenizer_path())
    for text, want in zip(texts, whole(texts)):
        assert [*words.ids([text])[0].tolist(), token_files.END] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abzABZ019.,#-_'<|>&éÉßÿ×÷ªΣ\u0301\x1c\x00 \n🙂", max_size=14), max_size=8))
def test_any_words_encode_like_the_whole_text(parts):
    text = " ".join(parts)
    assert [*WORDS.ids([text])[0].tolist(), token_files.END] == whole([text])[0]


def test_full_caches_are_emptied(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_WORD_BYTES", 900)
    monkeypatch.setattr(token_files, "MOST_PIECE_BYTES", 500)
    words = token_files.Words(token_files.tokenizer_path())
    for text in ("a b c", "c d e f", "a b c d e f g h i j k", "a1 b2 c3", "a b"):
        assert [*words.ids([text])[0].tolist(), token_files.END] == whole([text])[0]


def test_files_match_brute_force(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = {x: w for x, w in zip(rows, whole([t for _, t in rows]))}
    got = sorted(token_files.tokens(docs).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    want = sorted((d is not None, d or 0, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for (d, _), w in ((x, ids[x]) for x in rows))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert token_files.tokens(none).count() == 0


def test_ids_read_back(spark, docs, tmp_path):
    token_files.write_tokens(docs, f"file://{tmp_path}/t")
    got = {r["doc"]: r["ids"] for r in token_files.read_ids(spark, f"file://{tmp_path}/t").collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == whole([r["text"]])[0]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    words = token_files.Words(file)
    texts = ["a  b\n c's", " lead", None, "\u00e9t\u00e9"]
    assert not words.by_words and WORDS.by_words and WORDS.by_pieces
    t = Tokenizer.from_file(file)
    assert [x.tolist() for x in words.ids(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_a_real_corpus_takes_fewer_bytes_than_zlib_and_static_order_0(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids = np.concatenate(WORDS.ids(texts)).astype(np.int64)
    counts = np.bincount(ids)[np.unique(ids)]
    got = len(idcoder.encode(ids)) / len(ids)
    assert got < float((counts * np.log2(len(ids) / counts)).sum()) / 8 / len(ids)
    assert got < len(zlib.compress(ids.astype("<u2").tobytes(), 6)) / len(ids)


def test_texts_are_cut_into_pieces_at_once():
    """Plain words that differ in capitals and signs only are learnt as the same pieces; other words stay whole."""
    words = token_files.Words(token_files.tokenizer_path())
    texts = ["Then then. THEN,(then)", "\tthen42 Été éTÉ.", "don't ", "", "<|endoftext|>Then <", "|>then"]
    got = [[*x.tolist(), token_files.END] for x in words.ids(texts)]
    assert got == whole(texts)
    assert set(words.known) == {x.encode() for x in ("then", ".", ",(", ")", "4", "2", "été", "don't", "<|endoftext|>Then", "<", "|>")}

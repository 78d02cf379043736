import math

import numpy as np

from sparkshelf.llm import pseudo_lm as LM


def test_scores_match_a_plain_sum(spark, docs, none):
    lexicon, net = LM.fit(docs)
    got = {(r["doc_id"], r["n_tokens"]): r for r in LM.score(docs, lexicon, net).collect()}
    for r in docs.collect():
        words = LM.words_of(r["text"])
        classes = [LM.CLASSES, LM.CLASSES, *lexicon.classes(words), LM.CLASSES, LM.CLASSES]
        total = 0.0
        for i, w in enumerate(words):
            x = net.w[1].astype(float).copy()
            for k, o in enumerate((-2, -1, 1, 2)):
                x = x + net.w[0][k][classes[i + 2 + o]]
            z = np.tanh(x) @ net.w[2] + net.w[3]
            total += z[classes[i + 2]] - np.log(np.exp(z - z.max()).sum()) - z.max() + lexicon.log_within([w])
        out = got[r["doc_id"], len(words)]
        assert math.isclose(out["log_prob"], total, rel_tol=1e-4, abs_tol=1e-3)
        assert (out["bits_a_token"] is None) == (not words)
    assert LM.score(docs, lexicon, net).count() == docs.count()
    assert LM.score(none, *LM.fit(none)).count() == 0


def test_class_factors_are_distributions(docs):
    lexicon, _ = LM.fit(docs, vocabulary=40)
    mass = np.zeros(LM.CLASSES)
    for w, c in lexicon.of.items():
        mass[c] += math.exp(lexicon.within[w])
    used = sorted(set(lexicon.of.values()))
    assert np.allclose(mass[used], 1)


def test_it_learns_order_and_reruns_agree(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join("abcdefgh"[(s + i) % 8] * 2 for i in range(60)) for s in rng.integers(0, 8, 200)]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    lexicon, net = LM.fit(train)
    again = LM.fit(train)[1]
    assert all((a == b).all() for a, b in zip(net.w, again.w))
    shuffled = [" ".join(rng.permutation(texts[0].split())) for _ in range(20)]
    test = spark.createDataFrame([(0, texts[0]), *((i + 1, t) for i, t in enumerate(shuffled))], "doc_id bigint, text string")
    bits = {r["doc_id"]: r["bits_a_token"] for r in LM.score(test, lexicon, net).collect()}
    assert bits[0] < 0.8 * min(b for i, b in bits.items() if i)
    assert bits[0] < 2.0  # a unigram model needs 3 bits


def test_every_counted_word_has_its_own_share(spark):
    long = "y" * 60
    texts = ["k k zebra k k"] * 8 + ["k k tiger k k", "k k lions k k"] + [f"k k {long} k k"] * 3 + ["k k " + "z" * 60 + " k k"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    lexicon, net = LM.fit(d, vocabulary=1)
    got = {r["doc_id"]: r["log_prob"] for r in LM.score(d, lexicon, net).collect()}
    assert set(lexicon.of) == {b"k"} and len(got) == len(texts)
    assert math.isclose(got[0] - got[8], math.log(8), abs_tol=1e-4) and math.isclose(got[8], got[9])
    assert math.isclose(got[10] - got[13], math.log(3), abs_tol=1e-4)


def test_contexts_match_brute_force(spark, docs):
    """Every place of neighbours that other places have too, by plain counting; the rest keeps the network's score."""
    lexicon, net = LM.fit(docs, vocabulary=30)
    counted = {bytes(r["word"]): r["n"] for r in lexicon.counts.collect()}
    rows = docs.collect()
    by_key, by_place = {}, {}
    for r in rows:
        words = LM.words_of(r["text"])
        for a, w, b in zip([None, *words], words, [*words[1:], None]):
            by_key[a, b] = by_key.get((a, b), 0) + 1
            by_place[a, w, b] = by_place.get((a, w, b), 0) + 1
    plain = sorted((r["n_tokens"], r["log_prob"]) for r in LM.score(docs, lexicon, net).collect())
    got = sorted((r["n_tokens"], r["log_prob"], r["n_contexts"], r["n_recalled"]) for r in LM.score(docs, lexicon, net, contexts=1).collect())
    want = []
    for r in rows:
        words = LM.words_of(r["text"])
        seq = LM.joined([lexicon.classes(words)])
        each = net.log_p(net.hidden(seq, LM.REACH, LM.REACH + len(words)))[np.arange(len(words)), seq[LM.REACH : LM.REACH + len(words)]] if words else []
        total, recalled = 0.0, 0
        for a, w, b, z in zip([None, *words], words, [*words[1:], None], each):
            p = math.exp(float(z) + lexicon.log_within([w])) * (1 if w in lexicon.of else counted[LM._key(w)])
            m, n = by_place[a, w, b] - 1, by_key[a, b] - 1
            total += math.log((m + p) / (n + 1))
            recalled += m > 0
        want.append((len(words), total, len(words), recalled))
    want.sort()
    assert len(got) == len(plain) == len(rows)
    for g, w in zip(got, want):
        assert g[0] == g[2] == w[0] and g[3] == w[3] and math.isclose(g[1], w[1], rel_tol=1e-4, abs_tol=1e-3)
    assert all(g[1] >= p[1] for g, p in zip(got, plain) if g[3] == g[2] and g[0])


def test_documents_that_occur_twice_are_told_apart(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 150) % 5000) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts + texts[:40])), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["recalled"] for r in LM.score(d, *LM.fit(d), contexts=2).collect()}
    twice = [v for i, v in got.items() if i < 40 or i >= 300]
    once = [v for i, v in got.items() if 40 <= i < 300]
    assert min(twice) == 1.0 and max(once) < 0.9


def test_contexts_of_no_rows(none, docs):
    assert LM.score(none, *LM.fit(docs), contexts=1).count() == 0


def test_the_query_counts_every_context(spark, docs, tmp_path):
    """What the query gives is what the operator gives with the contexts of all places."""
    from sparkshelf.llm import queries

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op4_pseudo_lm(spark, str(tmp_path)).collect()
    assert rows and all(r["n_contexts"] == r["n_tokens"] for r in rows)
    whole = LM.score(docs, *LM.fit(docs), contexts=1).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["n_recalled"])
    assert sorted(map(key, rows)) == sorted(map(key, whole))


def test_words_are_split_as_by_python(spark):
    texts = ["  a B\x1cc\tDÉ \x0b x ", "", None, " \n ", " x y", "İ  z"]
    words, at, lengths = LM.split(LM.pa.array([t or "" for t in texts]))
    assert [words[i] for i in at] == [w for t in texts for w in LM.words_of(t)]
    assert lengths.tolist() == [len(LM.words_of(t)) for t in texts]


def test_places_are_shuffled_packed(spark, tmp_path):
    """Nothing is written for each place: packed, the shuffles of all places take fewer bytes than a row of numbers for each would."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 2000) % 50000) for _ in range(100)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    lexicon, net = LM.fit(d)
    packed = "to int, block bigint, kind int, data binary, ids array<bigint>"
    known = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sent = d.select("doc_id", "text").mapInArrow(LM._scorer(lexicon, net, 1, 4, known, LM.pa.int64()), packed)
    assert sum(len(r["data"]) for r in sent.collect()) < 16 * 100 * 2000
    shared = LM.written(d.select("doc_id"), "x").inputFiles()[0].rsplit("/", 2)[0].removeprefix("file:").replace("//", "/")
    import os

    before = set(os.listdir(shared))
    LM.score(d, lexicon, net, contexts=1).collect()
    assert set(os.listdir(shared)) == before


def test_crowded_neighbours_are_counted_ahead_with_the_same_result(spark, docs, monkeypatch):
    lexicon, net = LM.fit(docs, vocabulary=30)
    found = []
    for often, sampled in ((LM.OFTEN, LM.SAMPLED), (2, 1)):
        monkeypatch.setattr(LM, "OFTEN", often)
        monkeypatch.setattr(LM, "SAMPLED", sampled)
        rows = LM.score(docs, lexicon, net, contexts=1).collect()
        found.append(sorted((r["n_tokens"], r["n_recalled"], r["n_contexts"], round(r["log_prob"], 2)) for r in rows))
        ahead = LM._often(docs.select("text"), lexicon)[1][0]
        assert bool(len(ahead)) == (often == 2)
    assert [x[:3] for x in found[0]] == [x[:3] for x in found[1]]
    assert all(math.isclose(a[3], b[3], abs_tol=0.05) for a, b in zip(*found))


def test_blocks_and_buckets_change_nothing(spark, docs, monkeypatch):
    lexicon, net = LM.fit(docs, vocabulary=30)
    key = lambda r: (r["n_tokens"], r["n_recalled"], round(r["log_prob"], 2))
    whole = sorted(map(key, LM.score(docs, lexicon, net, contexts=1).collect()))
    monkeypatch.setattr(LM, "BLOCK", 100)
    monkeypatch.setattr(LM, "SLICE", 300)
    monkeypatch.setattr(LM, "BUCKET", 200)
    small = sorted(map(key, LM.score(docs, lexicon, net, contexts=1).collect()))
    assert len(whole) == len(small) and all(a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=0.05) for a, b in zip(whole, small))

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkshelf.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = Counter(zip(words, words[1:], words[2:]))
    cover = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] >= 2 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #*\n\té😀|", max_size=80))
def test_measures_match_brute_force(text):
    assert Q.measure(text)[:5] == brute(text)


def test_table(docs, none):
    got = Q.quality_rules(docs).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=str) == sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=str)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert Q.quality_rules(none).count() == 0 and Q.keep_good(none).count() == 0


def test_filter_agrees_with_verdicts(docs):
    kept = sorted((r["doc_id"] for r in Q.quality_rules(docs).where("kept").collect()), key=str)
    out = Q.keep_good(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == kept


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.7
    votes = np.full((len(good), 8), -1)
    for k, (hit, miss) in enumerate([(0.95, 0.8), (0.9, 0.7), (0.98, 0.6), (0.97, 0.5), (0.95, 0.6), (0.96, 0.4), (0.93, 0.7), (0.97, 0.5)]):
        right = rng.random(len(good)) < np.where(good, hit, miss)
        said = rng.random(len(good)) < 0.9
        votes[:, k] = np.where(said, np.where(right, good, ~good), -1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, model = Q.estimate(patterns, counts.astype(float))
    assert abs(model["share"] - 0.7) < 0.05
    assert ((post[at.ravel()] >= 0.5) == good).mean() > 0.93


def test_labels_are_told_apart(spark, sf):
    d = sf.replace("0.001", "0.1")
    judged = Q.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "kept", "base_failed")
    rows = judged.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97
    assert bad and np.mean(bad) < 0.05


def test_a_script_without_capitals_is_not_shouting(spark):
    text = " ".join(f"\u6f22\u5b57{i}" for i in range(200)) + " A"
    assert Q.measure(text)[6:8] == (1, 1)
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert Q.quality_rules(rows).first()["votes"][2] == -1

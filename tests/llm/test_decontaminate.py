import hashlib
import random
import re

import pytest

from sparkshelf.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, it in items:
        iw = words(it)
        n = min(10, len(iw))
        if not n or item is None:
            continue
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for p in range(len(w) - n + 1):
            if tuple(w[p : p + n]) in wins:
                hit |= set(range(p, p + n))
                ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def fixture(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "Z9", "the"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 4, 5, 9, 10, 11, 14, 25]))) for i in range(40)] + [(7, "the the the the the"), (None, "w1 w2"), (99, None), (100, "!!")]
    docs = []
    for i in range(150):
        t = text(rng.choice([0, 3, 12, 40, 200]))
        if i % 3 == 0:
            t = t + "; " + (rng.choice(items)[1] or "").upper().replace(" ", ", ") + " " + text(5)
        docs.append((i, t if i % 10 else None, "x", 1))
    docs.append(docs[3])
    docs.append((None, "w1 w2 w3", "x", 1))
    d = spark.createDataFrame(docs, "doc_id bigint, text string, __w string, n_words int")
    return d, spark.createDataFrame(items, "item_id bigint, text string"), docs, items


@pytest.mark.parametrize("most", [D.MOST_WINDOWS, 3])
def test_against_brute_force(spark, most):
    d, b, docs, items = fixture(spark)
    got = sorted((tuple(r)[:6] for r in D.decontaminate(d, b, most_windows=most).collect()), key=str)
    assert got == sorted(((i, *brute(t, items)) for i, t, *_ in docs), key=str)


@pytest.mark.parametrize("most", [D.MOST_WINDOWS, 3])
def test_keep_clean(spark, most):
    d, b, docs, items = fixture(spark)
    got = sorted(map(tuple, D.keep_clean(d, b, most_windows=most).collect()), key=str)
    assert got == sorted((r for r in docs if not brute(r[1], items)[-1]), key=str)


def test_empty_sides(spark, docs, none):
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    assert D.decontaminate(none, b).count() == 0
    out = D.decontaminate(docs, b.limit(0))
    assert out.count() == docs.count() and out.where("contaminated").count() == 0
    assert D.keep_clean(docs, b.limit(0)).count() == docs.count()


def test_main_path_is_native(spark):
    d, b, *_ = fixture(spark)
    plan = D.decontaminate(d, b)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

"""Phrase mining against counting everything in one process."""

import random
import re
from collections import Counter

import pytest
from compare import compare, connect

from sparkshelf.llm import phrases
from sparkshelf.llm.queries import op13_phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, least, longest=4, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        known = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[known] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[(known, *ws[i : i + k])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    out = {}
    for p, a in f.items():
        lang, ws = p[0], p[1:]
        if len(ws) < 2 or any(q[0] == lang and len(q) > len(p) and 100 * f[q] >= 80 * a and any(q[i : i + len(ws)] == ws for i in range(1, len(q))) for q in f if len(q) > len(p)):
            continue
        cuts = [(2_000_000 * a // (f[lang, *ws[:k]] + f[lang, *ws[k:]]), k, f[lang, *ws[:k]], f[lang, *ws[k:]]) for k in range(1, len(ws))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, i, ph.decode(), -a, left, right, n[lang], -s) for lang, all_ in out.items() for i, (s, a, ph, left, right) in enumerate(sorted(all_)[:top], 1))


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    words = ["new", "York", "the", "of", "état", "日本", "a", "b", "c", "x-1", "city"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "?!"]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "de", None, "und", ""]), text + rng.choice(["", "new York city", "The state of new York", "a a a a a"])))
    return rows + [("en", None), ("en", ""), (None, " .,. "), ("en", "new York city " * 300)]


@pytest.mark.parametrize("most_bits", [1 << 15, 1 << 30])
def test_equals_counting_everything(spark, most_bits):
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(map(tuple, phrases.collocations(df, least=5, most_bits=most_bits).collect()))
    assert got == plainly(rows, 5) and len(got) > 60


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    """A bitmap that says yes to all phrases only costs counting."""
    rows = corpus(4, 120)
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "bitmap", lambda *a: b"\xff" * 4096)
    assert sorted(map(tuple, phrases.collocations(df, least=4, top=7).collect())) == plainly(rows, 4, top=7)


def test_small_slices_and_long_pieces(spark, monkeypatch):
    rows = corpus(5, 60)
    import pyarrow as pa

    texts, langs = pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows])
    whole = Counter()
    for together in (7, 50, 10_000_000):
        monkeypatch.setattr(phrases, "TOGETHER", together)
        for k in (1, 2, 4):
            got = Counter()
            for g in phrases._slices(texts, langs):
                for r in g.counted(k, None).to_pylist():
                    got[k, r["lang"], r["phrase"]] += r["n"]
            kept = {x: c for x, c in whole.items() if x[0] == k}
            assert not kept or kept == got
            whole.update(got if not kept else {})


def test_shorter_and_longer_levels(spark):
    rows = corpus(6, 100)
    df = spark.createDataFrame(rows, "lang string, text string")
    for longest in (2, 3):
        assert sorted(map(tuple, phrases.collocations(df, least=4, longest=longest).collect())) == plainly(rows, 4, longest)


def test_empty_tables_and_other_columns(docs, none):
    assert phrases.collocations(none).count() == 0
    out = phrases.collocations(docs)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_sql(spark, sf):
    assert compare(op13_phrases(spark, sf), connect(sf), phrases.ORACLE) is None


def test_a_large_batch_is_counted_in_little_memory():
    """Counting holds the arrays of one slice, not of a batch, and two workers of them fit beside a JVM in an executor."""
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(9)
    words = [f"word{i}" for i in range(3000)]
    texts = pa.array([" ".join(rng.choices(words, k=20_000)) for _ in range(60)])
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), texts], ["lang", "text"])
    for k in (1, 2):
        tracemalloc.start()
        total = sum(sum(n for n, p in zip(b["n"].to_pylist(), b["phrase"].is_valid().to_pylist()) if p) for b in phrases._emit(k, None)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 120e6, peak
        assert total == 60 * 20_000 if k == 1 else total <= 60 * 19_999

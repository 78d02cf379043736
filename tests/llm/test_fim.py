"""Fill-in-middle against a plain list of units, with all odd texts."""

import hashlib
import re

import pytest
from compare import compare, connect

from sparkshelf.llm import fim
from sparkshelf.llm.queries import op11_fim


def plainly(doc, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0)])
def test_equals_a_list_of_units(spark, docs, rate, spm):
    rows = docs.select("doc_id", "text").collect() + [(100 + i, t) for i, t in enumerate(["a\nb\n<S>c", "<<P\n>>S\n<\nM><", "\n", "\n\n\n", "é\n🙂\r\n漢", "a<\nS>", "x\n" * 5000])]
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string")
    out = fim.fill_in_middle(df, rate=rate, spm_rate=spm)
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted(((r[0], *plainly(*r, rate, spm)) for r in rows), key=repr)
    back = out.select("doc_id", fim.restored(out["output"], out["form"])).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((r[0], r[1] or "")) for r in rows)


def test_units_are_a_parameter(spark):
    df = spark.createDataFrame([(i, "one two  three") for i in range(40)], "doc_id bigint, text string")
    out = fim.fill_in_middle(df, units=r"\s*\S+|\s+").collect()
    assert {r["n"] for r in out} == {3} and {r["prefix_chars"] for r in out} == {0, 3, 7, 14}


def test_empty_table_and_other_columns(docs, none):
    assert fim.digests(none).count() == 0
    assert fim.digests(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_matcher_holds_no_list():
    """A million units: the traced peak is far below one list of them."""
    import tracemalloc

    text, units = "a\n" * 1_000_000, re.compile(fim.LINES)
    tracemalloc.start()
    assert fim.cut_points(text, units, 750_000, 250_000) == (1_000_000, 500_000, 1_000_000)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


def test_sql(spark, sf):
    assert compare(op11_fim(spark, sf), connect(sf), fim.ORACLE) is None

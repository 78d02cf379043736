"""The paged source over recorded pages: as a batch, as a stream, and what broken lists give."""

import json

import pytest

from sparkshelf.sources import paged as P


def record(folder, items, size=3, to=None):
    folder.mkdir(exist_ok=True)
    pages = [items[i : i + size] for i in range(0, len(items), size)] or [[]]
    for n, page in enumerate(pages[:to], 1):
        (folder / f"{n}.json").write_text(json.dumps({"Result": {"ProductList": page}}))
    return {"folder": str(folder), "items": "Result.ProductList", "size": str(size)}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 25, 48, 49])
def test_batch_reads_every_page_once(spark, tmp_path, n):
    P.register(spark)
    options = record(tmp_path / "p", [{"url": f"u{i}", "é": None} for i in range(n)])
    df = spark.read.format("paged").options(**options, block="2").load()
    got = sorted((r["page"], r["place"], json.loads(r["item"])["url"]) for r in df.collect())
    assert got == [(i // 3 + 1, i % 3, f"u{i}") for i in range(n)]
    assert df.rdd.getNumPartitions() == -(-(-(-n // 3)) // 2)


def test_last_page_takes_few_fetches(tmp_path, monkeypatch):
    options = record(tmp_path / "p", list(range(3000)))
    asked = []
    monkeypatch.setattr(P, "recorded", lambda page, o, real=P.recorded: asked.append(page) or real(page, o))
    assert P.Pages(options).last() == 1000 and len(asked) < 30


def test_errors(spark, tmp_path):
    P.register(spark)
    with pytest.raises(P.PageError, match="no items"):
        P.Pages(record(tmp_path / "empty", [])).last()
    with pytest.raises(P.PageError, match="no items"):
        P.Pages({"folder": str(tmp_path / "none")}).last()
    with pytest.raises(P.PageError, match="no list"):
        P.Pages({**record(tmp_path / "other", [1]), "items": "Result.Other"}).last()
    with pytest.raises(P.PageError, match="more than the size"):
        P.Pages({**record(tmp_path / "big", [1, 2, 3]), "size": "2"}).last()
    with pytest.raises(P.PageError, match="still full after 4"):
        P.Pages({**record(tmp_path / "long", list(range(18))), "most_pages": "4"}).last()
    gap = record(tmp_path / "gap", list(range(12)))
    reader = P.PagedReader(gap)
    parts = reader.partitions()
    (tmp_path / "gap/2.json").write_text(json.dumps({"Result": {"ProductList": [1]}}))
    with pytest.raises(P.PageError, match="short now"):
        list(reader.read(parts[0]))
    with pytest.raises(Exception, match="no items"):
        spark.read.format("paged").options(**record(tmp_path / "none2", [])).load().collect()


def test_stream_goes_on_where_it_was(spark, tmp_path):
    P.register(spark)
    items = [f"u{i}" for i in range(30)]
    options = record(tmp_path / "p", items[:4])

    def run():
        out = spark.readStream.format("paged").options(**options, block="3").load()
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(json.loads(r["item"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == sorted(items[:4])
    record(tmp_path / "p", items[:5])  # the short page grows
    assert run() == sorted(items[:5])
    record(tmp_path / "p", items[:29])  # and new ones come, more than a trigger's
    assert run() == sorted(items[:29])
    assert run() == sorted(items[:29])


def test_offsets_can_be_read_again(tmp_path):
    options = record(tmp_path / "p", list(range(11)))
    s = P.PagedStream({**options, "block": "2"})
    at, seen = s.initialOffset(), []
    for _ in range(3):
        rows, end = s.read(at)
        rows = list(rows)
        assert list(s.readBetweenOffsets(at, end)) == rows
        seen, at = seen + rows, end
    assert [json.loads(x) for _, _, x in seen] == list(range(11))

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkshelf.operators import joins as J
from sparkshelf.operators import lifecycle as L
from sparkshelf.sources import readers as R
from sparkshelf.sources import writers as W
from sparkshelf.streaming import streams as S

T0 = datetime(2024, 1, 1)


def test_versions_commit_and_roll_back(spark, tmp_path):
    t = W.Versioned(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    t.write(spark.range(3))
    t.update(lambda old: old.union(spark.range(10, 12)))
    assert t.read().count() == 5 and t.read(1).count() == 3
    with pytest.raises(Exception, match="boom"):
        t.write(spark.range(1).withColumn("x", F.raise_error(F.lit("boom"))))
    assert t.read().count() == 5
    t.rollback()
    assert t.read().count() == 3 and len(t.versions()) == 3 and len(set(t.versions())) == 2


def test_no_update_is_lost(spark, tmp_path):
    one, two = W.Versioned(spark, f"file://{tmp_path}/t"), W.Versioned(spark, f"file://{tmp_path}/t")
    one.write(spark.range(1))

    def slow(old):
        if two.read().count() == 1:  # the other writer commits while this one is at it
            two.update(lambda x: x.union(spark.range(10, 12)))
        return old.union(spark.range(20, 25))

    one.update(slow)
    assert one.read().count() == 8 and len(one.versions()) == 3
    names = [one._stored(spark.range(1)) for _ in range(2)]
    assert [one._commit(7, n) for n in names] == [True, False]


def test_exists_on_any_key_keeps_repeats(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, 4), (None, 9), (None, None)], "a int, b int")
    other = spark.createDataFrame([(1, 2), (1, 7), (None, 9)], "x int, y int")
    assert sorted(map(tuple, J.semi_any(df, other, [("a", "x"), ("b", "y")]).collect()), key=str) == [(1, 2), (1, 2), (None, 9)]


def test_merge_never_blanks(spark):
    old = spark.createDataFrame([(1, "a", 5.0, "m1"), (2, "b", 6.0, None)], "k int, name string, price double, code string")
    new = spark.createDataFrame([(1, " ", 0.0, "m9"), (2, "c", 7.0, "m2"), (3, "d", 0.0, "m3")], "k int, name string, price double, code string")
    got = sorted(map(tuple, W.merge_known(old, new, ["k"], never=("code",), positive=("price",)).collect()))
    assert got == [(1, "a", 5.0, "m1"), (2, "c", 7.0, "m2"), (3, "d", 0.0, "m3")]
    assert W.merge_known(None, new, ["k"]).count() == 3 and W.upsert(None, new, ["k"]).count() == 3


def test_staged_swap(spark):
    live = spark.createDataFrame([(1, "old"), (2, "keep")], "video int, text string")
    bad = spark.createDataFrame([(1, "q", "none")], "video int, text string, reason string")
    staged = spark.createDataFrame([(1, "new", None), (1, "odd", "several")], "video int, text string, reason string")
    a, b, before = W.swap_staged(live, bad, staged, "video")
    assert sorted(r["text"] for r in a.collect()) == ["keep", "new"]
    assert [r["text"] for r in b.collect()] == ["odd"] and sorted(r["text"] for r in before.collect()) == ["old", "q"]


def test_change_log_appends_changes_only(spark):
    h = spark.createDataFrame([("a", 5.0, 1), ("a", 6.0, 2)], "k string, v double, t int")
    p = spark.createDataFrame([("a", 6.0, 3), ("a", 7.0, 4), ("a", 7.0, 5), ("b", 0.0, 1), ("b", 1.0, 2)], "k string, v double, t int")
    assert sorted((r["k"], r["t"]) for r in W.changes_only(h, p, "k", "v", "t").collect()) == [("a", 4), ("b", 2)]


def test_other_writers(spark, tmp_path):
    links = spark.createDataFrame([(1, "auto", 5), (1, "human", 6), (2, "auto", 7)], "review_id int, source string, family_id int")
    m = spark.createDataFrame([(1, 9), (2, None)], "review_id int, family_id int")
    assert sorted(map(tuple, W.replace_auto_links(links, m).collect())) == [(1, "auto", 9), (1, "human", 6)]
    header = spark.createDataFrame([("h1",)], "file_hash string")
    assert W.load_once(header, header).count() == 0 and W.load_once(None, header).count() == 1
    W.append_telemetry(spark.createDataFrame([("x" * 50, 1)], "a string, b int"), f"file://{tmp_path}/log", 10)
    W.append_trace(spark.createDataFrame([("y", 2)], "a string, b int"), f"file://{tmp_path}/log")
    assert sorted(r["a"] for r in R.json_lines(spark, f"file://{tmp_path}/log", "a string, b int").collect()) == ["x" * 10, "y"]


def test_steps_stop_at_the_first_failure(spark):
    report = L.run_steps(spark, [("one", lambda s: s.range(3).count()), ("two", lambda s: 1 // 0), ("three", lambda s: 1)])
    assert [r["status"] for r in report] == ["ok", "failed", "skipped"]
    assert "two: ZeroDivisionError" in W.report_lines(report)


def test_jobs(spark):
    log = spark.createDataFrame([("a", "queued", 0, 10, T0), ("a", "processing", 5, 10, T0 + timedelta(hours=1)), ("b", "processing", 1, 10, T0 + timedelta(hours=8)), ("c", "queued", 0, 0, T0), ("c", "completed", 3, 3, T0 + timedelta(hours=1)), ("c", "queued", 3, 3, T0 + timedelta(hours=2))], "job_id string, status string, processed int, total int, updated_at timestamp")
    got = {r["job_id"]: (r["status"], r["progress"]) for r in L.job_status(log, F.lit(T0 + timedelta(hours=9))).collect()}
    assert got == {"a": ("failed", 50), "b": ("processing", 10), "c": ("failed", 99)}
    assert sorted((r["job_id"], r["before"], r["status"]) for r in L.bad_transitions(log).collect()) == [("c", "completed", "queued"), ("c", "queued", "completed")]


def plain_limit(hits, limit, window):
    held, out = [], []
    for t in hits:
        held = [h for h in held if t - h < window]
        if len(held) >= limit:
            out.append(window - (t - held[0]))
        else:
            held.append(t)
            out.append(None)
    return out


def test_rate_limit_on_batch_and_stream(spark, tmp_path):
    hits = [0, 1, 2, 3, 10, 11, 12, 13, 61, 62, 63]
    rows = [("u", T0 + timedelta(seconds=s)) for s in hits] + [("v", T0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    want = plain_limit(hits, 3, 60.0)
    got = [r["retry_after"] for r in S.rate_limit(df, "k", "ts", 3, 60.0).where("k = 'u'").orderBy("ts").collect()]
    assert got == want
    src = f"{tmp_path}/in"
    df.where("ts < timestamp '2024-01-01 00:00:11'").coalesce(1).write.parquet(src)
    q = None
    out = S.rate_limit(spark.readStream.schema(df.schema).parquet(src), "k", "ts", 3, 60.0)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        df.where("ts >= timestamp '2024-01-01 00:00:11'").coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r["retry_after"] for r in spark.sql("select * from limited where k = 'u' order by ts").collect()] == want


def test_daily_counts_stream_like_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    want = {r["day"]: r["n"] for r in S.daily(events, "ts", {"n": F.count(F.lit(1))}).collect()}
    out = S.daily(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"), "ts", {"n": F.count(F.lit(1))})
    q = out.writeStream.format("memory").queryName("daily").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r["day"]: r["n"] for r in spark.table("daily").collect()} == want


def test_small_stream_helpers(spark):
    assert S.token_bucket([60, 30, 10], 60) == [0.0, 60.0, 90.0]
    assert S.breaker([True, False, False, True, False, False, False, True], 3) == 7 and S.breaker([True], 1) is None
    targets = spark.createDataFrame([("u", "pending"), ("v", "scraped")], "url string, status string")
    ev = spark.createDataFrame([("u", "failed", 1), ("u", "scraped", 2), ("v", "failed", 1)], "url string, to_status string, ts int")
    assert {r["url"]: r["status"] for r in S.advance(targets, ev, "url").collect()} == {"u": "scraped", "v": "scraped"}
    made = []
    version = ["1"]
    cache = S.VersionedCache(lambda: version[0], lambda: made.append(1) or spark.range(2))
    assert cache.get().count() == cache.get().count() == 2 and len(made) == 1
    version[0] = "2"
    cache.get()
    assert len(made) == 2


def test_readers(spark, tmp_path):
    html = "<table id=x><tr><td>no<td>1</tr></table><table class='a' id='cputable'><tbody><tr><td> <a>Core &amp; i7</a></td><td>12,345</td></tr><tr><td>b</td><td>NA</td></tr><tr><td>c</td></tr></tbody></table>"
    assert [tuple(r) for r in R.benchmark_table(spark.createDataFrame([(html,)], "h string"), "h").collect()] == [("Core & i7", 12345)]
    with pytest.raises(Exception, match="fewer than 5"):
        R.at_least(spark.range(4), 5).collect()
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.html").write_bytes("<link rel=\"canonical\" href=\" http://x/ä \">".encode())
    (tmp_path / "p/b.html").write_bytes("<meta property=og:url content='http://y'>caf\xe9".encode("cp1252"))
    got = {r["path"][-6:]: (r["canonical_url"], "é" in r["html"]) for r in R.uploaded_pages(spark, f"file://{tmp_path}/p").collect()}
    assert got == {"a.html": ("http://x/ä", False), "b.html": ("http://y", True)}
    opt = lambda sel, delta, blocked=False: {"isSelected": sel, "isBlocked": blocked, "priceDelta": delta}
    body = {"body": {"options": {"chip": {"compatibleOptions": {"m5": opt(True, 0), "m5pro": opt(False, 10)}}, "memory": {"compatibleOptions": {"16": opt(True, 5), "32": opt(False, 105.5, True)}}}, "selectedKits": {"priceData": {"amount": 999}}}}
    rows = R.configurator(spark.createDataFrame([(json.dumps(body),)], "b string"), "b").orderBy("value").collect()
    assert [tuple(r) for r in rows] == [("m5", 999.0, "memory", "16", 0.0, True, False), ("m5", 999.0, "memory", "32", 100.5, False, True)]
    body["body"]["options"]["memory"]["compatibleOptions"]["32"]["isSelected"] = True
    with pytest.raises(Exception, match="unexpected options"):
        R.configurator(spark.createDataFrame([(json.dumps(body),)], "b string"), "b").collect()
    words = [(1, "UX3405-A1", 10.0, 60.0, 100.0), (1, "RM", 12.0, 25.0, 120.0), (1, "5,699", 28.0, 60.0, 121.0), (1, "GA403-B2", 300.0, 350.0, 100.0), (1, "RM36,999", 310.0, 350.0, 140.0), (2, "UX3405-A1", 0.0, 1.0, 1.0), (2, "RM1,000", 0.0, 1.0, 20.0), (3, "FX507-C3", 1.0, 2.0, 3.0)]
    got = R.price_rows(spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double")).collect()
    assert {r["sku"]: r["price"] for r in got} == {"UX3405-A1": 5699.0, "GA403-B2": 36999.0, "FX507-C3": None}
    specs = spark.createDataFrame([("<dl><dt>RAM</dt><dd> 16 <b>GB</b></dd></dl><table><tr><th>OS</th><td>W&amp;11</td></tr><tr><td>RAM</td><td>8</td></tr></table>",)], "h string")
    assert specs.select(R.spec_pairs("h").alias("m")).first()["m"] == {"RAM": "16 GB", "OS": "W&11"}
    api = spark.createDataFrame([(1, '{"items":[{"url":"a","kind":"x"},{"url":"b","kind":"pc"}]}'), (2, '{"items":[{"url":"a","kind":"x"}]}'), (3, '{"items":[{"url":"z","kind":"x"}]}')], "page int, body string")
    assert sorted(r["url"] for r in R.paged_items(api, "body", "page", "url string, kind string", ("pc",), 2).collect()) == ["a"]
    items = spark.createDataFrame([("ROG Strix G16 gaming laptop", 5000.0), ("Sleeve for ROG Strix G16", 900.0), ("ROG Strix G16", 50.0), ("Office chair", 900.0)], "title string, price double")
    assert [r["title"] for r in R.listings(items, "title", "price", F.lit("ROG Strix G16")).collect()] == ["ROG Strix G16 gaming laptop"]
    with pytest.raises(ValueError, match="no reader"):
        R.reader_for({"a": len}, "b")


def test_rate_limit_streams_a_hot_key(spark):
    import datetime as dt
    import random

    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    seconds = {"hot": sorted(rng.sample(range(20_000), 3000)), "a": [1, 2, 3, 4, 70], None: [5, 6, 7, 8]}
    rows = [(k, base + dt.timedelta(seconds=s)) for k, ss in seconds.items() for s in ss]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = S.rate_limit(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", 3, 60.0)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        got = {(r["k"], round(r["ts"].timestamp())): r["retry_after"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    at = round(base.timestamp())
    assert got == {(k, at + s): a for k, ss in seconds.items() for s, a in zip(ss, S.admit([float(at + s) for s in ss], [], 3, 60.0)[0])}

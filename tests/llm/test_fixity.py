import gzip
import zlib

from sparkshelf.llm import fixity as X

ROWS = [(i, f"http://h.org/{i}", f"<p>page {i}</p>" * (1 + i % 5)) for i in range(300)] + [(300, None, None), (301, "u\r\nX", "WARC/1.1\r\n\r\nContent-Length: 9"), (302, "é", "ü\r\n\r\nWARC/1.1\r\nWARC-Type: x"), (5, "again", "twice"), (None, "n", "no id"), (303, "", "x" * 200_000)]


def pages_of(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, idx int")


def test_a_drill_finds_the_planted_damage(spark):
    got = X.drill(pages_of(spark), one_in=11).collect()
    assert len(got) == len(ROWS)
    bad = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 11 == 0
    assert sorted(r["key"] for r in got if r["status"] == "damaged") == sorted("" if i is None else str(i) for i, *_ in ROWS if bad(i))
    assert {r["status"] for r in got} == {"ok", "damaged"}


def test_records_stand_where_the_manifest_says(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    X.write_warc(pages_of(spark), path, per_file=50)
    listed = X.manifest(spark, path).orderBy("file", "place").collect()
    assert len(listed) == len(ROWS) and len({(r["file"], r["place"]) for r in listed}) == len(ROWS)
    data = {int(p.parent.name.split("=")[1]): gzip.decompress(p.read_bytes()) for p in tmp_path.glob("a/file=*/part-*")}
    assert len(data) > 3
    bodies = []
    for r in listed:
        record = data[r["file"]][r["offset"] : r["offset"] + r["length"]].decode()
        head, _, body = record.partition(X.BREAK)
        assert head.startswith("WARC/1.1") and f"X-Key: {r['key']}" in head and f"Content-Length: {len(body.encode())}" in head
        bodies.append(body)
    assert sorted(bodies) == sorted(h or "" for _, _, h in ROWS)
    keys = [int(r["key"]) for r in listed if r["key"]]
    assert keys == sorted(keys)


def test_missing_truncated_and_lost_files(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    X.write_warc(pages_of(spark), path, per_file=50)
    X.damaged_replica(spark, path, f"file://{tmp_path}/b", one_in=10**9)
    parts = sorted(tmp_path.glob("b/file=*/part-*"))
    lost = int(parts[0].parent.name.split("=")[1])
    parts[0].unlink()
    cut = int(parts[1].parent.name.split("=")[1])
    parts[1].write_bytes(gzip.compress(gzip.decompress(parts[1].read_bytes())[:-40]))
    for crc in tmp_path.glob("b/file=*/.*.crc"):
        crc.unlink()
    listed = X.manifest(spark, path)
    got = X.audit(spark, listed, f"file://{tmp_path}/b").collect()
    by = {f: {r["status"] for r in got if r["file"] == f} for f in {r["file"] for r in got}}
    assert by[lost] == {"missing"}
    assert sum(r["status"] != "ok" for r in got if r["file"] == cut) == 1
    assert all(s == {"ok"} for f, s in by.items() if f not in (lost, cut))


def test_descent_enters_only_branches_that_differ(spark):
    leaves = [(i * 3, f"{i:064x}") for i in range(500)]
    changed = [(i, s if i not in (30, 600) else "0" * 63 + "f") for i, s in leaves if i != 900] + [(1, "a" * 64)]
    a, b = (spark.createDataFrame(x, "idx bigint, sha string") for x in (leaves, changed))
    n = X.levels_for(a)
    got = {r["idx"]: r["status"] for r in X.descend(X.build(a, n), X.build(b, n)).collect()}
    assert got == {30: "damaged", 600: "damaged", 900: "missing", 1: "extra"}
    assert X.descend(X.build(a, n), X.build(a, n)).count() == 0


def test_empty(spark):
    assert X.drill(pages_of(spark, [])).count() == 0


def test_forged_moved_resized_and_dropped_records(spark, tmp_path):
    """Every record of either side is accounted for, as a plain comparison of the two lists says."""
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    X.write_warc(pages_of(spark), a, per_file=50)
    X.damaged_replica(spark, a, b, one_in=10**9)
    parts = sorted(tmp_path.glob("b/file=*/part-*"))

    def change(part, how):
        records = [r for _, _, r in X.records_in(part.read_bytes())]
        how(records)
        part.write_bytes(b"".join(gzip.compress(r + X.BREAK.encode()) for r in records))  # a gzip member for a record
        return int(part.parent.name.split("=")[1])

    forged = X.warc_record("999", "http://forged.org/", "forged").encode()
    appended = change(parts[0], lambda r: r.append(forged))
    inserted = change(parts[1], lambda r: r.insert(10, forged))
    resized = change(parts[2], lambda r: r.__setitem__(5, X.warc_record("5x", "http://h/", "longer than before" * 9).encode()))
    swapped = change(parts[3], lambda r: r.__setitem__(slice(0, 2), [r[1], r[0]]))
    dropped = change(parts[4], lambda r: r.pop(3))
    for crc in tmp_path.glob("b/file=*/.*.crc"):
        crc.unlink()
    listed = X.manifest(spark, a)
    n = {r["file"]: r["count"] for r in listed.groupBy("file").count().collect()}
    got = X.audit(spark, listed, b).collect()
    count = lambda f: {s: sum(r["file"] == f and r["status"] == s for r in got) for s in {r["status"] for r in got if r["file"] == f}}
    assert count(appended) == {"ok": n[appended] - 1, "damaged": 1, "extra": 1}  # the record without a key, whose CRC-32 is zero
    assert count(inserted) == {"ok": 10, "moved": n[inserted] - 10, "extra": 1}
    assert count(resized) == {"ok": 5, "damaged": 1, "moved": n[resized] - 6}
    assert count(swapped)["moved"] >= 2 and set(count(swapped)) <= {"ok", "moved"}
    assert count(dropped) == {"ok": 3, "missing": 1, "moved": n[dropped] - 4}
    assert {r["key"] for r in got if r["status"] == "extra"} == {"999"}
    rest = set(n) - {appended, inserted, resized, swapped, dropped}
    assert all(count(f) == {"ok": n[f]} for f in rest)


def test_other_writers_records():
    body = b"GET / HTTP/1.1\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\na: b"
    request = b"WARC/1.0\r\nWARC-Type: request\r\nwarc-target-uri: http://h/\r\nWARC-Record-ID: <urn:uuid:2>\r\ncontent-length: %d\r\n\r\n" % len(body) + body
    for pack in (lambda x: x, gzip.compress):
        data = b"".join(pack(r + b"\r\n\r\n") for r in (info, request))
        assert [(k, r) for k, _, r in X.records_in(data)] == [("<urn:uuid:1>", info), ("http://h/ <urn:uuid:2>", request)]
        assert [at for _, at, _ in X.records_in(data)] == [0, len(info) + 4]
    assert list(X.records_in(b"")) == []
    assert [r for _, _, r in X.records_in(gzip.compress(info + b"\r\n\r\n" + request)[:-20])][0] == info

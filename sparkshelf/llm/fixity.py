"""WARC fixity: Merkle trees over archive replicas.

Pages are written as WARC files (gzip; offsets count uncompressed bytes), in order of id over and inside the files. A manifest lists
every record's file, place, offset, length and SHA-256. Leaves of the tree are records with their offset, length and hash; a node of
the next level covers ``fanout`` neighbours in order (an ordered range of offsets), a file is a whole number of such
ranges, and above the files the tree goes on to one root.

An audit lists the replica's own records, all of them, builds the same tree over them, compares roots and descends only
into nodes whose hashes differ, level by level, down to the leaves that differ on either side. So equal roots mean equal replicas; a
forged record shows as one that only the replica has. Every level is a small table in the shared folder; comparing a level joins it
with the children of the differing nodes of the level above, nothing else. Contents are hashed where they are read and never shuffled.

Files are read record by record, of whole-file gzip as of one gzip member for a record (WARC 1.0 or 1.1, any record types): a task holds
one compressed file and one record."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

FANOUT = 16
BREAK = "\r\n\r\n"
RECORDS = "file int, key string, place bigint, offset bigint, length bigint, sha string"


def warc_record(key: str | None, url: str | None, body: str | None) -> str:
    """A resource record without the line breaks that end it. Nulls count as empty; line breaks in a URL become %0A and %0D."""
    payload = body or ""
    where = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    size = len(payload.encode("utf-8", "surrogatepass"))
    digest = hashlib.sha256(f"{key}\0{where}\0{payload}".encode("utf-8", "surrogatepass")).hexdigest()
    ident = f"{digest[:8]}-{digest[8:12]}-{digest[12:16]}-{digest[16:20]}-{digest[20:32]}"
    head = ("WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{ident}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {where}", f"WARC-Block-Digest: sha256:{hashlib.sha256(payload.encode('utf-8', 'surrogatepass')).hexdigest()}", f"X-Key: {key if key is not None else ''}", "Content-Type: text/html", f"Content-Length: {size}")
    return "\r\n".join(head) + BREAK + payload


def _as_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [warc_record(*r) for r in zip(*(batch.column(k).to_pylist() for k in range(1, 4)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], ["file", "value"])


def _write(records: DataFrame, path: str) -> None:
    records.write.option("lineSep", BREAK).option("compression", "gzip").partitionBy("file").text(path)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", page: str = "html", per_file: int = 2048) -> None:
    """Writes pages as WARC files of about per_file records under path, ordered by id over and inside the files; rows of
    equal id may be split over files."""
    n = pages.count()
    rows = pages.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__at"), F.col(id_col).cast("string").alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))
    rows = rows.repartitionByRange(max(1, -(-n // per_file)), "__id", "__at").withColumn("file", F.spark_partition_id())
    _write(rows.sortWithinPartitions("file", "__id", "__at").select("file", "key", "url", "page").mapInArrow(_as_records, "file int, value string"), path)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"file=(\d+)/", 1).cast("int").alias("file"), "content")


START = re.compile(rb"WARC/1\.[01]\r\n")
NEXT = re.compile(rb"\r\n\r\n(?=WARC/1\.[01]\r\n)")
#: Bytes in which a header must end.
HEADER = 65_536


class _Window:
    """Uncompressed bytes of a file from ``at`` on, unpacked as they are asked for. A gzip stream that breaks off ends there."""

    def __init__(self, data: bytes):
        self.data, self.next = memoryview(data), 0
        self.held, self.at, self.ended = bytearray(), 0, False
        self.unpack = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self, n: int) -> bytes:
        if self.unpack is None:
            self.next += n
            return bytes(self.data[self.next - n : self.next])
        while True:
            piece = bytes(self.data[self.next : self.next + (1 << 16)])
            self.next += len(piece)
            try:
                out = self.unpack.decompress(self.unpack.unconsumed_tail + piece, n)
            except zlib.error:
                return b""
            if self.unpack.eof:  # the next member begins in what was handed over
                self.next -= len(self.unpack.unused_data)
                self.unpack = zlib.decompressobj(31)
            if out or self.next >= len(self.data) and not self.unpack.unconsumed_tail:
                return out

    def need(self, n: int) -> int:
        """Reads on until n bytes are held or the file ends; the bytes held."""
        while len(self.held) < n and not self.ended:
            more = self._more(max(1 << 16, n - len(self.held)))
            self.held += more
            self.ended = not more
        return len(self.held)

    def search(self, pattern: re.Pattern, start: int) -> int:
        """Where pattern is next found from start on, or -1; reads on in steps."""
        while True:
            if m := pattern.search(self.held, start):
                return m.start()
            start = max(start, len(self.held) - 16)
            before = len(self.held)
            if self.need(before + (1 << 18)) == before:
                return -1

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n


def records_in(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(key, offset, record) of each record of a file, gzipped or not, by the lengths that the records state. Where a header can't be read,
    or its length does not lead to the next record, the search goes on at the next line that begins one. The key is the X-Key header,
    else the target and the record id."""
    window = _Window(data)
    while window.need(1):
        window.need(HEADER)
        head = bytes(window.held[:HEADER]).partition(BREAK.encode())[0]
        size = re.search(rb"\r\nContent-Length:[ \t]*(\d+)", head, re.I)
        end = len(head) + 4 + int(size[1]) if size and START.match(head) else -1
        # a length beyond the file's end is found out by reading on to it
        if end < 0 or (have := window.need(end + 4 + 10)) < end or not (have == end + 4 or have == end or NEXT.match(window.held, end)):
            found = window.search(NEXT, 1)
            end = found if found >= 0 else max(0, len(window.held) - 4 * window.held.endswith(BREAK.encode()))
        key = re.search(rb"\r\nX-Key: ([^\r]*)", head)
        named = [m[1] for m in (re.search(rb"\r\n" + h + rb":[ \t]*([^\r]*)", head, re.I) for h in (rb"WARC-Target-URI", rb"WARC-Record-ID")) if m]
        yield (key[1] if key else b" ".join(named)).decode("utf-8", "replace"), window.at, bytes(window.held[:end])
        window.drop(end + 4)


def _list_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = [(file, key, i, at, len(record), hashlib.sha256(record).hexdigest()) for i, (key, at, record) in enumerate(records_in(content.as_py()))]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], ["file", "key", "place", "offset", "length", "sha"])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: file, key, place (in the file), offset, length, sha."""
    return _contents(spark, path).mapInArrow(_list_records, RECORDS)


def leaves(listed: DataFrame, room: int) -> DataFrame:
    """(idx, sha) of the leaves: idx leaves room after each file, sha stands for a record's offset, length and hash."""
    of = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "sha"), 256)
    return listed.select((F.col("file").cast("bigint") * room + F.col("place")).alias("idx"), of.alias("sha"))


def build(leaves: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the tree from leaves (idx, sha) up; a node hashes its children's places and hashes in order. At most fanout
    children meet in a group."""
    out = [leaves.select("idx", "sha")]
    for _ in range(levels):
        up = out[-1].groupBy(F.floor(F.col("idx") / fanout).cast("bigint").alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "sha"))).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["idx"].cast("string"), k["sha"])), ",")
        out.append(written(up.select(F.col("up").alias("idx"), F.sha2(joined, 256).alias("sha")), "merkle-level"))
    return out


def levels_for(leaves: DataFrame, fanout: int = FANOUT) -> int:
    last, n = leaves.agg(F.max("idx")).first()[0] or 0, 0
    while last:
        last, n = last // fanout, n + 1
    return n


def descend(mine: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(idx, status) of the leaves that differ: damaged, missing (only mine) or extra (only theirs). A branch whose hashes agree is
    never entered."""
    differ = None
    for a, b in zip(reversed(mine), reversed(theirs)):
        b = b.withColumnRenamed("sha", "other")
        if differ is not None:
            up = F.floor(F.col("idx") / fanout).cast("bigint")
            a = a.withColumn("up", up).join(differ, "up", "left_semi").drop("up")
            b = b.withColumn("up", up).join(differ, "up", "left_semi").drop("up")
        found = a.join(b, "idx", "full_outer").where(~F.col("sha").eqNullSafe(F.col("other")))
        differ = written(found.select(F.col("idx").alias("up"), F.when(F.col("other").isNull(), "missing").when(F.col("sha").isNull(), "extra").otherwise("damaged").alias("status")), "merkle-differ")
        if differ.isEmpty():
            break
    return differ.withColumnRenamed("up", "idx")


def audit(spark: SparkSession, listed: DataFrame, path: str, fanout: int = FANOUT) -> DataFrame:
    """The manifest's records, and those that only the replica under path has, with ``status``: ok; damaged (another record stands at this
    place); moved (the same record, byte for byte, stands elsewhere in the file); missing; extra (only in the replica).

    An empty archive gives no rows. Where records of one file are the same byte for byte, those at equal places go together first, the rest
    in order."""
    listed = written(listed, "warc-manifest")
    own = written(manifest(spark, path), "replica-manifest")
    last = max((r[0] or 0 for r in (d.agg(F.max("place")).first() for d in (listed, own))), default=0)
    room = fanout
    while room <= last:
        room *= fanout
    mine, theirs = leaves(listed, room), leaves(own, room)
    levels = max(levels_for(mine, fanout), levels_for(theirs, fanout))
    bad = written(descend(build(mine, levels, fanout), build(theirs, levels, fanout), fanout).select("idx"), "warc-differ")
    idx = (F.col("file").cast("bigint") * room + F.col("place")).alias("idx")
    a = listed.select("*", idx).join(bad, "idx", "left_semi")
    b = own.select("*", idx).join(bad, "idx", "left_semi")
    # the same bytes at another place: told by number among the file's leaves of one hash
    number = F.row_number().over(Window.partitionBy("file", "sha").orderBy("place")).alias("number")
    met = written(a.select("file", "sha", "idx", number).join(b.select("file", "sha", F.col("idx").alias("there"), number), ["file", "sha", "number"]).select("idx", "there"), "warc-moved")
    left = b.join(met.select(F.col("there").alias("idx")), "idx", "left_anti")
    here = a.join(met, "idx", "left_anti").select("idx").join(left.select("idx"), "idx", "left_semi")
    status = F.when(F.col("moved"), "moved").when(F.col("here"), "damaged").when(F.col("bad"), "missing").otherwise("ok")
    known = listed.select("*", idx).join(bad.withColumn("bad", F.lit(True)), "idx", "left").join(met.select("idx", F.lit(True).alias("moved")), "idx", "left")
    known = known.join(here.withColumn("here", F.lit(True)), "idx", "left")
    columns = ["key", "idx", "file", "offset", "length", "sha"]
    extra = left.join(a.select("idx"), "idx", "left_anti").select(*columns, F.lit("extra").alias("status"))
    # a replica's record at a place that is taken up by a moved or missing record of the manifest is extra too
    taken = left.join(a.select("idx"), "idx", "left_semi").join(here, "idx", "left_anti").select(*columns, F.lit("extra").alias("status"))
    return known.select(*columns, status.alias("status")).union(extra).union(taken)


def _damage(one_in: int):
    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for key, _, data in records_in(content.as_py()):
                    record = bytearray(data)
                    if zlib.crc32(key.encode()) % one_in == 0:
                        record[-1] = 63 if record[-1] != 63 else 33
                    rows.append(record.decode("utf-8", "replace"))
                    size += len(record)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.int32()), pa.array(rows, pa.string())], ["file", "value"])
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.int32()), pa.array(rows, pa.string())], ["file", "value"])

    return copy


def damaged_replica(spark: SparkSession, path: str, to: str, one_in: int = 97) -> None:
    """Copies an archive, overwriting the last byte of about one record in one_in (by CRC-32 of its key): for drills and tests."""
    _write(_contents(spark, path).mapInArrow(_damage(one_in), "file int, value string"), to)


def drill(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html", one_in: int = 97) -> DataFrame:
    """Writes pages as an archive, copies it with planted damage and audits the copy: one row for a page with its place and status.

    Null urls and html count as empty; texts of any length are one record; repeated rows and null ids are records of their own; rows of
    equal id follow each other in any order; an empty table gives no rows. Other columns are not read."""
    spark = pages.sparkSession
    top = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, f"{top}/main", id_col, url, page)
    damaged_replica(spark, f"{top}/main", f"{top}/replica", one_in)
    return audit(spark, manifest(spark, f"{top}/main"), f"{top}/replica")

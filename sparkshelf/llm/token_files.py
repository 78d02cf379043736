"""Token-ID output: documents as range-coded ids, in ascending order of id over all files.

Texts are dealt by ranges of the id and sorted within each; one stage then tokenizes, codes and writes, so ids themselves are
never shuffled. A row of the files is a chunk: ids of consecutive documents as coded blocks (idcoder), with the documents'
ids and lengths, and its place in its segment (the part of one task). What the driver learns is one total for each segment."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import idcoder
from .common import shared_dir

END = 2
#: Bytes that words and pieces may take in the cache of a task, as estimated; a full one is emptied.
MOST_WORD_BYTES, MOST_PIECE_BYTES = 48 << 20, 24 << 20
ENTRY = 160  # bytes of an entry besides its content
#: Segments (tasks of a write) whose totals are broadcast, at 12 bytes each.
MOST_SEGMENTS = 500_000
#: Bytes of texts that are tokenized together.
TOGETHER = 2_000_000
#: Pieces that go through the library as one text.
JOINED = 4_000
CHUNK = idcoder.BLOCK * idcoder.LANES
#: What a byte is within a plain word: 1 a letter, 2 a digit, 3 another sign; 0 is white space, 4 makes its word one that is not plain. Plain words
#: are those in which runs of a kind, single digits, are sure to be the tokenizer's own pieces: printable ASCII without apostrophe, and the
#: letters of Latin-1 (two bytes, of which the first is C3), which are composed already.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[33:127] = SIGN
KINDS[list(b" \t\n\r\x0b\x0c")] = SPACE
KINDS[list(b"0123456789")] = DIGIT
KINDS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
KINDS[0x27] = OTHER
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def by_words(description: dict) -> bool:
    """Whether a tokenizer, by its own description (the JSON of the library), encodes a text as the sequence of its words between ASCII
    white space: nothing is added around a text, white space is only ever dropped by the first split, and no step works across it."""
    first = description.get("pre_tokenizer") or {}
    steps = first.get("pretokenizers", [first])
    normal = description.get("normalizer") or {}
    normalizers = normal.get("normalizers", [normal] if normal else [])
    harmless = all(n.get("type") in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " " for n in normalizers)
    split = steps[0]
    drops = split.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and r"[^\s\p{L}\p{N}]+" in split.get("pattern", {}).get("Regex", "")
    bytes_after = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex", True) for s in steps[1:])
    added = all(not t.get("lstrip") and not t.get("rstrip") and not re.search(r"\s", t["content"]) for t in description.get("added_tokens", []))
    return harmless and bool(drops) and bytes_after and added


def _bytes(strings: pa.StringArray) -> list[bytes]:
    """The values of an array without nulls; to_pylist() would make a scalar of each first."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


class Words:
    """Ids of texts. A tokenizer that drops white space and splits there, as its description says (by_words), encodes a text as the
    sequence of its words, so each distinct word (bytes between ASCII white space) goes through it once while the cache holds
    it. If it also lower-cases, splits plain words into letters, digits and other signs and marks where a piece ends, texts are cut into
    such pieces at once and distinct pieces go through the library many at a time. Any other tokenizer encodes whole texts."""

    def __init__(self, file: str):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = tokenizers.Tokenizer.from_file(file)
        description = json.loads(self.tokenizer.to_str())
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.by_words = by_words(description)
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        suffix = description["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.by_pieces = False
        if self.by_words and suffix:
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith(suffix)
            self.by_pieces = self._splits()

    def _splits(self) -> bool:
        """Whether plain words do come as the ids of their pieces, tried on words of all kinds of seams."""
        probes = ["Abc12x", "don-t,###", "9z.Z9", "A.b.C", "x_1-$%a", "__", "42abc!!7", "HELLOworld", "(a)[b]", "\u00c9t\u00e9.", "na\u00efve-9", "\u00df\u00ff\u00c0\u00de1"]
        self.by_pieces = True
        try:
            got = [x.tobytes() for x in self.ids(probes)]
        except KeyError:
            return False
        self.known.clear()
        self.held = 0
        return got == self._encoded([w.encode() for w in probes])

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in got]

    def _learn_pieces(self, pieces: list[bytes]) -> None:
        size = np.dtype(self.kind).itemsize
        for a in range(0, len(pieces), JOINED):
            some = pieces[a : a + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, self.kind)
            raw, stops = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
            if len(stops) != len(some):
                raise KeyError("pieces do not end where the tokenizer says")
            self.known.update(zip(some, map(raw.__getitem__, map(slice, [0, *stops], stops))))

    def _pieces(self, texts: pa.StringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The plain words' pieces, in small letters, and the other words of all texts, coded by dictionary; where each text's begin and end;
        and which entries of the dictionary are other words."""
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends -= ends[0]
        kind, low = KINDS.take(raw), SMALL.take(raw)
        if len(raw) and raw.max() > 127:
            second = np.flatnonzero(raw[:-1] == 0xC3) + 1  # texts are whole UTF-8, so a second byte follows in the same text
            second = second[(raw[second] != 0x97) & (raw[second] != 0xB7)]
            kind[second] = kind[second - 1] = LETTER
            low[second[raw[second] < 0x9F]] += 32
        first = np.zeros(len(raw) + 1, bool)
        first[ends] = True
        first = first[:-1]
        space = kind == SPACE
        words = first.copy()
        words[1:] |= space[:-1]
        words &= ~space
        starts = words | (kind == DIGIT)
        starts[1:] |= kind[1:] != kind[:-1]
        starts &= ~space
        odd = kind == OTHER
        odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        bad = np.zeros(0, np.int64)
        if odd.any():
            # words that are not plain stay whole and as they are
            number = np.cumsum(words)
            bad = np.unique(number[odd])
            inside = np.zeros(int(number[-1]) + 1, bool)
            inside[bad] = True
            inside = inside[number] & ~space
            starts &= ~inside | words
            low[inside] = raw[inside]
        at = np.flatnonzero(starts)
        shown = ~space
        place = np.concatenate([[0], np.cumsum(shown)])
        cuts = np.append(place[at], place[-1]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(low[shown])]).dictionary_encode()
        others = np.zeros(len(coded.dictionary), bool)
        if len(bad):
            others[coded.indices.to_numpy()[inside[at]]] = True
        return coded, np.searchsorted(at, ends), others

    def _learn(self, words: list[bytes], others: list[bool]) -> None:
        """others: which of the words are not pieces."""
        if plain := [w for w, o in zip(words, others) if not o]:
            self._learn_pieces(plain)
        if rest := [w for w, o in zip(words, others) if o]:
            self.known.update(zip(rest, self._encoded(rest)))

    def ids(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each text; the words of all texts are told apart in one dictionary. Null texts have none."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([(t or "").encode("utf-8", "replace").decode() for t in texts], pa.string())
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return []
        if not self.by_words:
            got = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [np.array(x.ids, self.kind) for x in got]
        if self.by_pieces:
            coded, cuts, others = self._pieces(texts)
        else:
            lists = pc.ascii_split_whitespace(texts)
            coded = lists.flatten().dictionary_encode()
            cuts, others = lists.offsets.to_numpy() - lists.offsets[0].as_py(), np.ones(len(coded.dictionary), bool)
        words = _bytes(coded.dictionary)
        unknown = [i for i, w in enumerate(words) if w not in self.known]
        size = sum(len(words[i]) for i in unknown) * 2 + ENTRY * len(unknown)
        self.held += size
        if self.held > MOST_WORD_BYTES + MOST_PIECE_BYTES:
            self.known.clear()
            unknown = list(range(len(words)))
            self.held = sum(map(len, words)) * 2 + ENTRY * len(words)
        if unknown:
            self._learn([words[i] for i in unknown], others[unknown].tolist())
        values = list(map(self.known.__getitem__, words))
        pool = np.frombuffer(b"".join(values), self.kind)
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // pool.itemsize
        at = coded.indices.to_numpy()
        each = lengths[at]
        ends = np.cumsum(each)
        ids = pool[np.repeat((np.cumsum(lengths) - lengths)[at] - (ends - each), each) + np.arange(int(each.sum()))]
        return np.split(ids, np.concatenate([[0], ends])[cuts[1:-1]])


def _tokenized(words: Words, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        names, texts = batch.column(0).to_pylist(), batch.column(1)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(batch) else np.zeros(0)
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + TOGETHER, "right")))
            yield from zip(names[a:b], words.ids(texts.slice(a, b - a)))
            a = b


def _encode(file: str, end: int, kind: pa.DataType):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, segment, before = Words(file), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list = []
        lengths: list[int] = []
        last = np.array([end], words.kind if end < 1 << 16 else "<u4")

        def chunk() -> pa.RecordBatch:
            data = idcoder.encode(np.concatenate(ids))
            columns = [pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["segment", "start", "docs", "lengths", "data"])

        held = 0
        for doc, got in _tokenized(words, batches):
            ids += [got, last]
            docs.append(doc)
            lengths.append(len(got) + 1)
            held += lengths[-1]
            if held >= CHUNK:
                yield chunk()
                before += held
                ids, docs, lengths, held = [], [], [], 0
        if docs:
            yield chunk()

    return encode


def write_tokens(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", file: str | None = None, end: int = END) -> None:
    """Writes every document's ids, and the end id, under path. Null texts are empty; null ids come first; equal ids follow
    one another, ordered by a hash of their texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange("id", "h", "at").sortWithinPartitions("id", "h", "at").select("id", "text")
    kind = rows.schema["id"].dataType
    arrow = pa.int64() if kind.typeName() in ("long", "integer", "short", "byte") else pa.string()
    rows = rows.select(F.col("id").cast("bigint" if arrow == pa.int64() else "string").alias("id"), "text")
    out = rows.mapInArrow(_encode(file or tokenizer_path(), end, arrow), f"segment int, start bigint, docs array<{'bigint' if arrow == pa.int64() else 'string'}>, lengths array<bigint>, data binary")
    out.write.option("compression", "none").parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            segment, start = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            docs, lengths = batch.column(2)[k].values, np.asarray(batch.column(3)[k].as_py(), np.int64)
            ids = idcoder.decode(batch.column(4)[k].as_py()).astype("<u4")
            if len(ids) != lengths.sum():
                raise ValueError("a chunk does not hold its documents")
            ends = np.cumsum(lengths)
            raw, starts = memoryview(ids.tobytes()), ends - lengths
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            columns = [docs, pa.array([segment] * len(docs), pa.int32()), pa.array(start + starts), pa.array(lengths), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "segment", "at", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc, ids) of every document in files of write_tokens."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                lengths = np.asarray(batch.column(1)[k].as_py(), np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                values = pa.array(idcoder.decode(batch.column(2)[k].as_py()).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, pa.ListArray.from_arrays(offsets, values)], ["doc", "ids"])

    files = spark.read.parquet(path)
    return files.select("docs", "lengths", "data").mapInArrow(ids, f"doc {files.schema['docs'].dataType.elementType.simpleString()}, ids array<bigint>")


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document in the files: doc, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    kind = files.schema["docs"].dataType.elementType.simpleString()
    totals = files.select("segment", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n")).groupBy("segment").agg(F.sum("n").alias("n")).orderBy("segment").collect()
    base, at = [], 0
    for r in totals:
        base.append((r["segment"], at))
        at += r["n"]
    known = spark.createDataFrame(base, "segment int, base bigint")
    if len(base) <= MOST_SEGMENTS:  # else both sides are shuffled, which decodes twice when Spark changes its mind
        known = F.broadcast(known)
    each = files.select("segment", "start", "docs", "lengths", "data").mapInArrow(_decode, f"doc {kind}, segment int, at bigint, n_tokens bigint, ids_crc32 bigint")
    return each.join(known, "segment").select("doc", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None, file: str | None = None, end: int = END) -> DataFrame:
    """Writes docs as token files (under path, or in the shared folder) and reads them back: id_col, start, n_tokens (with the
    end id) and ids_crc32 of each document.

    Null or empty texts have the end id alone; repeated rows and null ids each keep a row; an empty table gives none.
    Other columns are not read. Integer ids of any width come back as bigint, others as strings."""
    spark = docs.sparkSession
    at = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, at, text, id_col, file, end)
    return read_digest(spark, at).withColumnRenamed("doc", id_col)

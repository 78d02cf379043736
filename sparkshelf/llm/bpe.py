"""Byte-level BPE: encoding by a priority queue of merges over linked symbols, decoding by concatenating vocabulary strings.

A text is split at added tokens, then into pieces by the pattern of byte-level tokenizers. Inside a piece every adjacent pair that can merge stands
in a heap by rank and place; merging rewires the doubly linked list and pushes the two new pairs, and what the heap holds of symbols that have
changed since is skipped when it comes up: n log n steps for a piece of n bytes, however long. A worker remembers the ids of
pieces up to a fixed number of bytes."""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pattern of byte-level pieces, as tokenizer files that ask for it (use_regex) mean it, with white space by Unicode's property.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A space before other white space or at the end; every other space begins a piece, as no piece goes from anything else into a space and what
#: follows it, and of a run of white space before a word the last one goes with the word.
LOOSE = re.compile(r" (?:\s|\Z)")
#: Bytes that a worker's memory of words may hold, as estimated; a full one becomes the old one, where words that come again are found.
MOST_BYTES, ENTRY = 64 << 20, 170
#: Places of the marks of words that came once.
SEEN = 1 << 22


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the others as 256, 257 and so on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Strings:
    """What decoding takes: the bytes of each id, without what encoding needs besides."""

    def __init__(self, description: dict):
        letters = byte_letters()
        vocabulary: dict[str, int] = description["model"]["vocab"]
        added = description.get("added_tokens") or []
        self.size = max([*vocabulary.values(), *(t["id"] for t in added)]) + 1
        as_bytes = lambda s: bytes(map(letters.__getitem__, s)) if all(c in letters for c in s) else s.encode()
        self.strings = [b""] * self.size
        for s, i in [*vocabulary.items(), *((t["content"], t["id"]) for t in added)]:
            self.strings[i] = as_bytes(s)

    def decode(self, ids: list[int]) -> str:
        """The text of ids in the vocabulary: their strings one after another, what is no UTF-8 replaced."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class Coder(dict):
    """What stands between two spaces of a text -> the ids of it and the space before it, as int32 bytes, found when first asked for."""

    def __init__(self, description: dict):
        super().__init__()
        self.check(description)
        model, letters, added = description["model"], byte_letters(), description.get("added_tokens") or []
        vocabulary: dict[str, int] = model["vocab"]
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = vocabulary[letter]
        self.decode = Strings(description).decode
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocabulary.values()) + 1)]  # left symbol -> right symbol -> rank
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[a]][vocabulary[b]] = rank
            self.made.append(vocabulary[a + b])
        self.added = {t["content"]: array("i", [t["id"]]).tobytes() for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_at = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
        self.piece = regex.compile(PIECE)
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.seen = bytearray(SEEN)
        self.held = 0

    @staticmethod
    def check(description: dict) -> None:
        """Raises ValueError for tokenizers of other kinds."""
        model = description["model"]
        split = description.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or not plain or description.get("normalizer") or odd:
            raise ValueError("not a plain byte-level BPE tokenizer")
        added = description.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that strip or need word bounds are not supported")

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            pieces = self.piece.findall(f" {word}")
            ids = self._merged(pieces[0]) if len(pieces) == 1 else self._of(pieces)
            place = hash(word) & (SEEN - 1)
            if not self.seen[place]:  # most new words never come again: one is kept from the second time on
                self.seen[place] = 1
                return ids
        self.held += ENTRY + 2 * len(word) + len(ids)
        self[word] = ids
        return ids

    def _merged(self, piece: str) -> bytes:
        return array("i", self.merged(piece.encode("utf-8", "replace"))).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = self._merged(piece)
            self.held += ENTRY + 2 * len(piece) + len(ids)
        return ids

    def _of(self, pieces: list[str]) -> bytes:
        return b"".join([self[p[1:]] if p[0] == " " and len(p) > 1 else self._piece(p) for p in pieces])

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids, made, ranks = list(map(self.of_byte.__getitem__, piece)), self.made, self.ranks
        n = len(ids)
        place, most = n.bit_length(), (1 << n.bit_length()) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [ranks[a].get(b, -1) for a, b in zip(ids, ids[1:])]  # of each symbol with the next: the rank at which they merge
        heap = [rank << place | i for i, rank in enumerate(now) if rank >= 0]
        now.append(-1)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, rank = top & most, top >> place
            if now[i] != rank:
                continue  # stale: this symbol or the next has merged since
            j = after[i]
            one = ids[i] = made[rank]
            ids[j] = now[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = now[i] = ranks[one].get(ids[k], -1)
                if new >= 0:
                    heappush(heap, new << place | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                new = now[h] = ranks[ids[h]].get(one, -1)
                if new >= 0:
                    heappush(heap, new << place | h)
        return [i for i in ids if i >= 0]

    def _ordinary(self, text: str) -> bytes:
        """The ids of a text without added tokens. Words are looked up whole where spaces stand alone."""
        if LOOSE.search(text):
            return self._of(self.piece.findall(text))
        first, *words = text.split(" ")
        return b"".join([self._of(self.piece.findall(first)), *map(self.__getitem__, words)])

    def encode(self, text: str) -> bytes:
        """The ids of a text as int32; added tokens in the text are those tokens."""
        if self.held > MOST_BYTES:
            self.old.clear()
            self.old.update(self)
            self.clear()
            self.pieces.clear()
            self.seen = bytearray(SEEN)
            self.held = 0
        if self.added_at is None:
            return self._ordinary(text)
        out, at = [], 0
        for m in self.added_at.finditer(text):
            out += [self._ordinary(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self._ordinary(text[at:] if at else text)])


@functools.lru_cache(2)
def coder(file: str) -> Coder:
    """The tokenizer of a file, once for each worker process."""
    with open(file, encoding="utf-8") as f:
        return Coder(json.load(f))


@functools.lru_cache(2)
def strings(file: str) -> Strings:
    """The strings of a tokenizer's file, once for each worker process."""
    with open(file, encoding="utf-8") as f:
        description = json.load(f)
    Coder.check(description)
    return Strings(description)


def _encoded(c: Coder, texts: pa.Array) -> pa.Array:
    """The ids of a batch; one text is held at a time."""
    out, ends = bytearray(), array("i", [0])
    for t in texts:
        out += c.encode(t.as_py() or "")
        ends.append(len(out) // 4)
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(out, np.int32)))


def _decoded(c: Strings, lists: pa.Array) -> pa.Array:
    """The texts of a batch; one list is held at a time."""
    flat = lists.flatten()  # without what null lists may hide
    flat = (pc.fill_null(flat, -1) if flat.null_count else flat).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()

    def texts() -> Iterator[str]:
        a = 0
        for n in lengths:
            ids = flat[a : a + n]
            a += n
            if n and (ids.min() < 0 or ids.max() >= c.size):
                ids = ids[(ids >= 0) & (ids < c.size)]
            yield c.decode(ids.tolist())

    return pa.concat_arrays([pa.array(some, pa.string()) for some in _some(texts(), 500)] or [pa.array([], pa.string())])


def _some(items: Iterator, n: int) -> Iterator[list]:
    while some := list(islice(items, n)):
        yield some


def ids_of(text: Column, file: str | None = None) -> Column:
    """array<int>: a text's ids. Null gives an empty array."""
    at = file or tokenizer_path()

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(at)
        for texts in batches:
            yield _encoded(c, texts)

    return run(text)


def text_of(ids: Column, file: str | None = None) -> Column:
    """string: the text of an array<int> of ids. Null gives an empty text."""
    at = file or tokenizer_path()

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = strings(at)
        for lists in batches:
            yield _decoded(c, lists)

    return run(ids)


def encode(docs: DataFrame, text: str = "text", id_col: str = "doc_id", file: str | None = None) -> DataFrame:
    """Per row of docs: id_col and ids (array<int>), as the tokenizers library gives them without special tokens added around a text, padding or
    truncation.

    Null and empty texts have no ids; texts of any length are encoded whole, one at a time; pairs of one rank merge from the left; repeated rows and
    null ids each keep a row; an empty table gives none. Other columns are not read."""
    return docs.select(id_col, ids_of(F.col(text), file).alias("ids"))


def decode(rows: DataFrame, ids: str = "ids", id_col: str = "doc_id", file: str | None = None) -> DataFrame:
    """Per row: id_col and text. Null or empty ids give an empty text; ids outside the vocabulary give nothing; the rest as encode()."""
    return rows.select(id_col, text_of(F.col(ids), file).alias("text"))


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", file: str | None = None) -> DataFrame:
    """Per row of docs: id_col, n_tokens, and hashes of the ids (decimal, joined by commas) and of the text decoded from them."""
    rows = encode(docs, text, id_col, file)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(id_col, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(text_of(F.col("ids"), file), 256).alias("decoded_sha256"))

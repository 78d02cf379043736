"""LM scoring by masked pseudo-likelihood.

A small network sees two words on each side of a masked word and predicts it; the sum of the conditional log-probabilities
over all positions scores a document.

Words are counted over the whole corpus. The ``vocabulary`` most frequent are dealt to classes of about equal mass (the
commonest have one each), others to a few classes by length. p(word | window) = p(class | window) * p(word | class): the
network gives the first factor, the corpus counts the second, for every word that was counted. Tasks hold the counts of the
vocabulary; those of all other words, which grow with the corpus, stay a Spark table that meets the documents' words in a join.

Training covers every position of every document: each task makes one pass of minibatch steps over its own rows from the
same start, and the tasks' weights are averaged by the words that they saw. Averages are sums of integers, grouped and added in
Spark, so the driver gets one fixed-size set of weights whatever the number of tasks, and reruns agree.

The network's weights are few; what the corpus says beyond them is a table of contexts, which grows with it: how often a word stands between
its two neighbours, counted over all documents that are scored. It takes the network's p as the prior of weight one: a word that m of the n
other places with these neighbours hold has (m + p) / (n + 1), so a place of new neighbours keeps p, and the masked place itself never counts.
Neighbours are taken whose hash is divisible by ``contexts``, the same ones everywhere, so that n and m are exact; 1 takes all, 0 none.

Places are never rows of Spark. A task packs those of a block of documents, column by column, for each bucket of neighbours; Spark shuffles
the packs, a task counts each bucket, and sums for each document go back. Words outside the vocabulary meet their counts on the way, in
buckets of words. Neighbours and places that would crowd a bucket are counted ahead: such places are settled where the texts are, other
words between such neighbours are dealt by word. Words outside the vocabulary and neighbours go by hashes of 63 and 64 bits."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import written
from .token_files import _bytes

CLASSES, RARE, HIDDEN, REACH = 64, 6, 24, 2
VOCABULARY = 30_000
LONG = 40
FLUSH = 400_000
BATCH, SCORED = 4096, 1024
#: Bytes of texts whose words are told apart together.
SLICE = 4_000_000
SCALE = 1 << 20
#: The query counts every pair of neighbours; each place is a row that Spark shuffles.
CONTEXTS = 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _key(word: bytes) -> bytes:
    return word if len(word) <= LONG else b"\x00" + hashlib.sha1(word).digest()


#: The longest words of the bands but the last, in bytes.
BANDS = np.array([4, 7, 10, 14, LONG])


def rare_class(length: int) -> int:
    """0 to RARE - 1 by the length of a word in bytes."""
    return int(np.searchsorted(BANDS, length))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts, nulls as empty ones, some at a time: SLICE bytes, or one text."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
        yield texts.slice(a, b - a)
        a = b


def split(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of texts without nulls, as words_of() has them: distinct words, the number among these of the word at each place, and how
    many places each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words, at = _bytes(coded.dictionary), coded.indices.to_numpy()
    offsets -= offsets[0]
    if b"" in words:  # white space at either end of a text
        keep = at != words.index(b"")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        at = at[keep]
    return words, at, np.diff(offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        keys = list(seen)
        size = [len(k) if k[:1] != b"\x00" else LONG + 1 for k in keys]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(size, pa.int32()), pa.array(seen.values(), pa.int64())], ["word", "size", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for texts in _slices(batch.column(0)):
            words, at, _ = split(texts)
            for w, n in zip(words, np.bincount(at, minlength=len(words)).tolist()):
                if n:
                    seen[w if len(w) <= LONG else _key(w)] += n
            if len(seen) > FLUSH:
                yield out()
                seen = Counter()
    yield out()


class Lexicon:
    """word -> class and log p(word | class); the last RARE classes hold words outside the vocabulary. counts: the table of all words,
    which stays behind when tasks take a copy."""

    def __init__(self, top: list[tuple[bytes, int]], rare: dict[int, tuple[int, int]], counts: DataFrame):
        """top: words and counts; rare: class by length -> (distinct words, occurrences)."""
        self.counts = counts
        many = CLASSES - RARE
        self.of: dict[bytes, int] = {}
        mass = [0.0] * many
        own = many // 2  # the commonest words have classes of their own, the others fill the rest by mass
        rest, done = max(1, sum(n for _, n in top[own:])), 0
        for i, (w, n) in enumerate(top):
            if i < own:
                self.of[w] = i
            else:
                self.of[w] = own + min(many - own - 1, done * (many - own) // rest)
                done += n
            mass[self.of[w]] += n
        self.within = {w: float(np.log(n / mass[self.of[w]])) for w, n in top}
        self.rare = np.array([-np.log(max(1, rare.get(k, (0, 0))[1])) for k in range(RARE)])
        self.prior = np.array([*mass, *(rare.get(k, (0, 0))[1] for k in range(RARE))], float) + 1.0
        self.prior /= self.prior.sum()
        # by number of a word, so that a text is looked up once; the last entry is that of words outside the vocabulary
        self.number = {w: i for i, (w, _) in enumerate(top)}
        self.class_at = np.array([*(self.of[w] for w, _ in top), 0], np.int64)
        self.within_at = np.array([*(self.within[w] for w, _ in top), 0.0])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def look_up(self, words: list[bytes], numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word its class and log p(word | class), and the places of words outside the vocabulary. These count as seen once
        here; score() adds the logarithm of their counts."""
        numbers = self.numbers(words) if numbers is None else numbers
        classes, within, others = self.class_at[numbers], self.within_at[numbers], np.flatnonzero(numbers < 0)
        bands = np.searchsorted(BANDS, np.fromiter((len(words[i]) for i in others.tolist()), np.int64, len(others)))
        classes[others], within[others] = CLASSES - RARE + bands, self.rare[bands]
        return classes, within, others

    def classes(self, words: list[bytes]) -> np.ndarray:
        return self.look_up(words)[0]

    def log_within(self, words: list[bytes]) -> float:
        return float(self.look_up(words)[1].sum())


class Network:
    """Class CLASSES stands for the edge of a text. Each of the four places of the window has its own input weights."""

    SHAPES = ((2 * REACH, CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))

    def __init__(self, prior: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = [(rng.standard_normal(s) * 0.2).astype(np.float32) for s in self.SHAPES]
        self.w[1][:] = 0
        self.w[3][:] = np.log(prior)

    def hidden(self, seq: np.ndarray, a: int, b: int) -> np.ndarray:
        """For the places a to b of seq, which has REACH more on both sides."""
        total = self.w[0][0].take(seq[a - REACH : b - REACH], axis=0)
        for k, offset in enumerate(o for o in range(-REACH, REACH + 1) if o):
            if k:
                total += self.w[0][k].take(seq[a + offset : b + offset], axis=0)
        total += self.w[1]
        return np.tanh(total, out=total)

    def odds(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(z, e, s): the outputs, their exponentials and each row's sum of these. A row's greatest output is taken off only where
        exponentials would leave the range of floats."""
        z = h @ self.w[2]
        z += self.w[3]
        with np.errstate(over="ignore"):
            e = np.exp(z)
        s = e @ np.ones(CLASSES, np.float32)
        if len(s) and not (1e-20 < s.min() and s.max() < 1e30):
            z -= z.max(1, keepdims=True)
            np.exp(z, out=e)
            s = e.sum(1)
        return z, e, s

    def log_p(self, h: np.ndarray) -> np.ndarray:
        z, _, s = self.odds(h)
        return z - np.log(s)[:, None]

    def log_own(self, seq: np.ndarray) -> np.ndarray:
        """log p of the class at each place of seq but the first and last REACH; that of an edge is of no use."""
        out = np.empty(len(seq) - 2 * REACH, np.float32)
        for a in range(REACH, len(seq) - REACH, SCORED):
            b = min(a + SCORED, len(seq) - REACH)
            z, _, s = self.odds(self.hidden(seq, a, b))
            out[a - REACH : b - REACH] = z[np.arange(b - a), np.minimum(seq[a:b], CLASSES - 1)] - np.log(s)
        return out

    def step(self, seq: np.ndarray, a: int, b: int, sums: list, rate: float) -> None:
        """One Adagrad step on the places a to b; edges are not predicted."""
        keep = seq[a:b] < CLASSES
        n = int(keep.sum())
        if not n:
            return
        h = self.hidden(seq, a, b)
        _, d, total = self.odds(h)
        d *= (keep / (total * n)).astype(np.float32)[:, None]
        d[np.flatnonzero(keep), seq[a:b][keep]] -= np.float32(1 / n)
        g2, g3 = h.T @ d, d.sum(0)
        dh = (d @ self.w[2].T) * (1 - h * h)
        hot = np.zeros((b - a + 2 * REACH, CLASSES + 1), np.float32)
        hot[np.arange(len(hot)), seq[a - REACH : b + REACH]] = 1
        beside = np.zeros((len(hot), 2 * REACH, HIDDEN), np.float32)
        for k, offset in enumerate(o for o in range(-REACH, REACH + 1) if o):
            beside[REACH + offset : REACH + offset + b - a, k] = dh
        g0 = (hot.T @ beside.reshape(len(hot), -1)).reshape(CLASSES + 1, 2 * REACH, HIDDEN).transpose(1, 0, 2)
        for w, g, s in zip(self.w, (g0, dh.sum(0), g2, g3), sums):
            s += g * g
            w -= rate * g / np.sqrt(s)


def joined(classes: list[np.ndarray]) -> np.ndarray:
    """The texts in one sequence, REACH edges before, between and after them."""
    edge = np.full(REACH, CLASSES, np.int64)
    return np.concatenate([edge, *(x for c in classes for x in (c, edge))])


def _edged(values: np.ndarray, lengths: np.ndarray, edge: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """joined() for texts that stand one after another in values, with many edges; and the places of the values in it."""
    at = np.arange(len(values)) + many * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    out = np.full(len(values) + many * (len(lengths) + 1), edge, values.dtype)
    out[at] = values
    return out, at


def _trainer(lexicon: Lexicon, rate: float):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Network(lexicon.prior), 0
        sums = [np.full(s, 1e-6, np.float32) for s in Network.SHAPES]
        for batch in batches:
            for texts in _slices(batch.column(0)):
                words, at, lengths = split(texts)
                seq, _ = _edged(lexicon.classes(words)[at], lengths, CLASSES, REACH)
                seen += len(at)
                for a in range(REACH, len(seq) - REACH, BATCH):
                    net.step(seq, a, min(a + BATCH, len(seq) - REACH), sums, rate)
        flat = np.concatenate([w.ravel() for w in net.w])
        value = np.rint(flat.astype(np.float64) * SCALE).astype(np.int64) * seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value), pa.array(np.full(len(value), seen))], ["i", "v", "n"])

    return train


def mixed(z: np.ndarray) -> np.ndarray:
    """One to one on numbers of 64 bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def place_keys(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For neighbours and the word between them."""
    return mixed(keys + mixed(own + np.uint64(1)))


#: Kinds of packed rows: (names and sums of a block's documents), places by neighbours, places of words whose counts are asked for, what such
#: places add to documents, and counts.
ROWS, PLACES, ASKED, GAINS, COUNTS = range(5)
EDGE = 1 << 62
#: Places of a block (one text at least), documents of one, places of a bucket on average.
BLOCK, MOST_ROWS, BUCKET = 700_000, 50_000, 2_500_000
#: Neighbours and places that occur more often than this are counted ahead, as found in one document in SAMPLED.
OFTEN, SAMPLED = 1_000_000, 64
#: log p of places with counted neighbours is rounded to these parts (1e-5 of it or so): 3 bytes, 4 if any is beyond.
PARTS = 1 << 13


#: A random number for each place in a word and each byte there.
TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, LONG * 256, np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as their bytes by significance, compressed: the high bytes of most are few."""
    head = np.array([x for a in arrays for x in (a.dtype.itemsize, len(a))], "<u4")
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)
    return np.array([len(arrays), len(raw)], "<u4").tobytes() + head.tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    many, size = np.frombuffer(data, "<u4", 2).tolist()
    head = np.frombuffer(data, "<u4", 2 * many, 8).reshape(-1, 2).tolist()
    raw, at, out = np.frombuffer(pa.decompress(data[8 + 8 * many :], size, "zstd"), np.uint8), 0, []
    for width, n in head:
        out.append(np.ascontiguousarray(raw[at : at + width * n].reshape(width, n).T).reshape(-1).view(f"<u{width}"))
        at += width * n
    return out


def _steps(rows: np.ndarray) -> np.ndarray:
    """Differences of numbers that mostly ascend; np.cumsum in 32 bits restores them."""
    rows = rows.astype(np.uint32)
    return np.diff(rows, prepend=np.uint32(0))


def _log_packed(log_p: np.ndarray) -> list[np.ndarray]:
    v = np.rint(log_p * -PARTS).clip(0, (1 << 32) - 1).astype(np.uint32)
    return [(v & 0xFFFF).astype(np.uint16), (v >> 16).astype(np.uint8 if len(v) == 0 or v.max() < 1 << 24 else np.uint16)]


def _log_unpacked(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low + high.astype(np.float64) * 65536) / -PARTS


def _hashes(words: list[bytes]) -> np.ndarray:
    """Of words (at most LONG bytes) outside the vocabulary, by tabulation; above all numbers of words inside and EDGE."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    each = TABLE.take((at << 8) + np.frombuffer(b"".join(words), np.uint8))
    out, some = np.zeros(len(words), np.uint64), lengths > 0
    if len(each):
        out[some] = np.bitwise_xor.reduceat(each, starts[some])
    return out | np.uint64(1 << 63)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # 16 bits sort quickly


def _home(block: int, buckets: int) -> int:
    return int(_bucket(mixed(np.array([block], np.uint64)), buckets)[0])


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


class _Out:
    """Packed rows: to, block, kind, data, and the names of the documents of a block."""

    def __init__(self, kind: pa.DataType):
        self.kind = pa.list_(kind)

    def row(self, to: int, block: int, kind: int, data: bytes, ids: pa.Array | None = None) -> pa.RecordBatch:
        names = pa.nulls(1, self.kind) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(self.kind)
        return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([data], pa.binary()), names], ["to", "block", "kind", "data", "ids"])

    def gains(self, block: int, buckets: int, rows: np.ndarray, gain: np.ndarray, recalled: np.ndarray) -> pa.RecordBatch:
        """rows ascending, one entry a place; gain in SCALE-ths."""
        at = _runs(rows)
        sums = np.add.reduceat(gain, at) if len(at) else gain
        many = (np.add.reduceat(recalled.astype(np.int64), at) if len(at) else recalled).astype(np.uint32)
        return self.row(_home(block, buckets), block, GAINS, pack(_steps(rows[at]), sums.astype(np.int64).view(np.uint64), many))


def _gain(log_p: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What m of n other places add to log_p, in SCALE-ths."""
    return np.rint((np.log((m + np.exp(log_p)) / (n + 1.0)) - log_p) * SCALE).astype(np.int64)


def _counted(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The counts of keys, 0 for those that were not counted ahead."""
    names, counts = known
    if not len(names):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, counts[at], 0)


class _Texts:
    """The places of some texts: of each its row, number of its word (or hash), log p(class) and log p(word | class), neighbours' key."""

    def __init__(self, lexicon: Lexicon, net: Network | None, texts: pa.Array):
        words, at, self.lengths = split(texts)
        numbers = lexicon.numbers(words)
        codes, others = numbers.astype(np.uint64), np.flatnonzero(numbers < 0)
        if len(others):
            codes[others] = _hashes([_key(words[i]) for i in others.tolist()])
        self.own, self.rare = codes[at], (numbers < 0)[at]
        beside, place = _edged(self.own, self.lengths, EDGE, 1)
        self.left, self.right = beside[place - 1], beside[place + 1]
        self.keys = mixed(mixed(self.left) + self.right)
        if net is not None:
            classes, within, _ = lexicon.look_up(words, numbers)
            seq, place = _edged(classes[at], self.lengths, CLASSES, REACH)
            self.log_class, self.within = net.log_own(seq)[place - REACH].astype(np.float64), within[at]

def _sampler(lexicon: Lexicon):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of neighbours and of places that occur twice or more, and under 0 the number of all places."""
        for batch in batches:
            for texts in _slices(batch.column(0)):
                t = _Texts(lexicon, None, texts)
                keys, n = np.unique(np.concatenate([t.keys, place_keys(t.keys, t.own)]), return_counts=True)
                keys, n = np.append(keys[n > 1], np.uint64(0)), np.append(n[n > 1], len(t.keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return sample


def _counter(lexicon: Lexicon, keys: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(keys), np.int64)
        for batch in batches:
            for texts in _slices(batch.column(0)):
                t = _Texts(lexicon, None, texts)
                at = np.minimum(np.searchsorted(keys, t.keys), len(keys) - 1)
                here = keys[at] == t.keys
                n += np.bincount(at[here], minlength=len(keys))
                z = place_keys(t.keys[here], t.own[here])
                at = np.minimum(np.searchsorted(keys, z), len(keys) - 1)
                n += np.bincount(at[keys[at] == z], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return count


def _scorer(lexicon: Lexicon, net: Network, contexts: int, buckets: int, known: tuple[np.ndarray, np.ndarray], names: pa.DataType):
    small = np.uint16 if len(lexicon.number) < 65535 else np.uint32

    def block_of(block: int, ids: list, held: list[_Texts]) -> Iterator[pa.RecordBatch]:
        out = _Out(names)
        lengths = np.concatenate([t.lengths for t in held])
        own, rare, left, right, keys, log_class, within = (np.concatenate([getattr(t, x) for t in held]) for x in ("own", "rare", "left", "right", "keys", "log_class", "within"))
        rows = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
        counts = keys % np.uint64(contexts) == 0 if contexts else np.zeros(len(keys), bool)
        # what is sent is rounded here already, so that gains are those of the same log p
        log_p = np.where(rare, log_class + within, log_class)
        log_p[counts] = np.rint(log_p[counts] * PARTS) / PARTS
        parts, log_p = log_p, np.where(rare, log_p, log_p + within)
        total = np.bincount(rows, log_p, len(lengths))
        yield out.row(_home(block, buckets), block, ROWS, pack(lengths.astype(np.uint64), total.view(np.uint64), np.bincount(rows[counts], minlength=len(lengths)).astype(np.uint64)), pa.concat_arrays(ids))
        # places that were counted ahead are settled here
        often, sent, to = _counted(known, keys), counts, keys
        if often.any():
            place = place_keys(keys, own)
            m = _counted(known, place)
            done = np.flatnonzero(counts & (often > 0) & (m > 0) & ~rare)
            yield out.gains(block, buckets, rows[done], _gain(log_p[done], m[done] - 1.0, often[done] - 1.0), m[done] > 1)
            sent = counts.copy()
            sent[done] = False
            to = np.where(often > 0, place, keys)
        to = _bucket(to, buckets)
        at = np.flatnonzero(sent)
        at = at[np.argsort(to[at], kind="stable")]
        starts = _runs(to[at])
        for a, b in zip(starts, [*starts[1:], len(at)]):
            i = at[a:b]
            # neighbours as two numbers of words, or as their key
            named = (left[i] < EDGE) & (right[i] < EDGE)
            j, r = i[named], rare[i]
            runs = _runs(rows[i])
            packed = pack(_steps(rows[i][runs]), np.diff(np.append(runs, len(i))).astype(np.uint32), np.packbits(named), left[j].astype(small), right[j].astype(small), keys[i[~named]], np.packbits(r), own[i[~r]].astype(small), own[i[r]], *_log_packed(parts[i]))
            yield out.row(int(to[i[0]]), block, PLACES, packed)
        yield from _asking(out, buckets, np.flatnonzero(rare & ~counts), own, log_p, rows, block)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held, places, many = TaskContext.get().partitionId() << 30, [], [], 0, 0
        for batch in batches:
            done = 0
            for texts in _slices(batch.column(1)):
                held.append(_Texts(lexicon, net, texts))
                ids.append(batch.column(0).slice(done, len(texts)))
                done, places, many = done + len(texts), places + len(held[-1].keys), many + len(texts)
                if places >= BLOCK or many >= MOST_ROWS:
                    yield from block_of(block, ids, held)
                    block, ids, held, places, many = block + 1, [], [], 0, 0
        if held:
            yield from block_of(block, ids, held)

    return score


def _asking(out: _Out, buckets: int, at: np.ndarray, own: np.ndarray, log_p: np.ndarray, rows: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Questions for the counts of the words at some places, without other places of their neighbours."""
    none = np.zeros(len(at), np.uint32)
    return _asked(out, buckets, own[at], log_p[at], none, none, np.full(len(at), block, np.uint64), rows[at])


def _asked(out: _Out, buckets: int, own: np.ndarray, log_p: np.ndarray, m: np.ndarray, n: np.ndarray, blocks: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    to = _bucket(own, buckets)
    order = np.argsort(to, kind="stable")
    starts = _runs(to[order])
    for a, b in zip(starts, [*starts[1:], len(order)]):
        i = order[a:b]
        at = _runs(blocks[i])
        names, which = blocks[i[at]], np.repeat(np.arange(len(at)), np.diff(np.append(at, len(i))))
        met = n[i] > 0
        data = pack(own[i], np.packbits(met), m[i[met]].astype(np.uint32), n[i[met]].astype(np.uint32), *_log_packed(log_p[i[met]]), names, _steps(which), _steps(rows[i]))
        yield out.row(int(to[i[0]]), -1, ASKED, data)


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)]


def _by_neighbours(lexicon: Lexicon, buckets: int, known: tuple[np.ndarray, np.ndarray], names: pa.DataType):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts the places of each bucket by neighbours, and by neighbours and word; other rows go on as they are."""
        out, parts = _Out(names), []
        for batch in batches:
            kinds = batch.column(2).to_numpy()
            if (rest := np.flatnonzero(kinds != PLACES)).size:
                yield batch.take(pa.array(rest))
            for k in np.flatnonzero(kinds == PLACES).tolist():
                rows, runs, bits, left, right, keys, rare_bits, own, others, low, high = unpack(batch.column(3)[k].as_py())
                size = len(low)
                named, rare = (np.unpackbits(x, count=size).view(bool) for x in (bits, rare_bits))
                key, word = np.empty(size, np.uint64), np.empty(size, np.uint64)
                key[named], key[~named] = mixed(mixed(left.astype(np.uint64)) + right), keys
                word[~rare], word[rare] = own, others
                block = np.full(size, batch.column(1)[k].as_py(), np.uint64)
                parts.append([key, word, _log_unpacked(low, high).astype(np.float32), block, np.repeat(np.cumsum(rows, dtype=np.uint32), runs)])
        if not parts:
            return
        key, word, log_p, block, row = _joined(parts)
        parts.clear()
        order = np.argsort(key)
        starts = _runs(key[order])
        n = np.empty(len(key), np.int64)
        n[order] = np.repeat(many := np.diff(np.append(starts, len(key))), many)
        often = _counted(known, key)
        n[often > 0] = often[often > 0]
        m = np.ones(len(key), np.int64)
        at = np.flatnonzero(n > 1)
        place = place_keys(key[at], word[at])
        order = np.argsort(place)
        many = np.diff(np.append(_runs(place[order]), len(at)))
        m[at[order]] = np.repeat(many, many)
        m, n, rare = m - 1, n - 1, word >= EDGE
        yield from _asked(out, buckets, word[rare], log_p[rare].astype(np.float64), m[rare], n[rare], block[rare], row[rare])
        at = np.flatnonzero(~rare & (n > 0))
        gain = _gain(log_p[at] + lexicon.within_at[word[at].astype(np.int64)], m[at], n[at])
        yield from _returned(out, buckets, block[at], row[at], gain, m[at] > 0)

    return meet


def _returned(out: _Out, buckets: int, block: np.ndarray, row: np.ndarray, gain: np.ndarray, recalled: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries of a block follow one another, their rows ascending."""
    starts = _runs(block)
    for a, b in zip(starts, [*starts[1:], len(block)]):
        yield out.gains(int(block[a]), buckets, row[a:b], gain[a:b], recalled[a:b])


def _counts_packed(buckets: int, names: pa.DataType):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(names)
        for batch in batches:
            own, n = _hashes(_bytes(batch.column(0).cast(pa.binary()))), batch.column(1).to_numpy()
            to = _bucket(own, buckets)
            order = np.argsort(to, kind="stable")
            starts = _runs(to[order])
            for a, b in zip(starts, [*starts[1:], len(order)]):
                i = order[a:b]
                yield out.row(int(to[i[0]]), -1, COUNTS, pack(own[i], n[i].astype(np.uint64)))

    return send


def _by_words(buckets: int, names: pa.DataType):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Gives places the counts of their words; those of words seen once, or never, have log 1."""
        out, parts, counts, number = _Out(names), [], [], {}
        for batch in batches:
            kinds = batch.column(2).to_numpy()
            if (rest := np.flatnonzero((kinds != ASKED) & (kinds != COUNTS))).size:
                yield batch.take(pa.array(rest))
            for k in np.flatnonzero(kinds == COUNTS).tolist():
                counts.append(unpack(batch.column(3)[k].as_py()))
            for k in np.flatnonzero(kinds == ASKED).tolist():
                own, bits, m, n, low, high, blocks, which, rows = unpack(batch.column(3)[k].as_py())
                met = np.unpackbits(bits, count=len(own)).view(bool)
                every = [np.zeros(len(own), x) for x in (np.uint32, np.uint32, np.float32)]
                every[0][met], every[1][met], every[2][met] = m, n, _log_unpacked(low, high)
                blocks = np.array([number.setdefault(b, len(number)) for b in blocks.tolist()], np.uint64)
                parts.append([own, *every, blocks[np.cumsum(which, dtype=np.uint32)] << np.uint64(32) | np.cumsum(rows, dtype=np.uint32)])
        if not parts:
            return
        own, m, n, log_p, at = _joined(parts)
        parts.clear()
        known = _joined(counts) if counts else [np.zeros(0, np.uint64)] * 2
        order = np.argsort(known[0])
        log_n = np.log(np.maximum(_counted((known[0][order], known[1][order].astype(np.int64)), own), 1))
        gain = np.rint(log_n * SCALE).astype(np.int64)
        met = n > 0
        gain[met] += _gain(log_p[met] + log_n[met], m[met].astype(np.float64), n[met].astype(np.float64))
        order = np.argsort(at)
        at = at[order]
        blocks = np.array(list(number), np.uint64)[at >> np.uint64(32)]
        yield from _returned(out, buckets, blocks, at.astype(np.uint32), gain[order], m[order] > 0)

    return meet


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block, whose rows of all kinds come one after another."""
    now, ids, base, gains = None, None, None, []

    def done() -> pa.RecordBatch:
        tokens, total, counted = base
        gain, recalled = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        for rows, g, r in gains:
            rows = np.cumsum(rows, dtype=np.uint32)
            gain[rows] += g.view(np.int64)
            recalled[rows] += r
        columns = [ids, *map(pa.array, (tokens.view(np.int64), total.view(np.float64) + gain / SCALE, counted.view(np.int64), recalled))]
        return pa.RecordBatch.from_arrays(columns, ["__id", "n_tokens", "log_prob", "n_contexts", "n_recalled"])

    for batch in batches:
        for k, (block, kind) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if block != now and now is not None:
                yield done()
                gains = []
            now = block
            data = unpack(batch.column(3)[k].as_py())
            if kind == ROWS:
                ids, base = batch.column(4)[k].values, data
            else:
                gains.append(data)
    if now is not None:
        yield done()


def _frequent(counts: DataFrame, n: int) -> DataFrame:
    """The n words of the greatest counts, ties by word. A histogram of counts by powers of two finds a floor that n words reach, so tasks
    together send the driver these and few more, however many they are."""
    bins = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("words")).collect()
    floor, reached = 0, 0
    for r in sorted(bins, key=lambda r: -r["b"]):
        floor, reached = r["b"], reached + r["words"]
        if reached >= n:
            break
    return counts.where(F.col("n") >= F.lit(1 << floor)).orderBy(F.desc("n"), "word").limit(n)


def fit(docs: DataFrame, text: str = "text", vocabulary: int = VOCABULARY, rate: float = 0.1) -> tuple[Lexicon, Network]:
    """Counts all words of docs and trains on all positions. Without words: a network of even odds."""
    texts = docs.select(F.col(text))
    counts = written(texts.mapInArrow(_count, "word binary, size int, n bigint").groupBy("word", "size").agg(F.sum("n").alias("n")), "word-counts")
    top = [(bytes(r["word"]), r["n"]) for r in _frequent(counts.where(F.col("size") <= LONG), vocabulary).collect()]
    bounds = F.when(F.col("size") <= 4, 0).when(F.col("size") <= 7, 1).when(F.col("size") <= 10, 2).when(F.col("size") <= 14, 3).when(F.col("size") <= LONG, 4).otherwise(5)
    whole = {r["c"]: (r["d"], r["s"]) for r in counts.groupBy(bounds.alias("c")).agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("s")).collect()}
    for w, n in top:
        d, s = whole[c := rare_class(len(w))]
        whole[c] = (d - 1, s - n)
    lexicon = Lexicon(top, whole, counts)
    net = Network(lexicon.prior)
    got = texts.mapInArrow(_trainer(lexicon, rate), "i int, v bigint, n bigint").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n")).collect()
    if got and got[0]["n"]:
        flat = np.zeros(len(got), np.float32)
        for r in got:
            flat[r["i"]] = float(r["v"]) / r["n"] / SCALE
        ends = np.cumsum([np.prod(s, dtype=int) for s in Network.SHAPES])[:-1]
        net.w = [p.reshape(s) for p, s in zip(np.split(flat, ends), Network.SHAPES)]
    return lexicon, net


def _often(texts: DataFrame, lexicon: Lexicon) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """About how many places texts have, and the counts of neighbours and places that would crowd a bucket: a sample names them, one more pass
    counts them. They only change where places meet, never what is counted."""
    rows = texts.where(F.monotonically_increasing_id() % SAMPLED == 0).mapInArrow(_sampler(lexicon), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    found = {r["key"]: r["n"] for r in rows.where((F.col("n") >= OFTEN // SAMPLED) | (F.col("key") == 0)).collect()}
    places = found.pop(0, 0) * SAMPLED
    keys = np.sort(np.array(list(found), np.int64).view(np.uint64))
    if not len(keys):
        return places, (keys, np.zeros(0, np.int64))
    counts = {r["key"]: r["n"] for r in texts.mapInArrow(_counter(lexicon, keys), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    return places, (keys, np.array([counts[k] for k in keys.view(np.int64).tolist()], np.int64))


def score(docs: DataFrame, lexicon: Lexicon, net: Network, text: str = "text", id_col: str = "doc_id", contexts: int = 0) -> DataFrame:
    """Per row of docs: id_col, n_tokens (words), log_prob (sum over its words, natural logarithm) and bits_a_token; with contexts (see
    above) also n_contexts, its places of counted neighbours, n_recalled, those of them that hold the same word elsewhere, and recalled, the
    one by the other (null where there are none).

    Null or empty texts have no tokens, log_prob 0 and null bits; repeated rows and null ids each keep a row, and a repeated row is another
    document to the first; texts of any length are scored whole; an empty table gives none. Words that fit() never saw count as seen once.
    Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    name = rows.schema["__id"].dataType
    names, kind = to_arrow_type(name), name.simpleString()
    places, known = _often(rows.select("__text"), lexicon) if contexts else (0, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-places // BUCKET))
    packed = f"to int, block bigint, kind int, data binary, ids array<{kind}>"
    out = rows.mapInArrow(_scorer(lexicon, net, contexts, buckets, known, names), packed).repartitionById(buckets, "to")
    out = out.mapInArrow(_by_neighbours(lexicon, buckets, known, names), packed)
    # words seen once add nothing, those of the vocabulary are at hand
    counts = lexicon.counts.where("n > 1").select("word", "n").mapInArrow(_counts_packed(buckets, names), packed)
    out = out.unionByName(counts).repartitionById(buckets, "to").mapInArrow(_by_words(buckets, names), packed)
    out = out.repartitionById(buckets, "to").sortWithinPartitions("block").mapInArrow(_sums, f"__id {kind}, n_tokens bigint, log_prob double, n_contexts bigint, n_recalled bigint")
    bits = F.when(F.col("n_tokens") > 0, -F.col("log_prob") / F.col("n_tokens") / F.log(F.lit(2.0)))
    found = ["n_contexts", "n_recalled", F.try_divide("n_recalled", "n_contexts").alias("recalled")] if contexts else []
    return out.select(F.col("__id").alias(id_col), "n_tokens", "log_prob", bits.alias("bits_a_token"), *found)

"""String similarity on a scale of 0 to 100, from the published descriptions of the measures: Indel ratio, token sets, partial windows
and their weighted combination; and the search of a list of references for the best of them, by upper bounds first.

Bounds: two strings have at most as many characters in common, in order, as their bags of characters share. From that number alone each
measure has an upper bound, which numpy takes for all references at once; only references whose bound reaches the best score
so far are measured. The result is that of measuring them all."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * LCS / (|a| + |b|); 100 for two empty strings."""
    n = len(a) + len(b)
    return 200.0 * _lcs(a, b) / n if n else 100.0


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def token_set_ratio(a: str, b: str) -> float:
    """100 if one side's words contain the other's (and share any); else the best of the common words against each side, and the two sides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    common = " ".join(both)
    left, right = " ".join([*both, *only_x]), " ".join([*both, *only_y])
    best = ratio(left, right)
    return max(best, ratio(common, left), ratio(common, right)) if both else best


def _best_window(s: str, l: str) -> float:  # noqa: E741
    return max(ratio(s, l[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(l)))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one, windows cut at its ends included; of both ways round if they are
    of one length."""
    s, l = (a, b) if len(a) <= len(b) else (b, a)  # noqa: E741
    if not s:
        return 100.0 if not l else 0.0
    return max(_best_window(s, l), _best_window(l, s)) if len(s) == len(l) else _best_window(s, l)


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted_ratio(a: str, b: str) -> float:
    """Whole strings while their lengths are within 1.5 of each other, else partial ones at 0.9 (0.6 beyond a factor of 8); token measures count 0.95."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.6 if longer > 8 else 0.9
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def _udf(measure):
    @F.pandas_udf(T.DoubleType())
    def scores(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else measure(x, y) for x, y in zip(a, b)], dtype="float64")

    return scores


token_set = _udf(token_set_ratio)
w_ratio = _udf(weighted_ratio)
plain_ratio = _udf(ratio)


COLUMNS = 64
#: Longest string that the parallel measure takes; longer ones are measured one by one.
LANE = 63
#: References whose windows are measured side by side.
STEP = 256


def _columns(text: str) -> np.ndarray:
    """How often each of COLUMNS kinds of characters occurs; characters that share a kind only loosen the bound."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % COLUMNS, minlength=COLUMNS).astype(np.int32)


class References:
    """A list of strings to search. Scores of 0 are never found."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        words = [set(t.split()) for t in texts]
        self.forms = {"plain": texts, "sorted": [_sorted(t) for t in texts], "set": [" ".join(sorted(w)) for w in words]}
        self.size = {k: np.array([len(t) for t in f], float) for k, f in self.forms.items()}
        self.bags = np.array([_columns(t) for t in texts], np.int32).reshape(len(texts), COLUMNS)
        holders: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            for x in w:
                holders.setdefault(x, []).append(i)
        self.holders = {x: np.array(i) for x, i in holders.items()}
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(texts))))}
        self.lanes = {k: self._lanes(f) for k, f in self.forms.items()}

    def _lanes(self, form: list[str]) -> np.ndarray:
        """Character codes, a column for a string; 0 fills up, and stands for all of a string that is too long."""
        out = np.zeros((max([len(t) for t in form if len(t) <= LANE], default=0), len(form)), np.int32)
        for i, t in enumerate(form):
            if len(t) <= LANE:
                out[: len(t), i] = [self.alphabet.get(c, 0) for c in t]
        return out

    def _common(self, text: str, form: str) -> np.ndarray:
        """Longest common subsequence with every string of a form, bit-parallel in text and side by side in the strings."""
        masks = np.zeros(len(self.alphabet) + 1, np.uint64)
        for i, c in enumerate(text):
            if c in self.alphabet:
                masks[self.alphabet[c]] |= np.uint64(1 << i)
        full = np.uint64((1 << len(text)) - 1)
        v = np.full(len(self.texts), full, np.uint64)
        for row in self.lanes[form]:
            u = v & masks.take(row)
            v = ((v + u) | (v - u)) & full
        return len(text) - np.bitwise_count(v).astype(float)

    def _ratio(self, text: str, form: str) -> np.ndarray:
        return 200 * self._common(text, form) / np.maximum(self.size[form] + len(text), 1)

    def bounds(self, text: str, measure) -> tuple[np.ndarray, np.ndarray]:
        """At least, and at most, the score of each reference under token_set_ratio or weighted_ratio."""
        n, words = len(self.texts), set(text.split())
        joined = " ".join(sorted(words))
        bag = np.minimum(self.bags, _columns(text)).sum(1).astype(float)
        part = lambda common: np.minimum(100.0, 200 * common / np.maximum(common + np.minimum(self.size["set"], len(joined)), 1e-9)) + 1e-6
        same, many = np.zeros(n), np.zeros(n)  # characters of common words, and how many these are
        for w in words:
            if w in self.holders:
                same[self.holders[w]] += len(w)
                many[self.holders[w]] += 1
        shared = many > 0
        same += np.maximum(many - 1, 0)
        # token sets: the common words against either side are known by their lengths, the two sides have no more in common than the bags
        sides = 200 * same / np.maximum(same + np.minimum(self.size["set"], len(joined)), 1e-9)
        sets = np.minimum(100.0, np.maximum(sides, 200 * bag / np.maximum(self.size["set"] + len(joined), 1e-9))) + 1e-6
        empty = (self.size["set"] == 0) | (not words)
        able = (self.size["plain"] <= LANE) & (len(text) <= LANE)
        if measure is token_set_ratio:
            low, high = np.maximum(sides - 1e-6, 0.0), sets
            if len(text) <= LANE:
                exact = self._ratio(joined, "set")
                low, high = np.where(able & ~shared, exact, low), np.where(able & ~shared, exact, high)
            return np.where(empty, 0.0, low), np.where(empty, 0.0, high)
        if measure is not weighted_ratio:
            return np.zeros(n), np.full(n, 100.0)
        longer = np.maximum(self.size["plain"], len(text)) / np.maximum(np.minimum(self.size["plain"], len(text)), 1e-9)
        scale = np.where(longer > 8, 0.6, 0.9)
        whole = longer < 1.5
        some = np.where(shared, 95.0, 0.0)
        low, high = np.zeros(n), np.maximum(200 * bag / np.maximum(self.size["plain"] + len(text), 1e-9) + 1e-6, np.where(whole, 0.95 * sets, scale * np.maximum(part(bag), some)))
        if len(text) <= LANE:
            common = self._common(text, "plain")
            plain = 200 * common / np.maximum(self.size["plain"] + len(text), 1)
            in_order = np.maximum(plain, 0.95 * self._ratio(_sorted(text), "sorted"))
            apart = np.maximum(in_order, 0.95 * self._ratio(joined, "set"))
            # a window has no more in common than the whole, sorted words no more than the bag
            window = np.where(shared, part(common), part(bag))
            at_least = np.where(whole, np.where(shared, np.maximum(in_order, 0.95 * sides - 1e-6), apart), np.maximum(plain, scale * some))
            at_most = np.where(whole, np.where(shared, np.maximum(in_order, 0.95 * sets), apart), np.maximum(at_least, scale * window))
            low, high = np.where(able, at_least, low), np.where(able, at_most, high)
        return np.where(self.size["plain"] == 0, 0.0, low), np.where(self.size["plain"] == 0, 0.0, high)

    def _windows(self, text: str, form: str, at: np.ndarray) -> np.ndarray:
        """partial_ratio of text with the strings of a form at these places, whose lengths differ from its own: every window is a lane."""
        n, size = len(text), self.size[form][at].astype(np.int64)
        masks = np.zeros(len(self.alphabet) + 1, np.uint64)
        for i, c in enumerate(text):
            if c in self.alphabet:
                masks[self.alphabet[c]] |= np.uint64(1 << i)
        short, long = np.minimum(size, n), np.maximum(size, n)
        many = short + long - 1
        which = np.repeat(np.arange(len(at)), many)
        begin = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + 1 - short[which]
        lo, hi = np.maximum(begin, 0), np.minimum(begin + short[which], long[which])
        inside = size[which] < n  # windows of text: bits lo to hi of it, against all of the string; else of the string, against all of text
        one = np.uint64(1)
        limit = np.where(inside, ((one << hi.astype(np.uint64)) - one) & ~((one << np.where(inside, lo, 0).astype(np.uint64)) - one), np.uint64((1 << n) - 1))
        first, last = np.where(inside, 0, lo), np.where(inside, size[which], hi)
        v, lanes, places = limit.copy(), self.lanes[form], at[which]
        for t in range(int((last - first).max(initial=0))):
            row = np.minimum(first + t, len(lanes) - 1)
            u = v & np.where(first + t < last, masks.take(lanes[row, places]), np.uint64(0))
            v = ((v + u) | (v - u)) & limit
        common = np.bitwise_count(limit).astype(float) - np.bitwise_count(v)
        out = np.zeros(len(at))
        np.maximum.at(out, which, 200 * common / np.maximum(short[which] + hi - lo, 1))
        return out

    def _partial(self, text: str, at: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The greater of partial_ratio and 0.95 * partial_token_ratio."""
        out = np.maximum(self._windows(text, "plain", at), np.where(shared, 95.0, 0.0))
        rest = np.flatnonzero(~shared)
        if len(rest):
            words = set(text.split())
            both = np.maximum(self._windows(_sorted(text), "sorted", at[rest]), self._windows(" ".join(sorted(words)), "set", at[rest]))
            out[rest] = np.maximum(out[rest], 0.95 * both)
        return out

    def _narrowed(self, text: str, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds under weighted_ratio with those settled that take windows and could be among the k best, STEP at a time."""
        words = set(text.split())
        longer = np.maximum(self.size["plain"], len(text)) / np.maximum(np.minimum(self.size["plain"], len(text)), 1e-9)
        forms = ((text, "plain"), (_sorted(text), "sorted"), (" ".join(sorted(words)), "set"))
        able = (longer >= 1.5) & (self.size["plain"] <= LANE) & (len(text) <= LANE) & np.all([self.size[f] != len(t) for t, f in forms], axis=0) & np.all([self.size[f] > 0 for _, f in forms], axis=0)
        if not words:
            return low, high
        open_ = np.flatnonzero(able & (high - low >= 1e-9))
        open_ = open_[np.argsort(-high[open_], kind="stable")]
        for a in range(0, len(open_), STEP):
            at = open_[a : a + STEP]
            floor = np.partition(low, -k)[-k] if len(low) >= k else 0.0
            at = at[high[at] >= floor - 1e-6]
            if not len(at):
                break
            shared = np.array([not words.isdisjoint(self.texts[i].split()) for i in at])
            low[at] = high[at] = np.maximum(low[at], np.where(longer[at] > 8, 0.6, 0.9) * self._partial(text, at, shared))
        return low, high

    def best(self, text: str, measure, k: int = 1, below: bool = False) -> list[tuple[float, int]]:
        """(score, place) of all references whose score is among the k best scores above 0, ties included; with below, of the best and of
        the next lower score too. Scores are rounded to nine places."""
        low, high = self.bounds(text, measure)
        if measure is weighted_ratio:
            low, high = self._narrowed(text, low, high, k + below)
        known, low, high = high - low < 1e-9, np.round(low, 9), high + 1e-8
        floor = max(0.0, float(np.partition(low, -k)[-k]) - 1e-6) if not below and len(low) >= k else 0.0
        found: list[tuple[float, int]] = []
        seen: list[float] = []  # scores found, ascending; without repeats where the next lower one is asked for
        for i in np.flatnonzero(high >= floor)[np.argsort(-high[high >= floor], kind="stable")].tolist():
            if high[i] < floor:
                break
            score = float(low[i]) if known[i] else round(measure(text, self.texts[i]), 9)
            if score > 0 and score >= floor:
                found.append((score, i))
                if not below or score not in seen:
                    bisect.insort(seen, score)
                    del seen[: -(k + below)]
                if len(seen) == k + below:
                    floor = max(floor, seen[0])
        return sorted((x for x in found if x[0] >= floor), key=lambda x: (-x[0], x[1]))

    def over(self, text: str, measure, threshold: float) -> Iterator[tuple[float, int]]:
        for i in np.flatnonzero(self.bounds(text, measure)[1] >= threshold - 1e-6).tolist():
            score = round(measure(text, self.texts[i]), 9)
            if score >= threshold:
                yield score, i

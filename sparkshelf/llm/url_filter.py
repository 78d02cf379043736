"""URL filters: explicit rules first, gradient-boosted trees on lexical features for the rest.

Host, path and rule are plain column expressions. The trees are fitted in numpy on a bounded, hashed sample of labelled
URLs (``max_labelled``), with histogram splits, each on a drawn half of the features, and go to the tasks as a few small arrays;
tasks score Arrow batches. Suffix statistics of a training URL come from other hosts than its own (out of fold)."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: verdict, host, path. A rule is written host + path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_RULES = 1_000
MAX_LABELLED = 20_000

#: Words whose presence as a part of a host name marks a labelled bad URL.
BAD_WORDS = ("spam", "adult", "casino", "pills", "bets", "bet", "ads", "adserver", "track", "tracker", "clicks", "poker", "viagra", "porn", "xxx", "warez", "phish", "malware")

FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "host_entropy", "parameters", "query_length",
    "hyphens", "dots", "longest_label", "fragment", "secure", "vowel_ratio", "last_suffix_odds", "two_suffix_odds",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, null if none; of equally long ones the longer host wins."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: judge() joins them")
    best = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    if not best:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    which = F
    for _, h, p in best:
        which = which.when(((host == h) | host.endswith("." + h)) & path.startswith(p), h + p)
    verdict = F
    for v, h, p in best:
        verdict = verdict.when(((host == h) | host.endswith("." + h)) & path.startswith(p), v)
    return which, verdict


def rules_joined(urls: DataFrame, rules: DataFrame, key: str = "key") -> DataFrame:
    """For rule tables of any size: (key, rule, rule_verdict) of the best rule of each row of urls (key, host, path) that has one.
    rules: verdict, host, path. Each host meets the rules of its own suffixes only, by an equality join."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    probe = urls.select(key, "path", F.explode(suffixes).alias("suffix"))
    r = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), F.col("verdict").alias("v"))
    met = probe.join(r, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    text = F.concat("suffix", "rule_path")
    best = met.groupBy(key).agg(F.max(F.struct(F.length(text).alias("n"), F.length("suffix").alias("h"), text.alias("rule"), F.col("v").alias("v"))).alias("b"))
    return best.select(key, F.col("b.rule").alias("rule"), F.col("b.v").alias("rule_verdict"))


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _split(url: str | None) -> tuple[str, str, str, str, str]:
    """Scheme, host in lower case without user and port, path, query with its ``?``, fragment with its ``#``."""
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)(#?.*)", url or "")
    scheme, host, *rest = m.groups() if m else ("", "", url or "", "", "")
    return scheme, re.sub(r":\d*$", "", host.rsplit("@", 1)[-1].lower()), *rest


def _suffixes(host: str) -> tuple[str, str]:
    """The last label, and the last two. (One label: the first of the two is empty.)"""
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]) if len(labels) > 1 else ""


def _odds(hosts: list[str], bad: np.ndarray) -> dict:
    """suffix -> log-odds of bad against the whole, drawn to it by 20 imaginary hosts. A host counts once, however many URLs it has."""
    of: dict = {}
    for host, b in zip(hosts, bad):
        n = of.setdefault(host, [0.0, 0])
        n[0] += b
        n[1] += 1
    counts: dict = {}
    for host, (b, n) in of.items():
        for suffix in {s for s in _suffixes(host) if s}:
            c = counts.setdefault(suffix, [0.0, 0.0])
            c[0] += b / n
            c[1] += 1
    share = (sum(b / n for b, n in of.values()) + 1) / (len(of) + 2)
    return {s: math.log((b + 20 * share) / (n - b + 20 * (1 - share))) - math.log(share / (1 - share)) for s, (b, n) in counts.items()}


def lexical(urls: list[str | None], odds: dict) -> np.ndarray:
    """One row of FEATURES for a URL. Null counts as empty."""
    out = np.zeros((len(urls), len(FEATURES)))
    for i, url in enumerate(urls):
        u = url or ""
        scheme, host, path, query, fragment = _split(url)
        labels = host.split(".")
        letters = sum(c.isalpha() for c in host)
        out[i] = (
            len(u), len(host), len(path), path.count("/"), len(labels), sum(c.isdigit() for c in u) / max(1, len(u)), _entropy(u), _entropy(host),
            query.count("=") + query.count("&"), len(query), host.count("-"), u.count("."), max(map(len, labels)), len(fragment) > 0, scheme.lower() == "https",
            sum(c in "aeiou" for c in host) / max(1, letters), *(odds.get(x, 0.0) for x in _suffixes(host)),
        )
    return out


@dataclass
class Boosted:
    """Trees as (feature, threshold, left, right, value) arrays; a leaf has feature -1."""

    base: float
    rate: float
    odds: dict
    trees: list = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, at, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                go = x[rows, np.maximum(feature[node], 0)] <= at[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += self.rate * value[node]
        return total

    def probability(self, urls: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(lexical(urls, self.odds)), -30, 30)))


def _tree(binned: np.ndarray, edges: list, grad: np.ndarray, hess: np.ndarray, depth: int, least: int, drawn: np.ndarray) -> tuple:
    """One regression tree on the gradient, by histogram splits on the drawn features; leaves are Newton steps."""
    feature, at, left, right, value = [], [], [], [], []

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(feature)
        g, h = grad[rows].sum(), hess[rows].sum()
        for a, v in ((feature, -1), (at, 0.0), (left, me), (right, me), (value, g / (h + 1.0))):
            a.append(v)
        if level == depth or len(rows) < 2 * least:
            return me
        best = (1e-6, -1, 0)
        for j in drawn:
            b, n = binned[rows, j], len(edges[j]) + 1
            cg, ch, cn = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = cg**2 / (ch + 1) + (g - cg) ** 2 / (h - ch + 1) - g**2 / (h + 1)
            gain[(cn < least) | (len(rows) - cn < least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        if best[1] >= 0:
            _, j, cut = best
            low = binned[rows, j] <= cut
            feature[me], at[me] = j, edges[j][cut]
            left[me] = grow(rows[low], level + 1)
            right[me] = grow(rows[~low], level + 1)
        return me

    grow(np.arange(len(grad)), 0)
    return np.array(feature), np.array(at), np.array(left), np.array(right), np.array(value)


FOLDS = 5


def fit(urls: list[str | None], bad: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5, bins: int = 32, seed: int = 5) -> Boosted:
    """Boosted trees for the log-odds of bad; each tree sees a drawn half of the features. Without labelled URLs, or with one class
    only, the model is a constant. Hosts are dealt to FOLDS; while training, the suffix odds of a URL come from the other folds."""
    y = np.asarray(bad, float)
    share = (y.sum() + 1) / (len(y) + 2)
    hosts = [_split(u)[1] for u in urls]
    model = Boosted(math.log(share / (1 - share)), rate, _odds(hosts, y))
    if not len(y) or y.min() == y.max():
        return model
    fold = np.array([zlib.crc32(h.encode("utf-8", "surrogatepass")) % FOLDS for h in hosts])
    x = np.zeros((len(y), len(FEATURES)))
    for k in range(FOLDS):
        own = np.flatnonzero(fold == k)
        others = np.flatnonzero(fold != k)
        x[own] = lexical([urls[i] for i in own], _odds([hosts[i] for i in others], y[others]))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    score, rng = np.full(len(y), model.base), np.random.default_rng(seed)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        drawn = np.sort(rng.permutation(x.shape[1])[: -(-x.shape[1] // 2)])
        tree = _tree(binned, edges, y - p, p * (1 - p), depth, least, drawn)
        model.trees.append(tree)
        score += Boosted(0.0, rate, {}, [tree]).raw(x)
    return model


def seed_label(host: Column) -> Column:
    """Weak label of a URL: 1 if a part of its host name is one of BAD_WORDS, else 0."""
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, BAD_WORDS))).cast("int")


def train(labelled: DataFrame, url: str = "url", bad: str = "bad", max_labelled: int = MAX_LABELLED) -> Boosted:
    """Fits on at most max_labelled distinct labelled URLs, those of the least hash; rows of null URL or label are left out, and of
    differing labels of one URL the greater holds. Equal URLs have equal hashes, so a tie is no tie of URLs.

    Distinct URLs are estimated first (a sketch, no shuffle) and rows are cut to a share of the hashes that leaves about twice the sample,
    before anything is shuffled; so neither the shuffle nor what tasks send the driver grows with the corpus."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(bad).isNotNull()).select(F.col(url).alias("u"), F.col(bad).cast("int").alias("b"))
    n = rows.agg(F.approx_count_distinct("u").alias("n")).first()["n"]
    if n > 4 * max_labelled:
        rows = rows.where(F.xxhash64("u") < F.lit(int(-(2**63) + 2 * max_labelled / n * 2**64)))
    got = rows.groupBy("u").agg(F.max("b").alias("b")).orderBy(F.xxhash64("u"), "u").limit(max_labelled).collect()
    return fit([r["u"] for r in got], np.array([r["b"] for r in got]))


def scorer(model: Boosted) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def p_bad(urls: pd.Series) -> pd.Series:
        return pd.Series(model.probability([None if u is None else str(u) for u in urls]))

    return p_bad


def judge(pages: DataFrame, model: Boosted, url: str = "url", id_col: str = "page_id", rules: tuple | DataFrame = RULES, threshold: float = 0.5) -> DataFrame:
    """Per row: id_col, host, path, rule (or null), verdict (allow or block) and p_bad. rules: a tuple, or a table (verdict, host, path) of
    any size; a tuple of more than MOST_RULES is made one.

    A null or empty URL has an empty host and path, fits no rule and is judged by the trees like any other; URLs of any length count
    whole; of rules that tie in length the longer host wins; repeated rows and null ids each keep a row; an empty table gives none.
    Other columns are not read."""
    each = pages.select(F.col(id_col).alias("__id"), F.col(url).alias("__url"))
    each = each.select("__id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), scorer(model)(F.col("__url")).alias("p_bad"))
    own = F.when(F.col("p_bad") >= threshold, "block").otherwise("allow")
    if isinstance(rules, tuple) and len(rules) <= MOST_RULES:
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return each.select(F.col("__id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "p_bad")
    if isinstance(rules, tuple):
        rules = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    places = each.select("host", "path").distinct().withColumn("key", F.struct("host", "path"))
    found = rules_joined(places, rules).withColumn("__key", F.col("key")).drop("key")
    out = each.join(found, F.struct("host", "path") == F.col("__key"), "left")
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "p_bad")

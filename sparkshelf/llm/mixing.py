"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the set of their sources); a flow network
routes word capacity from patterns to the quotas of sources, and each further copy of a pattern costs more than the one
before (convex repetition costs), so nothing repeats while fresh words would do. What the flow grants a pattern is then filled
with documents in a seeded hash order: whole copies of all, and a prefix of the order for the rest.

Only counted patterns and the few cut points of each reach the driver; documents never do. A cut point is found in two passes over
(pattern, hash, size): a histogram of hash ranges, then a running sum inside the one range where the cut falls. The answer is
a threshold on the hash, so documents are decided where they are, without a join or shuffle of their texts."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, fresh, written

LOW = -(2**63)
SEGMENT = "array<struct<level:int,lo:bigint,hi:bigint,source:string>>"


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple = (5, 2, 1), most: int = 3) -> dict:
    """Target words of each source: sources by code point, null last, get the weights in turn, and share the sum of all sizes;
    none above ``most`` times its size, what is over goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(patterns: list[tuple[tuple, int]], quotas: dict, most: int = 3) -> list[dict]:
    """Words that each pattern (its sources, its size) gives each source. Copy number k of a pattern costs k - 1 a word; among
    flows that fill the quotas as far as possible this finds one of least cost, by successive shortest paths."""
    names = list(quotas)
    end = 1 + len(patterns) + len(names)
    arcs: list[list] = []  # to, room, cost; the reverse arc is at index ^ 1
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    gives = []
    for p, (sources, size) in enumerate(patterns, 1):
        for k in range(most):
            arc(0, p, size, k)
        gives.append({s: arc(p, 1 + len(patterns) + names.index(s), most * size, 0) for s in sources})
    for q, s in enumerate(names):
        arc(1 + len(patterns) + q, end, quotas[s], 0)
    while True:
        cost, via, queue, waiting = {0: 0}, {}, deque([0]), {0}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for i in out[a]:
                b, room, c = arcs[i]
                if room > 0 and cost[a] + c < cost.get(b, 1 << 60):
                    cost[b], via[b] = cost[a] + c, i
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if end not in cost:
            return [{s: arcs[i ^ 1][1] for s, i in g.items() if arcs[i ^ 1][1]} for g in gives]
        path, at = [], end
        while at:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        room = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= room
            arcs[i ^ 1][1] += room


def _key(members: Column) -> Column:
    """A string for a set of sources, in which null differs from any string."""
    return F.array_join(F.array_sort(F.transform(F.array_distinct(members), lambda s: F.coalesce(F.hex(s), F.lit("~")))), ",")


def _cuts(facts: DataFrame, asked: list[tuple]) -> dict:
    """For (pattern key, words) the hash up to which, in hash order, documents hold no more than these words, and the words
    that they hold. facts: key, h, size."""
    if not asked:
        return {}
    spark = facts.sparkSession
    want = F.broadcast(spark.createDataFrame(sorted(asked), "key string, r bigint"))
    ranges = facts.groupBy("key", F.shiftright("h", 52).alias("b")).agg(F.sum("size").alias("s"))
    summed = ranges.withColumn("after", F.sum("s").over(Window.partitionBy("key").orderBy("b")))
    place = summed.join(want, "key").where("after - s <= r and r < after").select("key", "r", "b", (F.col("after") - F.col("s")).alias("before"))
    rows = place.collect()  # one for a cut
    found = {(p["key"], p["r"]): (max(LOW, (p["b"] << 52) - 1), p["before"]) for p in rows}
    if rows:
        spots = F.broadcast(spark.createDataFrame([tuple(p) for p in rows], "key string, r bigint, b bigint, before bigint"))
        inside = facts.withColumn("b", F.shiftright("h", 52).cast("bigint")).join(spots, ["key", "b"]).groupBy("key", "r", "b", "before", "h").agg(F.sum("size").alias("s"))
        inside = inside.withColumn("sum", F.col("before") + F.sum("s").over(Window.partitionBy("key", "r", "b").orderBy("h")))
        for c in inside.where("sum <= r").groupBy("key", "r").agg(F.max("h").alias("h"), F.max("sum").alias("sum")).collect():
            found[c["key"], c["r"]] = (c["h"], c["sum"])
    return found


def mix_plan(facts: DataFrame, weights: tuple = (5, 2, 1), most: int = 3, most_patterns: int = 10_000, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """facts: members (array of sources), key, h, size. Returns (key, segs), the copies that each pattern's documents give, as
    hash intervals (lo, hi]; and (source, source_size, target)."""
    spark = facts.sparkSession
    counted = facts.groupBy("key").agg(F.first("members").alias("members"), F.sum("size").alias("size")).limit(most_patterns + 1).collect()
    if len(counted) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    counted.sort(key=lambda r: r["key"])
    sizes: dict = {}
    for r in counted:
        for s in set(r["members"]):
            sizes[s] = sizes.get(s, 0) + r["size"]
    total = sum(r["size"] for r in counted)
    goal = targets(sizes, weights, most) if sum(sizes.values()) == total else _scaled(sizes, total, weights, most)
    patterns = [(tuple(sorted(set(r["members"]), key=lambda s: (s is None, s or ""))), r["size"]) for r in counted]
    flow = min_cost_flow(patterns, {s: round(t) for s, t in goal.items()}, most)
    # the copies of a pattern lie on a line, level after level in hash order; sources take stretches of it
    stretches, asked = [], set()
    for r, gives in zip(counted, flow):
        at = 0
        for s, n in gives.items():
            stretches.append((r["key"], r["size"], at, at + n, s))
            asked |= {(r["key"], x % r["size"]) for x in (at, at + n) if x % r["size"]}
            at += n
    cut = _cuts(facts, list(asked))
    segs: dict[str, list] = {r["key"]: [] for r in counted}
    gaps: dict[str, tuple] = {}
    extra: dict[str, list] = {r["key"]: [] for r in counted}
    for key, size, a, b, s in stretches:
        for level in range(a // size, -(-b // size)):
            lo = cut[key, a % size][0] if a > level * size else None
            hi = cut[key, b % size][0] if b < (level + 1) * size else None
            segs[key].append((level, lo, hi, s))
        gaps[key] = (b % size - cut[key, b % size][1], b // size, cut[key, b % size][0], s) if b % size else (0, 0, 0, s)
    for _ in range(rounds):  # the last gap of a pattern: the largest document not yet taken there that still fits
        open_ = [(k, g, past, extra[k]) for k, (g, _, past, _) in gaps.items() if g > 0]
        if not open_:
            break
        want = F.broadcast(spark.createDataFrame(open_, "key string, g bigint, past bigint, used array<bigint>"))
        fit = facts.groupBy("key", "h").agg(F.sum("size").alias("size")).join(want, "key").where("size <= g and size > 0 and h > past and not array_contains(used, h)")
        got = fit.groupBy("key").agg(F.max(F.struct("size", "h")).alias("best")).collect()
        if not got:
            break
        seen = set()
        for r in got:
            g, level, past, s = gaps[r["key"]]
            h = r["best"]["h"]
            segs[r["key"]].append((level, h - 1, h, s))
            extra[r["key"]].append(h)
            gaps[r["key"]] = (g - r["best"]["size"], level, past, s)
            seen.add(r["key"])
        gaps = {k: v for k, v in gaps.items() if k in seen}
    plan = spark.createDataFrame(list(segs.items()), f"key string, segs {SEGMENT}")
    shares = spark.createDataFrame([(s, int(n), float(goal[s])) for s, n in sizes.items()], "source string, source_size bigint, target double")
    return plan, shares


def _scaled(sizes: dict, total: int, weights: tuple, most: int) -> dict:
    """With overlaps the sources' sizes add up to more than the corpus: quotas share the corpus itself."""
    whole = targets(sizes, weights, most)
    f = total / max(1, sum(whole.values()))
    return {s: t * f for s, t in whole.items()}


def _parts() -> Column:
    return F.filter("segs", lambda x: (x["lo"].isNull() | (F.col("h") > x["lo"])) & (x["hi"].isNull() | (F.col("h") <= x["hi"])))


def _facts(docs: DataFrame, members: Column, text: str, id_col: str, seed: int) -> list[Column]:
    m = F.coalesce(members, F.array(F.lit(None).cast("string")))
    m = F.when(F.size(m) == 0, F.array(F.lit(None).cast("string"))).otherwise(m)
    return [m.alias("members"), _key(m).alias("key"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)).alias("h"), n_words(F.col(text)).alias("size")]


def mix(docs: DataFrame, members: Column, text: str = "text", id_col: str = "doc_id", weights: tuple = (5, 2, 1), most: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Per row of docs: id_col, members (its sources), size (words), parts (the copies it gives: level and source), copies and taken
    (copies times size); and the table of sources with size and target.

    Each source's taken words come within a document of its target where its documents allow. Null or empty texts have size
    0; a null or empty member list stands for the null source. Equal rows (id and text) share one fate. An empty table gives
    empty results. Reruns agree: the order is a seeded hash of id and text."""
    facts = written(docs.select(F.col(id_col), *_facts(docs, members, text, id_col, seed)), "mix-facts")
    plan, shares = mix_plan(facts, weights, most)
    out = facts.join(F.broadcast(plan), "key", "left").withColumn("parts", _parts()).withColumn("copies", F.size("parts"))
    return out.select(id_col, "members", "size", "parts", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")), shares


def mixed(docs: DataFrame, members: Column, text: str = "text", id_col: str = "doc_id", weights: tuple = (5, 2, 1), most: int = 3, seed: int = 7) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns."""
    facts = written(docs.select(*_facts(docs, members, text, id_col, seed)), "mix-facts")
    plan, _ = mix_plan(facts, weights, most)
    doc = fresh(docs, "doc")
    keyed = docs.select(F.struct(*docs.columns).alias(doc), *_facts(docs, members, text, id_col, seed)[1:3])
    keyed = keyed.join(F.broadcast(plan), "key").withColumn("parts", _parts())
    return keyed.where("size(parts) > 0").select(doc, F.explode("parts").alias("part")).select(f"{doc}.*")

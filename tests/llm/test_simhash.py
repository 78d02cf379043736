import random

import xxhash

from sparkshelf.llm import simhash as S


def brute_fp(text, size=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """id -> least id reachable over links of two bits or fewer."""
    ids = list(pairs)
    parent = {i: i for i in range(len(ids))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (ids[i][1] ^ ids[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(ids)), key=str)


def test_documents_match_brute_force(docs, none):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.simhash_groups(docs).collect()), key=str)
    assert got == brute_components([(r["doc_id"], brute_fp(r["text"])) for r in docs.collect()])
    assert S.simhash_groups(none).count() == 0 and S.keep_one(none).count() == 0


def planted(rng):
    """Fingerprints in clouds: chains and stars of one- and two-bit steps, dense and sparse."""
    out = []
    for _ in range(12):
        seed = at = rng.getrandbits(64)
        for _ in range(rng.choice([2, 5, 20])):
            base = rng.choice([seed, at])
            at = base
            for _ in range(rng.choice([1, 1, 2, 3])):
                at ^= 1 << rng.randrange(64)
            out.append(at)
    hub = rng.getrandbits(64)
    out += [hub ^ (1 << a) ^ (1 << b) for a in range(0, 20) for b in range(a)]
    return out + [rng.getrandbits(64) for _ in range(50)]


def test_links_connect_what_brute_force_connects(spark):
    for seed, hot in ((1, 48), (2, 3), (3, 10_000)):
        fps = planted(random.Random(seed))
        signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
        edges = [(r["src"], r["dst"]) for r in S.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), hot=hot).collect()]
        u = lambda x: x & (1 << 64) - 1
        assert all((u(a) ^ u(b)).bit_count() <= 2 for a, b in edges)
        parent = {f: f for f in signed}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            parent[find(a)] = find(b)
        for i, a in enumerate(signed):
            for b in signed[:i]:
                if (u(a) ^ u(b)).bit_count() <= 2:
                    assert find(a) == find(b)


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e", 1), (3, "A b c d e", 2), (9, "quite another text here", 3), (9, "quite another text here", 3), (None, "a b c d e", 4), (1, None, 5), (2, "", 6)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, gone int")
    assert sorted(map(tuple, S.keep_one(d).collect()), key=str) == sorted([rows[1], rows[2], rows[3], rows[4], rows[5]], key=str)


def test_an_unlike_text_under_a_shared_id_stays(spark):
    rows = [(3, "a b c d e", 1), (5, "a b c d e", 2), (5, "nothing like the others at all", 3), (5, "A B c d e", 4)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, gone_fp int")
    assert sorted(map(tuple, S.keep_one(d).collect())) == [rows[0], rows[2]]

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkshelf.functions import similarity as S
from sparkshelf.operators import resolution as B

TEXT = st.text(alphabet="abcd 12", max_size=14)


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 100), ("abc", "", 0), ("abc", "abc", 100), ("abcd", "abxd", 75), ("kitten", "sitting", 200 * 4 / 13)])
def test_ratio(a, b, want):
    assert S.ratio(a, b) == pytest.approx(want)


@pytest.mark.parametrize(("a", "b", "want"), [("b a", "a b c", 100), ("", "a", 0), ("x y", "z w", S.ratio("x y", "w z")), ("new york mets", "new york meats", 200 * 13 / 27)])
def test_token_set(a, b, want):
    assert S.token_set_ratio(a, b) == pytest.approx(want)


def plain_lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_measures(a, b):
    n = len(a) + len(b)
    assert S.ratio(a, b) == pytest.approx(200 * plain_lcs(a, b) / n if n else 100)
    for f in (S.ratio, S.token_set_ratio, S.token_sort_ratio, S.weighted_ratio, S.partial_ratio):
        assert 0 <= f(a, b) <= 100
        assert f(a, b) == pytest.approx(f(b, a))
    if a and b:
        short, long = sorted((a, b), key=len)
        every = lambda s, t: max(S.ratio(s, t[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(t)))
        want = max(every(a, b), every(b, a)) if len(a) == len(b) else every(short, long)
        assert S.partial_ratio(a, b) == pytest.approx(want)


#: Name -> canonical form, by hand.
NAMES = {
    "Intel\u00ae Core\u2122 Ultra 7 Processor 255H": "intel core ultra 7 255h", "Apple M5 (10-core)": "apple m5 10 core", "Apple M5 10 Core": "apple m5 10 core", "Apple M5 10-core GPU(20 core)": "apple m5 10 core gpu 20 core",
    "ARM Apple M6 12 Core 0 MHz": "apple m6 12 core", "ARM Apple M6": "apple m6", "Snapdragon X Elite X1E-78-100": "snapdragon x elite x1e78100", "X1E 78 100": "x1e78100", "x1e 78100 foo": "x1e78100 foo",
    "  AMD  Ryzen 7 ": "amd ryzen 7", "Athlon 64 X2 4200+": "athlon 64 x2 4200+", "Athlon X2 64 dual": "athlon x2 64 dual", "\ufb01ne \u00bd": "fine 1\u20442", "Core processor": "core", "(10 Core)": "10 core", "": "", None: None,
    "Apple M5 10 - Core GPU": "apple m5 10 core gpu", "M5 10 -Core": "m5 10 core", "M5 10\u2013 Core": "m5 10 core", "(10 - Core)": "10 core", "X1E - 78 - 100": "x1e78100", "X1E- 78 -100 x": "x1e78100 x", "Q X1 \u2013 26 \u2013 100": "q x126100",
    "Intel Processor, N100": "intel , n100", "Intel Processor-N100": "intel -n100", "coreprocessor 5": "coreprocessor 5", "foo 12 - 345": "foo 12 - 345", "a - core": "a - core",
}


def test_canonical_names(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = {r["n"]: r["k"] for r in rows.select("n", B.normal_name(rows.n).alias("k")).collect()}
    assert got == NAMES
    again = spark.createDataFrame([(k,) for k in got.values()], "n string")
    assert all(r["n"] == r["k"] for r in again.select("n", B.normal_name(again.n).alias("k")).collect() if r["n"] is not None)


WORDS = ["core", "ultra", "7", "9", "255h", "i7", "geforce", "rtx", "4050", "4060", "laptop", "gpu", "amd", "ryzen", "7840u", "(r)", "\u00e9", "x" * 70]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=6).map(" ".join), min_size=1, max_size=60), st.lists(st.sampled_from([*WORDS, "rtxx"]), max_size=5).map(" ".join), st.integers(1, 4))
def test_search_equals_measuring_all(refs, text, k):
    held = S.References(refs)
    for measure in (S.weighted_ratio, S.token_set_ratio):
        every = [round(measure(text, r), 9) for r in refs]
        low, high = held.bounds(text, measure)
        assert all(a - 1e-6 <= s <= b + 1e-6 for a, s, b in zip(low, every, high))
        least = sorted(every, reverse=True)[min(k, len(refs)) - 1]
        order = lambda keep: sorted(((s, i) for i, s in enumerate(every) if s > 0 and keep(s)), key=lambda x: (-x[0], x[1]))
        got = held.best(text, measure, k)
        assert [i for _, i in got] == [i for _, i in order(lambda s: s >= least - 1e-8)] or {i for _, i in got} == {i for _, i in order(lambda s: s >= least)}
        top = sorted(set(every), reverse=True)[:2]
        assert {i for _, i in held.best(text, measure, below=True)} == {i for _, i in order(lambda s: s >= top[-1])}
        assert {i for _, i in held.over(text, measure, 60)} == {i for _, i in order(lambda s: s >= 60)}


def test_what_the_matcher_weighed(spark):
    marks = spark.createDataFrame([("Intel Core i7-13700H", 26000), ("Intel Core i7-13620H", 24000), ("AMD Ryzen 7 7840U", 25000), ("Snapdragon X Elite - X1E-78-100", 20000), ("GeForce RTX 4050 Laptop GPU", 14000)], "name string, mark bigint")
    names = spark.createDataFrame([("Core i7 13700",), ("Snapdragon X1E 78 100",), ("Snapdragon X2P-64-100",), ("n/a",), (None,)], "cpu string")
    got = B.closest(names, "cpu", marks, k=2).collect()
    of = lambda n: sorted((r["place"], r["kind"], r["matched"], r["mark"], r["confidence"], r["message"]) for r in got if r["cpu"] == n)
    assert of("n/a") == [(None, "placeholder", None, None, None, "Placeholder, not a part name")] == of(None)
    assert of("Snapdragon X1E 78 100") == [(1, "qualcomm_part", "Snapdragon X Elite - X1E-78-100", 20000, 1.0, None)]
    assert [x[1] for x in of("Snapdragon X2P-64-100")] == ["qualcomm_part_missing"] * 2 and of("Snapdragon X2P-64-100")[0][5] == "Exact part number X2P64100: no row carries it"
    assert {x[2] for x in of("Core i7 13700")} == {"Intel Core i7-13700H", "Intel Core i7-13620H"} and {r["threshold"] for r in got} == {B.CPU_THRESHOLD}
    built_in = spark.createDataFrame([("ryzen 7 7840u", "AMD Radeon 780M")], "cpu string, gpu string")
    pairs = spark.createDataFrame([("NVIDIA GeForce RTX 4050", "x"), ("Intel Graphics", "Intel Core i3-N305"), ("Unknown", None)], "gpu string, cpu string")
    gpu = {r["gpu"]: r for r in B.closest_gpu(pairs, "gpu", "cpu", marks, built_in, k=1).collect()}
    assert (gpu["NVIDIA GeForce RTX 4050"]["matched"], gpu["NVIDIA GeForce RTX 4050"]["kind"]) == ("GeForce RTX 4050 Laptop GPU", "fuzzy")
    assert (gpu["Intel Graphics"]["kind"], gpu["Intel Graphics"]["message"]) == ("no_igpu_entry", "No integrated-GPU entry for CPU Intel Core i3-N305")
    assert gpu["Unknown"]["message"] == "No integrated-GPU entry for CPU unknown" and gpu["Unknown"]["threshold"] == B.GPU_THRESHOLD


def test_resolution_ladder(spark):
    marks = spark.createDataFrame([("GeForce RTX 4050 Laptop GPU", 14000), ("GeForce RTX 4050", 17000), ("GeForce RTX 5070 Ti Laptop GPU", 22000), ("Qualcomm Adreno X2-90 GPU", 6000), ("Radeon 610M", 1000), ("GeForce RTX 3050 4GB Laptop GPU", 9000)], "name string, mark bigint")
    built_in = spark.createDataFrame([("ryzen 7 7730u", "Radeon 610M"), ("7730u", "nothing")], "cpu string, gpu string")
    cases = {
        ("NVIDIA GeForce RTX 4050", "x"): (14000, "laptop_variant", False), ("GeForce RTX 4050 Laptop GPU", "x"): (14000, "direct", False), ("GeForce RTX 3050", "x"): (9000, "laptop_variant", False),
        ("GeForce RTX 5070", "x"): None, ("10-core GPU", "Apple M5"): (6000, "apple_equivalent", True), ("AMD Radeon Graphics", "AMD Ryzen 7 7730U"): (1000, "integrated", True),
        ("Unknown", "Mystery"): (None, "unresolved", True), (None, None): (None, "unresolved", True),
    }
    pairs = spark.createDataFrame(list(cases), "gpu string, cpu string")
    got = {(r["gpu"], r["cpu"]): (r["gpu_mark"], r["gpu_resolution"], r["gpu_is_proxy"]) for r in B.resolve_gpu(pairs, "gpu", "cpu", marks, built_in).collect()}
    for pair, want in cases.items():
        if want:
            assert got[pair] == want, pair
    assert got[("GeForce RTX 5070", "x")][1] != "laptop_variant"


def test_cpu_threshold_and_part_numbers(spark):
    marks = spark.createDataFrame([("Intel Core i7-13700H", 26000), ("Qualcomm Snapdragon X Elite - X1E-78-100 - Qualcomm Oryon", 20000)], "name string, mark bigint")
    names = spark.createDataFrame([("Core i7 13700H",), ("Snapdragon X1E78100",), ("n/a",), ("Celeron",), ("intel core i7-13700h",)], "cpu string")
    got = {r["cpu"]: (r["mark"], round(r["confidence"], 2)) for r in B.resolve(names, "cpu", marks).collect()}
    assert got["Snapdragon X1E78100"] == (20000, 1.0) and got["intel core i7-13700h"] == (26000, 1.0)
    assert got["n/a"] == (None, 0.0) and got["Celeron"][0] is None

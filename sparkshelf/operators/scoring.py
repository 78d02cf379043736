"""Multi-factor scores from catalog percentiles. All products, factors and profiles are scored in one pass of column expressions; the
distributions are value counts joined by value."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkshelf.operators.aggregates import exact_percentiles
from sparkshelf.operators.windows import dedup_first, range_of

FACTORS = ("price", "cpu", "gpu", "ram_storage", "portability", "battery", "screen_size", "brand")
#: General weights, use-case profiles, purpose and portability multipliers.
GENERAL = dict(zip(FACTORS, (8, 7, 6, 5, 4, 3, 2, 1)))
PROFILES = {
    "office_study": dict(zip(FACTORS, (9, 6, 2, 5, 7, 8, 2, 1))),
    "programming": dict(zip(FACTORS, (6, 9, 3, 9, 4, 6, 4, 1))),
    "gaming": dict(zip(FACTORS, (4, 8, 10, 7, 1, 1, 4, 1))),
    "creative_work": dict(zip(FACTORS, (3, 8, 9, 8, 3, 3, 5, 1))),
    "general_use": dict(zip(FACTORS, (9, 7, 2, 7, 6, 6, 4, 2))),
}
PURPOSES = {
    "Office/Study": {"price": 1.3, "battery": 1.2, "portability": 1.2, "cpu": 1.1},
    "Programming/Development": {"cpu": 1.3, "ram_storage": 1.3, "price": 1.1, "battery": 1.1},
    "Gaming": {"gpu": 1.3, "cpu": 1.2, "ram_storage": 1.1},
    "Creative Work": {"gpu": 1.3, "cpu": 1.2, "ram_storage": 1.2, "screen_size": 1.1},
    "General Use": {"price": 1.3, "cpu": 1.2, "ram_storage": 1.2, "portability": 1.1, "battery": 1.1},
}
CARRYING = {"Yes": 1.4, "Neutral": 1.0, "No": 0.5}
DECAY = 2
#: Columns that a distribution is built for: the scored column and what its values must satisfy.
MEASURED = {"price": "price > 0", "cpu_mark": None, "gpu_mark": None, "ram_gb": None, "storage_gb": None, "weight_kg": None, "battery_wh": None}


def purpose_label(purpose: str | None) -> str:
    """The canonical label, whatever the case and spacing; anything else is an error."""
    if purpose is not None:
        for label in PURPOSES:
            if " ".join(purpose.split()).casefold() == label.casefold():
                return label
    raise ValueError(f"unknown purpose {purpose!r}")


def weights(preference: Mapping | None = None, profile: Mapping | None = None) -> dict[str, float]:
    """Weights that add up to 1. preference: priorities, purpose (labels), portability; it wins over a profile."""
    if preference is None:
        raw = {f: float((profile or GENERAL).get(f, 1)) for f in FACTORS}
    else:
        boost = {f: min(1.3, max([1.0, *(PURPOSES.get(p, {}).get(f, 1.0) for p in preference.get("purpose") or ())])) for f in FACTORS}
        given = preference.get("portability") or "Neutral"
        carry = next((m for k, m in CARRYING.items() if given.startswith(k)), 1.0)
        raw = {f: float((preference.get("priorities") or {}).get(f, 1)) * boost[f] * (carry if f == "portability" else 1.0) for f in FACTORS}
    total = sum(raw.values())
    return {f: w / total for f, w in raw.items()}


def purpose_of(c: Column) -> Column:
    """The canonical label of a purpose column, whatever the case and spacing; null for anything else."""
    known = F.create_map(*[F.lit(x) for label in PURPOSES for x in (label.casefold(), label)])
    return F.try_element_at(known, F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))))


def weight_rows(preferences: DataFrame, key: str) -> DataFrame:
    """(key, factor, weight) of many preferences at once, as weights() gives them for one: priorities (map of factor to number; a missing one is 1), purpose
    (array of labels; unknown ones change nothing), portability (text that begins with an answer; else neutral). Null columns say nothing."""

    def asked(factor: str) -> Column:
        boosts = F.create_map(*[F.lit(x) for label, m in PURPOSES.items() for x in (label, m.get(factor, 1.0))])
        each = F.transform(F.coalesce("purpose", F.array().cast("array<string>")), lambda p: F.coalesce(F.try_element_at(boosts, p), F.lit(1.0)))
        return F.coalesce(F.array_max(each), F.lit(1.0))

    raw = []
    for f in FACTORS:
        boost = F.least(F.lit(1.3), F.greatest(F.lit(1.0), asked(f)))
        carry = F.lit(1.0)
        if f == "portability":
            for answer, m in reversed(CARRYING.items()):
                carry = F.when(F.col("portability").startswith(answer), F.lit(m)).otherwise(carry)
        given = F.coalesce(F.try_element_at("priorities", F.lit(f)).cast("double"), F.lit(1.0))
        raw.append(F.struct(F.lit(f).alias("factor"), (given * boost * carry).alias("w")))
    rows = preferences.select(F.col(key), F.array(*raw).alias("__r"))
    total = F.aggregate("__r", F.lit(0.0), lambda a, r: a + r["w"])
    return rows.withColumn("__t", total).select(key, F.explode("__r").alias("__e"), "__t").select(key, "__e.factor", (F.col("__e.w") / F.col("__t")).alias("weight"))


def percentile_map(distribution: DataFrame, probes: DataFrame, columns: Mapping[str, str | None]) -> DataFrame:
    """(factor, value, percentile) for every distinct value of the columns on either side: where it stands among the distribution's rows,
    halfway through equal ones. Probes need not be members. All columns share one pass: values are counted, dealt by range_of
    the value and summed within each range; the range totals, which do not grow with the rows, complete the running sums."""
    def long(df: DataFrame, conditions: bool, n: int) -> DataFrame:
        pairs = [F.when(F.expr(c) if c and conditions else F.lit(True), F.struct(F.lit(name).alias("factor"), F.col(name).cast("double").alias("value"))) for name, c in columns.items()]
        each = df.select(F.explode(F.array_compact(F.array(*pairs))).alias("x")).where("x.value is not null")
        return each.groupBy("x.factor", "x.value").agg((F.count(F.lit(1)) * n).alias("eq"))

    both = long(distribution, True, 1).union(long(probes, False, 0)).groupBy("factor", "value").agg(F.sum("eq").alias("eq"))
    parts = both.withColumn("p", range_of(F.col("value")))
    within = parts.withColumn("inside", F.sum("eq").over(Window.partitionBy("p", "factor").orderBy("value")))
    totals = parts.groupBy("factor", "p").agg(F.sum("eq").alias("t"))
    w = Window.partitionBy("factor").orderBy("p")
    before = totals.select("factor", "p", (F.sum("t").over(w) - F.col("t")).alias("before"), F.sum("t").over(Window.partitionBy("factor")).alias("n"))
    upto = F.col("inside") + F.col("before")
    pct = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (upto - F.col("eq") / 2.0) / F.col("n") * 100.0))
    return within.join(before, ["factor", "p"]).select("factor", "value", F.when(F.col("n") > 0, pct).otherwise(50.0).alias("percentile"))


def with_percentiles(products: DataFrame, catalog: DataFrame | None = None, columns: Mapping[str, str | None] = MEASURED, id_col: str = "id") -> DataFrame:
    """products (one row an id) with ``p_<column>`` for each measured column: its percentile among the catalog's active rows (all rows, if it
    has no status); 50 for null. Values meet their percentiles in long form, so one join serves all columns."""
    catalog = products if catalog is None else catalog
    if "status" in catalog.columns:
        catalog = catalog.where("status = 'active'")
    ranks = percentile_map(catalog, products, columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("value")) for c in columns])
    each = products.select(id_col, F.explode(pairs).alias("x")).select(id_col, "x.factor", "x.value").where("value is not null")
    met = each.join(ranks, ["factor", "value"]).groupBy(id_col).agg(*[F.max(F.when(F.col("factor") == c, F.col("percentile"))).alias(f"__{c}") for c in columns])
    out = products.join(met, id_col, "left")
    return out.withColumns({f"p_{c}": F.coalesce(f"__{c}", F.lit(50.0)) for c in columns}).drop(*[f"__{c}" for c in columns])


def _neutral(known: Column, score: Column) -> Column:
    return F.when(known, score).otherwise(50.0)


def price_score(preference: Mapping | None = None) -> Column:
    """Cheap is good; above a stated budget the score fades to 0 at half as much again; 50 for an unknown price (0)."""
    base = 100.0 - F.col("p_price")
    top = ((preference or {}).get("budget") or {}).get("max")
    if top is not None and float(top) > 0:
        over = (F.col("price") - float(top)) / float(top)
        base = F.when(over > 0, base * F.greatest(F.lit(0.0), 1.0 - DECAY * over)).otherwise(base)
    return F.when(F.coalesce("price", F.lit(0.0)) == 0, 50.0).otherwise(base)


def screen_score(preference: Mapping | None = None) -> Column:
    wanted = (preference or {}).get("screen_size") or []
    if not wanted:
        return F.lit(50.0)
    first = wanted[0].lower()
    goal = 0 if "13" in first or "14" in first else 1 if "15" in first or "16" in first else 2
    own = F.when(F.col("display_size") <= 14, 0).when(F.col("display_size") <= 16, 1).otherwise(2)
    return F.greatest(F.lit(0.0), 100.0 - F.abs(own - goal) * 40.0)


def brand_score(preference: Mapping | None = None) -> Column:
    liked = [b.lower() for b in (preference or {}).get("brand_preferences") or []]
    if not liked or "no preference" in liked:
        return F.lit(50.0)
    return F.when(F.lower("brand").isin(liked), 100.0).otherwise(50.0)


def factor_scores(preference: Mapping | None = None) -> dict[str, Column]:
    """The eight factor scores of a frame that with_percentiles made."""
    disk = F.when(F.coalesce(F.lower("storage_type").contains("hdd"), F.lit(False)), F.greatest(F.lit(0.0), F.col("p_storage_gb") - 15.0)).otherwise(F.col("p_storage_gb"))
    return {
        "price": price_score(preference),
        "cpu": _neutral(F.col("cpu_mark").isNotNull(), F.col("p_cpu_mark")),
        "gpu": _neutral(F.col("gpu_mark").isNotNull(), F.col("p_gpu_mark")),
        "ram_storage": F.col("p_ram_gb") * 0.6 + disk * 0.4,
        "portability": _neutral(F.col("weight_kg").isNotNull(), 100.0 - F.col("p_weight_kg")),
        "battery": F.col("p_battery_wh"),
        "screen_size": screen_score(preference),
        "brand": brand_score(preference),
    }


def notes(preference: Mapping | None = None) -> dict[str, Column]:
    """Why a factor is neutral or lowered; null where it is a plain measurement."""
    top = ((preference or {}).get("budget") or {}).get("max")
    price = F.when(F.coalesce("price", F.lit(0.0)) == 0, "price unknown, neutral")
    if top is not None and float(top) > 0:
        price = price.when(F.col("price") > float(top), F.format_string("%.0f%% over the budget of %.0f", (F.col("price") - float(top)) / float(top) * 100.0, F.lit(float(top))))
    none = F.lit(None).cast("string")
    gpu = F.when(F.col("gpu_mark").isNull(), "GPU not identified, neutral").when(F.col("gpu_is_proxy"), "mark of a stand-in part")
    return {
        "price": price, "cpu": F.when(F.col("cpu_mark").isNull(), "CPU not identified, neutral"), "gpu": gpu,
        "screen_size": none if (preference or {}).get("screen_size") else F.lit("no preference, neutral"), "brand": none if (preference or {}).get("brand_preferences") else F.lit("no preference, neutral"),
    }


def score(products: DataFrame, profiles: Mapping[str, Mapping] | None = None, preference: Mapping | None = None) -> DataFrame:
    """One row for each product and profile (or for the preference alone): score (null when neither benchmark is known), breakdown, flags.

    products: with_percentiles columns, id and gpu_is_proxy. Profiles are literals: rows multiply by their number without a join."""
    own = factor_scores(preference)
    why = notes(preference)
    none = F.lit(None).cast("string")
    vectors = {"personal": weights(preference)} if preference is not None else {n: weights(profile=p) for n, p in (profiles or {"general": GENERAL}).items()}
    withheld = F.col("cpu_mark").isNull() & F.col("gpu_mark").isNull()
    out = products.withColumns({f"s_{f}": c for f, c in own.items()})
    each = []
    for name, w in vectors.items():
        total = sum((F.col(f"s_{f}") * w[f] for f in FACTORS), F.lit(0.0))
        parts = F.array(*[F.struct(F.lit(f).alias("factor"), F.bround(F.col(f"s_{f}"), 2).alias("raw_score"), F.lit(round(w[f], 4)).alias("weight"), F.bround(F.col(f"s_{f}") * w[f], 2).alias("contribution"), why.get(f, none).alias("note")) for f in FACTORS])
        each.append(F.struct(F.lit(name).alias("use_case"), F.when(~withheld, F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total, 0))).cast("int")).alias("score"), parts.alias("breakdown")))
    flags = F.struct(
        (F.col("gpu_mark").isNull() | F.coalesce("gpu_is_proxy", F.lit(False))).alias("gpu_score_is_proxy"), F.col("gpu_mark").isNull().alias("gpu_benchmark_unresolved"),
        F.col("cpu_mark").isNull().alias("cpu_benchmark_unresolved"), (F.coalesce("price", F.lit(0.0)) == 0).alias("price_unavailable"), withheld.alias("score_withheld"),
    )
    return out.withColumn("flags", flags).withColumn("__e", F.explode(F.array(*each))).select(*products.columns, "flags", "__e.use_case", "__e.score", "__e.breakdown")


def ranking(scored: DataFrame, use_case: str, group: str, limit: int = 10) -> DataFrame:
    """The best scored products of a use case, one of each group; in gaming, stand-in marks come after measured ones."""
    rows = scored.where((F.col("use_case") == use_case) & F.col("score").isNotNull())
    late = F.col("flags.gpu_score_is_proxy") if use_case == "gaming" else F.lit(False)
    rows = rows.withColumn("__rank", F.struct(late.alias("late"), (-F.col("score")).alias("s"), F.col("price").alias("p"), F.col("id").alias("id")))
    return dedup_first(rows, group, "__rank").orderBy("__rank").limit(limit).drop("__rank")


def configured(products: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    """Products with some measured columns replaced, to be ranked against the unchanged catalog."""
    return products.withColumns(dict(changes))


def configured_scores(own: DataFrame, catalog: DataFrame, cpu: str = "cpu_model", gpu: str | None = None, profiles: Mapping[str, Mapping] | None = None) -> DataFrame:
    """(id, scores, reason) of configured machines measured against the catalog: the score of every profile by name, or, if neither processor nor
    graphics have a mark, none of them and why. Configured machines are no part of the distribution."""
    rows = score(with_percentiles(own, catalog), profiles or PROFILES)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in (cpu, gpu) if c is not None]
    reason = F.concat(F.lit("no benchmark for "), F.concat_ws(" or ", *named), F.lit(": no score rather than an invented one"))
    held = F.map_from_entries(F.sort_array(F.collect_list(F.struct("use_case", "score"))))
    why = F.max(F.when(F.col("flags.score_withheld"), reason))
    return rows.groupBy("id").agg(held.alias("scores"), why.alias("reason")).select("id", F.when(F.col("reason").isNull(), F.col("scores")).alias("scores"), "reason")


def curves(df: DataFrame, column: str) -> DataFrame:
    """The column under other normalisations: min-max, clamped to the 5th and 95th percentile, and logarithmic."""
    lo, p5, p95, hi = exact_percentiles(df, column, (0.0, 0.05, 0.95, 1.0))
    x, span = F.col(column), lambda v, a, b: F.when(F.lit(b) > F.lit(a), (v - F.lit(a)) / F.lit(b - a) * 100.0).otherwise(50.0)
    if lo is None:
        return df.withColumns({c: F.lit(None).cast("double") for c in ("minmax", "clamped", "logged")})
    clamp = F.greatest(F.lit(p5), F.least(F.lit(p95), x))
    return df.withColumns({"minmax": span(x, lo, hi), "clamped": span(clamp, p5, p95), "logged": span(F.log1p(x - F.lit(lo)), 0.0, math.log1p(hi - lo))})


def use_case_order(use_cases: Sequence[str] = tuple(PROFILES)) -> list[str]:
    return list(use_cases)

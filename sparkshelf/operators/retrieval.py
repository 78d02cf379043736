"""Recall, reranking, relaxation and gating of vector search results; every step is a column expression over candidate rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkshelf.functions.vectors import knn
from sparkshelf.operators.windows import dedup_closest, dedup_first

#: Calibrated limits and CPU words of purposes.
RECALL, FALLBACK_SIMILARITY, VIABLE, GATE = 50, 0.58, 0.33, 0.53
WEIGHT_STEP, WEIGHT_STEPS, BUDGET_STEP, BUDGET_STEPS = 0.2, 2, 500.0, 3
CPU_WORDS = {"Programming/Development": ("i5", "i7", "i9", "ryzen 5", "ryzen 7", "ryzen 9", "m3", "m4"), "Office/Study": ("i5", "i7", "ryzen 5", "ryzen 7")}


@dataclass(frozen=True)
class Constraints:
    budget: float | None = None
    weight_limit: float | None = None
    purpose: tuple[str, ...] | Column = ()
    brands: tuple[str, ...] | Column = field(default=())


def recall(products: DataFrame, query: list[float], budget: float | None = None, vector: str = "embedding", k: int = RECALL) -> DataFrame:
    """The k nearest active products within the budget, with their similarity."""
    if "status" in products.columns:
        products = products.where("status = 'active'")
    if budget is not None:
        products = products.where(F.col("price") <= budget)
    return knn(products, vector, query, k, "id").withColumn("similarity", F.round(1 - F.col("distance"), 4)).drop("distance")


def fallback(products: DataFrame, c: Constraints, k: int = RECALL) -> DataFrame:
    """Without a query vector: plain filters, cheapest first, one constant similarity."""
    rows = products.where("status = 'active'") if "status" in products.columns else products
    if c.budget is not None:
        rows = rows.where(F.col("price") <= c.budget)
    if c.weight_limit is not None:
        rows = rows.where(F.col("weight_kg") <= c.weight_limit)
    if c.brands:
        rows = rows.where(F.lower("brand") == c.brands[0].lower())
    return rows.orderBy("price", "id").limit(k).withColumn("similarity", F.lit(FALLBACK_SIMILARITY))


def budget_penalty(price: Column, budget: float | Column | None) -> Column:
    if budget is None:
        return F.lit(1.0)
    b = budget if isinstance(budget, Column) else F.lit(float(budget))
    over = (price - b) / b
    soft, medium = F.greatest(F.lit(0.5), 1 - over * 2), F.greatest(F.lit(0.3), 1 - over * 1.5)
    return F.when(b.isNull() | (price <= b), 1.0).when(over <= 0.10, soft).when(over <= 0.30, medium).otherwise(0.1)


def weight_penalty(weight: Column, limit: float | Column | None) -> Column:
    if limit is None:
        return F.lit(1.0)
    m = limit if isinstance(limit, Column) else F.lit(float(limit))
    return F.when(m.isNull() | weight.isNull() | (weight <= m), 1.0).when((weight - m) / m <= 0.20, 0.7).otherwise(0.2)


def purpose_bonus(cpu: Column, purpose: tuple[str, ...] | Column) -> Column:
    """0.04 for each purpose of which the CPU name holds a word, 0.08 at most. Purposes may also be an array column."""
    asked = lambda p: F.coalesce(F.array_contains(purpose, p), F.lit(False)) if isinstance(purpose, Column) else F.lit(p in purpose)
    holds = lambda p: F.coalesce(F.lower(cpu), F.lit("")).rlike("|".join(w.replace(".", r"\.") for w in CPU_WORDS[p]))
    hits = [F.when(asked(p) & holds(p), 0.04).otherwise(0.0) for p in CPU_WORDS]
    return F.least(F.lit(0.08), sum(hits, F.lit(0.0)))


def brand_bonus(brand: Column, brands: tuple[str, ...] | Column) -> Column:
    if isinstance(brands, Column):
        open_ = brands.isNull() | (F.size(brands) == 0) | F.array_contains(brands, "no preference")
        return F.when(open_, 0.0).when(F.array_contains(brands, F.lower(brand)), 0.05).otherwise(-0.25)
    if not brands or "no preference" in brands:
        return F.lit(0.0)
    return F.when(F.lower(brand).isin(*brands), 0.05).otherwise(-0.25)


def rerank(rows: DataFrame, c: Constraints, budget: Column | None = None, weight_limit: Column | None = None) -> DataFrame:
    """rows with penalty, bonus, final and reasons. A weight limit drops rows of unknown weight. Limits may also be columns of rows."""
    b = budget if budget is not None else c.budget
    w = weight_limit if weight_limit is not None else c.weight_limit
    if w is not None:
        known = F.col("weight_kg").isNotNull()
        rows = rows.where(known | w.isNull() if isinstance(w, Column) else known)
    on_price, on_weight = budget_penalty(F.col("price"), b), weight_penalty(F.col("weight_kg"), w)
    reasons = F.array_compact(F.array(F.when(on_price < 1, F.lit("over budget")), F.when(on_weight < 1, F.lit("over weight"))))
    out = rows.withColumn("penalty", on_price * on_weight).withColumn("bonus", purpose_bonus(F.col("cpu_model"), c.purpose) + brand_bonus(F.col("brand"), c.brands))
    return out.withColumn("final", F.round(F.col("similarity") * F.col("penalty") + F.col("bonus"), 4)).withColumn("reasons", reasons)


def ordered(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy(F.desc("final"), "id")


def ladder(c: Constraints) -> list[tuple[int, str | None, Constraints]]:
    """Step 0 is the constraints as given; then each weight limit, then each budget, one dimension at a time from its original value."""
    steps: list[tuple[int, str | None, Constraints]] = [(0, None, c)]
    if c.weight_limit is not None:
        steps += [(len(steps) + n - 1, "weight_limit", replace(c, weight_limit=c.weight_limit + WEIGHT_STEP * n)) for n in range(1, WEIGHT_STEPS + 1)]
    at = len(steps)
    if c.budget is not None:
        steps += [(at + n - 1, "budget", replace(c, budget=c.budget + BUDGET_STEP * n)) for n in range(1, BUDGET_STEPS + 1)]
    return steps


def relaxed(products: DataFrame, query: list[float], c: Constraints, k: int = RECALL) -> DataFrame:
    """Ranked rows of the first step of the ladder with a viable row (of step 0, if none has any), with step and relaxed field.

    One job for the whole ladder: rows within the widest budget are scored once, each step recalls its k nearest among those
    within its own budget, and the steps are compared by their best row. A step of a weight limit keeps the original budget."""
    from sparkshelf.functions.vectors import cosine_distance

    steps = ladder(c)
    rows = products.where("status = 'active'") if "status" in products.columns else products
    widest = max((s.budget for _, _, s in steps if s.budget is not None), default=None)
    if widest is not None:
        rows = rows.where(F.col("price") <= widest)
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = rows.withColumn("distance", cosine_distance(F.col("embedding"), q)).where("distance is not null")
    opts = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(f).cast("string").alias("field"), F.lit(s.budget).cast("double").alias("step_budget"), F.lit(s.weight_limit).cast("double").alias("step_weight")) for i, f, s in steps])
    each = rows.withColumn("__s", F.explode(opts)).select(*rows.columns, "__s.*").where(F.col("step_budget").isNull() | (F.col("price") <= F.col("step_budget")))
    w = Window.partitionBy("step").orderBy("distance", "id")
    near = each.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).withColumn("similarity", F.round(1 - F.col("distance"), 4)).drop("__n", "distance")
    ranked = rerank(near, c, F.col("step_budget"), F.col("step_weight"))
    first = ranked.where(F.col("final") >= VIABLE).agg(F.coalesce(F.min("step"), F.lit(0)).alias("__first"))
    return ranked.join(F.broadcast(first), F.col("step") == F.col("__first")).drop("__first")


def bottleneck(ranked: DataFrame, top: int = 10) -> DataFrame:
    """(bottleneck): the reason that occurs most among the first rows; budget on a tie, general if there is none."""
    head = ordered(ranked).limit(top)
    n = head.agg(F.coalesce(F.sum(F.array_contains("reasons", "over budget").cast("int")), F.lit(0)).alias("b"), F.coalesce(F.sum(F.array_contains("reasons", "over weight").cast("int")), F.lit(0)).alias("w"))
    return n.select(F.when((F.col("b") == 0) & (F.col("w") == 0), "general").when(F.col("b") >= F.col("w"), "budget").otherwise("weight_limit").alias("bottleneck"))


def gate(ranked: DataFrame) -> DataFrame:
    """(status, top_score, bottleneck): gated if there is no row or the best one is below the gate."""
    top = ranked.agg(F.max("final").alias("top_score")).withColumn("status", F.when(F.col("top_score") >= GATE, "pass").otherwise("gated"))
    return top.join(bottleneck(ranked)).select("status", "top_score", F.when(F.col("status") == "gated", F.col("bottleneck")).alias("bottleneck"))


def shortlist(ranked: DataFrame, c: Constraints, group: str = "family", k: int = 6) -> DataFrame:
    """One row of each group, at most k: with a budget the member closest to it at the group's first place, else the first member."""
    rows = ranked.withColumn("__rank", F.struct((-F.col("final")).alias("f"), F.col("id").alias("id")))
    if c.budget is None:
        return dedup_first(rows, group, "__rank").orderBy("__rank").limit(min(k, 6)).drop("__rank")
    return dedup_closest(rows, group, "__rank", "price", c.budget).orderBy("place").limit(min(k, 6)).drop("__rank", "place")


def search(products: DataFrame, query: list[float], c: Constraints, group: str = "family", k: int = 6) -> DataFrame:
    """Recall, rerank, relax, gate and shortlist of one query, in order; no rows if gated. Members are chosen by the budget in force, the relaxed one if it was
    raised. operators/search.py does this for any number of queries in one plan."""
    from sparkshelf.operators.search import shortlists

    ranked = relaxed(products, query, c)
    open_ = ranked.agg(F.max("final").alias("__top")).where(F.col("__top") >= GATE)
    rows = ranked.join(F.broadcast(open_)).drop("__top").withColumn("case", F.lit(0))
    return shortlists(rows, group, min(k, 6)).orderBy("place").drop("case", "place")

"""Catalog lifecycle and review operators: groups, price lists, configurator quotes, links, claims, funnels, jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def resolve_family(df: DataFrame, key: str, family: str) -> DataFrame:
    """df with ``resolved``: its own family, else the only family among assigned rows of its key, else null."""
    known = df.where(F.col(family).isNotNull()).groupBy(key).agg(F.count_distinct(family).alias("__n"), F.min(family).alias("__f")).where("__n = 1")
    return df.join(known.select(key, "__f"), key, "left").withColumn("resolved", F.coalesce(family, "__f")).drop("__f")


def regroup(df: DataFrame, key: str, family: str, brand: str) -> DataFrame:
    """(rows, ``assigned``, ``action``): unassigned rows join the only family of their key, stay where there are several, or found a new one
    whose id follows from brand and key."""
    known = df.where(F.col(family).isNotNull()).groupBy(key).agg(F.count_distinct(family).alias("__n"), F.min(family).alias("__f"))
    out = df.join(known, key, "left")
    n = F.coalesce("__n", F.lit(0))
    new = F.left(F.sha2(F.concat_ws("|", brand, key), 256), F.lit(16))
    action = F.when(F.col(family).isNotNull(), "kept").when(n > 1, "ambiguous").when(n == 1, "joined").otherwise("created")
    assigned = F.when(F.col(family).isNotNull(), F.col(family)).when(n > 1, None).when(n == 1, F.col("__f")).otherwise(new)
    return out.withColumn("assigned", assigned).withColumn("action", action).drop("__n", "__f")


def bulk_move(df: DataFrame, id_col: str, family: str, moved: DataFrame, target) -> tuple[DataFrame, DataFrame]:
    """(df after the move, counts): ids of moved go to target. If any id is unknown, nothing moves and the counts say so."""
    unknown = moved.select(id_col).distinct().join(df.select(id_col), id_col, "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    m = moved.select(id_col).distinct().withColumn("__m", F.lit(True))
    j = df.join(m, id_col, "left").join(F.broadcast(unknown))
    go = F.col("__m").isNotNull() & (F.col("unknown") == 0)
    after = j.withColumn("__new", F.when(go, F.lit(target)).otherwise(F.col(family)))
    sizes = after.groupBy(F.col(family).alias("f")).agg(F.count_if(~F.col("__new").eqNullSafe(F.col(family))).alias("left"), F.count(F.lit(1)).alias("n"), F.count_if(go & ~F.col("__new").eqNullSafe(F.col(family))).alias("moved"), F.count_if(go & F.col("__new").eqNullSafe(F.col(family))).alias("unchanged"))
    counts = sizes.agg(F.sum("moved").alias("moved"), F.sum("unchanged").alias("unchanged"), F.count_if(F.col("f").isNotNull() & (F.col("left") == F.col("n"))).alias("emptied")).join(unknown)
    return after.withColumn(family, F.col("__new")).drop("__m", "__new", "unknown"), counts


def go_live(df: DataFrame, failures: Column, held: Column) -> DataFrame:
    """Held, inactive rows become active if nothing fails; others stay, with their failures."""
    mine = held & (F.col("status") == "inactive")
    out = df.withColumn("failures", F.when(mine, failures))
    return out.withColumn("status", F.when(mine & (F.size("failures") == 0), "active").otherwise(F.col("status")))


def guide_decision(stored: Column, listed: Column, last_source: Column) -> Column:
    """What to do with a list price: fill an unknown one, confirm an equal one, replace one that also came from a list; else report it."""
    return F.when(F.coalesce(stored, F.lit(0.0)) == 0, "fill").when(stored == listed, "confirm").when(last_source == "guide", "fill").otherwise("differs")


def guide_match(guide: DataFrame, catalog: DataFrame) -> DataFrame:
    """guide rows (guide_id, sku, spec, price) with ``outcome``, ``id`` and how they matched. By SKU key first (several rows may match), else by
    spec. matched: one row; ambiguous: several by spec; conflict: a SKU match whose spec differs; unpriced: no price; else unmatched."""
    sku = lambda c: F.regexp_replace(F.upper(F.trim(c)), "WP$", "W")
    g = guide.withColumn("__k", sku("sku"))
    c = catalog.select("id", sku("sku").alias("__k"), F.col("spec").alias("__spec"))
    by_sku = g.join(c.where("__k <> ''"), "__k").select(*guide.columns, "id", "__spec", F.lit("sku").alias("how"))
    rest = g.join(by_sku.select("guide_id"), "guide_id", "left_anti")
    by_spec = rest.join(c.drop("__k").where("__spec <> ''"), F.col("spec") == F.col("__spec")).select(*guide.columns, "id", "__spec", F.lit("spec").alias("how"))
    met = by_sku.unionByName(by_spec).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("guide_id")))
    out = g.select(*guide.columns).join(met.select("guide_id", "id", "__spec", "how", "__n"), "guide_id", "left")
    outcome = F.when(F.col("id").isNull(), "unmatched").when(F.col("price").isNull(), "unpriced").when((F.col("how") == "spec") & (F.col("__n") > 1), "ambiguous").when((F.col("how") == "sku") & (F.col("spec") != F.col("__spec")), "conflict").otherwise("matched")
    return out.withColumn("outcome", outcome).drop("__spec", "__n")


def uncovered(catalog: DataFrame, matched: DataFrame) -> DataFrame:
    """Catalog rows that no guide row matched."""
    return catalog.join(matched.where("outcome = 'matched'").select("id"), "id", "left_anti")


def guide_apply(preview: DataFrame) -> DataFrame:
    """The writes of a preview (outcome, decision, price, listed, checked_at, guide_at): fills of matched rows, and confirmations of rows last
    checked before the guide."""
    ok = F.col("outcome") == "matched"
    confirm = (F.col("decision") == "confirm") & (F.col("checked_at").isNull() | (F.col("checked_at") < F.col("guide_at")))
    return preview.where(ok & ((F.col("decision") == "fill") | confirm)).withColumn("price", F.when(F.col("decision") == "fill", F.col("listed")).otherwise(F.col("price"))).withColumn("checked_at", F.col("guide_at"))


def reviewed(preview: DataFrame, decisions: DataFrame) -> DataFrame:
    """preview with ``is_reviewed``: a decision exists for the same product, SKU key and price to two places."""
    key = lambda p: F.concat_ws("|", F.col("id").cast("string"), F.regexp_replace(F.upper(F.trim("sku")), "WP$", "W"), F.format_number(F.col(p), 2))
    d = decisions.select(key("price").alias("__k")).distinct().withColumn("__r", F.lit(True))
    return preview.withColumn("__k", key("price")).join(d, "__k", "left").withColumn("is_reviewed", F.col("__r").isNotNull()).drop("__k", "__r")


def row_warnings(df: DataFrame, group: str, config: list[str], price: str, listed: str) -> DataFrame:
    """df with ``warnings``: duplicate (same group and configuration), copied (same group and price, another configuration), wrong_price (10 % or
    more from the listed one), multi_sku. Counts over windows replace the pairwise comparison."""
    same = F.count(F.lit(1)).over(Window.partitionBy(group, *config))
    priced = F.count(F.lit(1)).over(Window.partitionBy(group, price))
    alike = F.count(F.lit(1)).over(Window.partitionBy(group, price, *config))
    known = F.col(group).isNotNull()
    w = F.array_compact(F.array(
        F.when(known & (same > 1), F.lit("duplicate")), F.when(known & (F.col(price) > 0) & (priced > alike), F.lit("copied")),
        F.when((F.col(listed) > 0) & (F.abs(F.col(price) - F.col(listed)) / F.col(listed) >= 0.1), F.lit("wrong_price"))))
    return df.withColumn("warnings", w)


def kits(options: DataFrame) -> DataFrame:
    """(chip, kit_price, choices): one row a chip with its options by group; blocked ones left out."""
    each = F.struct("option_group", "value", "add_on", "is_included")
    return options.groupBy("chip").agg(F.max("kit_price").alias("kit_price"), F.sort_array(F.collect_list(F.when(~F.col("is_blocked"), each))).alias("choices"))


def choice_defaults(options: DataFrame, given: DataFrame, standard: DataFrame) -> DataFrame:
    """(chip, option_group, value): the given value, else the standard one if the chip allows it, else the included one."""
    groups = options.where(~F.col("is_blocked")).groupBy("chip", "option_group").agg(F.collect_set("value").alias("allowed"), F.min(F.when(F.col("is_included"), F.col("value"))).alias("included"))
    g = given.select("option_group", F.col("value").alias("__given"))
    s = standard.select("option_group", F.col("value").alias("__std"))
    j = groups.join(g, "option_group", "left").join(s, "option_group", "left")
    ok = F.array_contains("allowed", F.col("__std"))
    return j.select("chip", "option_group", F.coalesce("__given", F.when(ok, F.col("__std")), "included").alias("value"))


def quote(options: DataFrame, choices: DataFrame) -> DataFrame:
    """(chip, price) of every chip that allows all chosen (option_group, value) rows: kit price plus add-ons (unknown ones count 0). Relational
    division: as many allowed hits as choices."""
    wanted = choices.select("option_group", "value").distinct()
    hits = options.where(~F.col("is_blocked")).join(wanted, ["option_group", "value"]).groupBy("chip").agg(F.count_distinct("option_group", "value").alias("__n"), (F.max("kit_price") + F.sum(F.coalesce("add_on", F.lit(0.0)))).alias("price"))
    return hits.join(F.broadcast(wanted.agg(F.count(F.lit(1)).alias("__all")))).where("__n = __all").select("chip", "price")


def best_quote(options: DataFrame, choices: DataFrame, chip: str) -> DataFrame:
    """The wanted chip's quote if it allows all choices, else the cheapest that does."""
    return quote(options, choices).orderBy((F.col("chip") != chip).cast("int"), "price", "chip").limit(1)


def price_differences(options: DataFrame, standard: DataFrame) -> DataFrame:
    """Options with ``difference`` from the standard value of their chip and group."""
    s = options.join(standard.select("option_group", "value"), ["option_group", "value"], "left_semi").select("chip", "option_group", F.coalesce("add_on", F.lit(0.0)).alias("__std"))
    return options.join(s, ["chip", "option_group"], "left").withColumn("difference", F.coalesce("add_on", F.lit(0.0)) - F.coalesce("__std", F.lit(0.0))).drop("__std")


def complete_kits(options: DataFrame, other_price: str) -> DataFrame:
    """Options of the chips all of whose rows have the other price."""
    whole = options.groupBy("chip").agg(F.bool_and(F.col(other_price).isNotNull()).alias("__ok")).where("__ok")
    return options.join(whole.select("chip"), "chip", "left_semi")


def visible_discount(df: DataFrame, price: str, discounted: str) -> DataFrame:
    return df.where((F.col("status") == "active") & (F.col(discounted) > 0) & (F.col(discounted) < F.col(price)))


def effective_links(links: DataFrame, key: str = "review_id") -> DataFrame:
    """Human links, where a review has any, else the automatic ones."""
    human = F.bool_or(F.col("source") == "human").over(Window.partitionBy(key))
    return links.withColumn("__h", human).where((F.col("source") == "human") | ~F.col("__h")).drop("__h")


def single_config(links: DataFrame, key: str = "review_id") -> DataFrame:
    """(key, family_id, config_id): each if there is exactly one, else null."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.max(c)).alias(c)
    return links.groupBy(key).agg(one("family_id"), one("config_id"))


def separability(df: DataFrame, group: str, columns: list[str], memory: list[str]) -> DataFrame:
    """(group, code): no_configs, single_config, identical_specs, ram_storage_only or separable, by the columns that differ."""
    n = F.count("config_id").alias("__n")
    many = [(F.count_distinct(c) + F.max(F.when(F.col("config_id").isNotNull() & F.col(c).isNull(), 1).otherwise(0)) > 1).alias(f"__{c}") for c in columns]
    g = df.groupBy(group).agg(n, *many)
    other = F.lit(False)
    for c in columns:
        if c not in memory:
            other = other | F.col(f"__{c}")
    mem = F.lit(False)
    for c in memory:
        mem = mem | F.col(f"__{c}")
    code = F.when(F.col("__n") == 0, "no_configs").when(F.col("__n") == 1, "single_config").when(~other & ~mem, "identical_specs").when(~other, "ram_storage_only").otherwise("separable")
    return g.select(group, code.alias("code"))


def place_claims(claims: DataFrame, configs: DataFrame) -> DataFrame:
    """claims (about, scope, family_id, config_no) with config_id or the reason of quarantine. configs: family_id, config_no, config_id."""
    j = claims.join(configs, ["family_id", "config_no"], "left")
    reason = F.when(F.col("about") == "other", "other_laptop").when(F.col("about") == "none", "none").when(F.col("about") == "several", "several").when((F.col("scope") == "config") & F.col("config_id").isNull(), "config_unknown")
    return j.withColumn("reason", reason).withColumn("config_id", F.when(reason.isNull() & (F.col("scope") == "config"), F.col("config_id")))


def missing_windows(expected: DataFrame, saved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected windows without a saved claim: what is left to process after a stop."""
    return expected.join(saved.select(*keys).distinct(), list(keys), "left_anti")


FUNNEL = ("found", "transcript", "linked", "processed", "shown")


def classify(reviews: DataFrame) -> DataFrame:
    """(review_id, step, reason) from the flags has_text, is_linked, is_processed, is_shown and the failure text."""
    step = F.when(F.col("is_shown"), "shown").when(F.col("is_processed"), "processed").when(F.col("is_linked"), "linked").when(F.col("has_text"), "transcript").otherwise("found")
    reason = F.when(step == "shown", None).when(step == "processed", "hidden").when(step == "linked", "not processed").when(step == "transcript", "no link").otherwise(F.coalesce("failure", F.lit("no transcript")))
    return reviews.select("review_id", step.alias("step"), reason.alias("reason"))


def public_view(claims: DataFrame, own: Column, sibling: Column, n: int = 5) -> DataFrame:
    """Up to n claims a sentiment, of the row's own and its family, else of siblings; repeated texts (case-folded) once, in tier and id order."""
    t = claims.withColumn("tier", F.when(own, 0).when(sibling, 1)).where("tier is not null")
    best = t.withColumn("__b", F.min("tier").over(Window.partitionBy("sentiment"))).where("tier = __b")
    once = best.withColumn("__d", F.row_number().over(Window.partitionBy("sentiment", F.lower("text")).orderBy("claim_id"))).where("__d = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("sentiment").orderBy("claim_id"))).where(F.col("place") <= n).drop("__b", "__d")


def skip_existing(found: DataFrame, stored: DataFrame, key: str = "video_id") -> DataFrame:
    """Found rows to take: new ones, and stored ones that are rejected for a reason that may pass."""
    final = stored.where(F.col("human_link") | F.col("deferred") | (F.col("status") != "rejected") | F.col("terminal")).select(key)
    return found.dropDuplicates([key]).join(final, key, "left_anti")


def worklist(df: DataFrame, group: str, name: str, id_col: str, covered: DataFrame) -> DataFrame:
    """(group, representative): each group's row of the shortest name (then name, then id), without the covered groups."""
    rep = F.min(F.struct(F.length(name).alias("n"), F.col(name).alias("name"), F.col(id_col).alias("id"))).alias("r")
    return df.groupBy(group).agg(rep).join(covered.select(group), group, "left_anti").select(group, F.col("r.id").alias("representative"))


def candidate_numbers(members: DataFrame, review: str, family: str, label: str, link_order: str) -> DataFrame:
    """Candidates of each review: families numbered in link order, distinct labels numbered inside a family; whether a label stands alone."""
    order = members.groupBy(review, family).agg(F.min(link_order).alias("__o"))
    fam = order.withColumn("family_no", F.row_number().over(Window.partitionBy(review).orderBy("__o", family))).drop("__o")
    labels = members.groupBy(review, family, label).agg(F.count(F.lit(1)).alias("members"), F.min("config_id").alias("__c"))
    w = Window.partitionBy(review, family).orderBy(label)
    return labels.withColumn("config_no", F.row_number().over(w)).join(fam, [review, family]).withColumn("config_id", F.when(F.col("members") == 1, F.col("__c"))).drop("__c")


def error_class(message: Column) -> Column:
    """transient for what a retry may cure, else permanent; null for null."""
    return F.when(message.isNull(), None).when(F.lower(message).rlike("timeout|timed out|rate limit|429|503|temporar|connection"), "transient").otherwise("permanent")


def pending_queue(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The next rows to process: pending, or failed once for a transient reason."""
    retry = (F.col("status") == "failed") & (F.col("attempts") < 2) & (error_class(F.col("error")) == "transient")
    return df.where((F.col("status") == "pending") | retry).orderBy(*order).limit(limit)


JOB_STATES = {"queued": ("processing", "cancelled"), "processing": ("completed", "failed", "cancelling"), "cancelling": ("cancelled", "failed"), "completed": (), "failed": (), "cancelled": ()}


def job_status(log: DataFrame, now: Column, dead_hours: float = 6.0) -> DataFrame:
    """The latest row of each job with ``progress`` (0 while queued, 100 when completed) and dead ones failed: no update for dead_hours."""
    w = Window.partitionBy("job_id").orderBy(F.desc("updated_at"), F.desc("processed"))
    last = log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    dead = F.col("status").isin("queued", "processing", "cancelling") & (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp")) > int(dead_hours * 3_600_000_000))
    out = last.withColumn("status", F.when(dead, "failed").otherwise(F.col("status")))
    part = F.when(F.coalesce(F.col("total"), F.lit(0)) > 0, F.least(F.lit(99), F.floor(F.col("processed") * 100 / F.col("total")))).otherwise(0)
    return out.withColumn("progress", F.when(F.col("status") == "completed", 100).otherwise(part).cast("int"))


def bad_transitions(log: DataFrame) -> DataFrame:
    """Status changes that the job states do not allow."""
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for kv in JOB_STATES.items() for x in kv])
    prev = F.lag("status").over(Window.partitionBy("job_id").orderBy("updated_at", "processed"))
    steps = log.withColumn("before", prev).where("before is not null and before <> status")
    return steps.where(~F.coalesce(F.array_contains(allowed[F.col("before")], F.col("status")), F.lit(False)))


def is_locked(jobs: DataFrame, kinds: list[str], now: Column) -> DataFrame:
    """(locked): a live job of one of the kinds is queued or running."""
    live = job_status(jobs, now).where(F.col("job_type").isin(kinds) & F.col("status").isin("queued", "processing", "cancelling"))
    return live.agg((F.count(F.lit(1)) > 0).alias("locked"))


def run_steps(spark: SparkSession, steps: Sequence[tuple[str, Callable[[SparkSession], int]]]) -> list[dict]:
    """Runs named steps in order. A step that raises stops the rest; its error is in the report, as are the steps that were not run."""
    report: list[dict] = []
    failed = False
    for name, step in steps:
        if failed:
            report.append({"step": name, "status": "skipped", "count": None, "error": None})
            continue
        try:
            report.append({"step": name, "status": "ok", "count": step(spark), "error": None})
        except Exception as e:  # noqa: BLE001 - the report is the point
            failed = True
            report.append({"step": name, "status": "failed", "count": None, "error": f"{type(e).__name__}: {e}"})
    return report

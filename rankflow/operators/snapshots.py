"""Replay snapshots: event metrics by player slot, cumulated at checkpoints, with views, rates, milestones and swaps.

Metrics stay in long form (replay, minute, slot, key, value); only keys asked
for are pivoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, token
from ..functions.windows import START
from .joins import as_dimension

EVERY = 5  # minutes
RESOURCES = ["food", "wood", "gold", "stone"]
TIERS = (2, 3, 4)


def _metric(key: Column, value: Column | float = 1.0, when: Column | None = None) -> Column:
    value = value if isinstance(value, Column) else F.lit(float(value))
    return F.struct((key if when is None else F.when(when, key)).alias("key"), value.cast("double").alias("value"))


def _kind(category: str) -> Column:
    return token("intent_category") == category


def event_metrics(events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(replay_id, time_s, player_slot, key, value): what each event counts for.

    ``catalogue`` (pbgid, costs) is a small dimension; an unknown id counts as
    unknown metadata.
    """
    i = lambda x: F.col(f"intent.{x}")
    pbgid = F.when(_kind("unit_production"), i("unit_pbgid")).when(_kind("building"), i("pbgid")).when(_kind("technology_research"), i("technology_pbgid"))
    prefix = F.when(_kind("unit_production"), "unit").when(_kind("building"), "building").when(_kind("technology_research"), "technology")
    costs = as_dimension(catalogue.select(F.col("pbgid").cast("string").alias("_pbgid"), *[F.col(f"costs.{x}").alias(f"_{x}") for x in RESOURCES], F.lit(True).alias("_known")))
    rows = events.withColumns({"_id": pbgid, "_prefix": prefix}).join(costs, F.col("_id") == F.col("_pbgid"), "left")
    known, unknown = F.col("_prefix").isNotNull() & F.col("_known"), F.col("_prefix").isNotNull() & F.col("_known").isNull()
    total = sum((F.coalesce(F.col(f"_{x}"), F.lit(0.0)) for x in RESOURCES), F.lit(0.0))
    name = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    act, cancel = _kind("villager_action"), _kind("cancel")
    metrics = [
        _metric(F.lit("events")),
        _metric(name("intent_", token("intent_category"), "_count")),
        _metric(F.lit("queued_count"), when=i("is_queued")),
        _metric(name(F.col("_prefix"), "_pbgid_", token("_id"), "_count"), when=F.col("_prefix").isNotNull()),
        _metric(name(F.col("_prefix"), "_known_metadata_count"), when=known),
        _metric(name(F.col("_prefix"), "_unknown_metadata_count"), when=unknown),
        *[_metric(name(F.col("_prefix"), f"_known_cost_{x}"), F.coalesce(F.col(f"_{x}"), F.lit(0.0)), known) for x in RESOURCES],
        _metric(name(F.col("_prefix"), "_known_cost_total_resources"), total, known),
        _metric(name("producer_link_", token(i("producer_building_link_status")), "_count"), when=_kind("unit_production")),
        _metric(name("villager_action_", token(i("action_kind")), "_count"), when=act),
        _metric(name("villager_resource_", token(i("resource_kind")), "_count"), when=act),
        _metric(F.lit("villager_selected_unit_count_sum"), i("selected_unit_count"), act & i("selected_unit_count").isNotNull()),
        _metric(name("cancel_kind_", token(i("cancel_kind")), "_count"), when=cancel),
        _metric(name("cancel_item_kind_", token(i("canceled_item_kind")), "_count"), when=cancel),
        _metric(name("cancel_pbgid_", token(i("canceled_pbgid")), "_count"), when=cancel & i("canceled_pbgid").isNotNull()),
        _metric(name("unit_action_", token(i("action_kind")), "_count"), when=_kind("unit_action")),
    ]
    long = rows.filter("player_slot IN (1, 2)").select("replay_id", F.coalesce("time_s", F.lit(0.0)).alias("time_s"), "player_slot", F.explode(F.array(*metrics)).alias("m"))
    return long.filter("m.key IS NOT NULL").select("replay_id", "time_s", "player_slot", "m.key", "m.value")


def checkpoints(events: DataFrame, every: int = EVERY) -> DataFrame:
    """(replay_id, minute): a checkpoint every few minutes until the last event."""
    last = events.groupBy("replay_id").agg(F.max(F.coalesce("time_s", F.lit(0.0))).alias("t"))
    return last.filter(F.col("t") >= 60 * every).select("replay_id", F.explode(F.sequence(F.lit(every), F.floor(F.col("t") / 60).cast("int"), F.lit(every))).alias("minute"))


def cumulative(metrics: DataFrame, grid: DataFrame, keys: list[str] | None = None, every: int = EVERY) -> DataFrame:
    """(replay_id, minute, player_slot, key): sums up to each checkpoint, and the change since the one before (0 at least)."""
    wanted = metrics if keys is None else metrics.filter(F.col("key").isin(keys))
    minute = (F.greatest(F.ceil(F.col("time_s") / F.lit(60.0 * every)), F.lit(1)) * every).cast("int")
    binned = wanted.groupBy("replay_id", "player_slot", "key", minute.alias("minute")).agg(F.sum("value").alias("v"))
    full = grid.join(binned.select("replay_id", "player_slot", "key").distinct(), "replay_id").join(binned, ["replay_id", "player_slot", "key", "minute"], "left")
    w = Window.partitionBy("replay_id", "player_slot", "key").orderBy("minute")
    out = full.withColumn("value", F.coalesce(F.sum("v").over(w.rowsBetween(START, 0)), F.lit(0.0)))
    return out.withColumn("delta", F.greatest(F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)), F.lit(0.0))).drop("v")


def slot_views(cumulated: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each checkpoint; for each key both slots, their sum, difference and slot 1's share, and rates a minute."""
    both = cumulated.groupBy("replay_id", "minute").agg(*[F.coalesce(F.sum(F.when((F.col("player_slot") == s) & (F.col("key") == k), F.col("value"))), F.lit(0.0)).alias(f"slot{s}_{k}") for k in keys for s in (1, 2)])
    out = {}
    for k in keys:
        a, b = F.col(f"slot1_{k}"), F.col(f"slot2_{k}")
        out |= {f"sum_{k}": a + b, f"diff_{k}": a - b, f"share_slot1_{k}": ratio(a, a + b)}
        if k == "events" or k.endswith("_count"):
            out |= {f"slot{s}_{k}_per_min": F.col(f"slot{s}_{k}") / F.col("minute") for s in (1, 2)}
    return both.withColumns(out)


def with_fractions(views: DataFrame) -> DataFrame:
    """Resource parts of each category's spending and each category's part of all spending."""
    at = lambda x: F.coalesce(F.col(x), F.lit(0.0)) if x in views.columns else F.lit(0.0)
    out = {}
    for s in ("slot1", "slot2"):
        totals = {c: at(f"{s}_{c}_known_cost_total_resources") for c in ("unit", "building", "technology")}
        for c, total in totals.items():
            out |= {f"{s}_{c}_{r}_frac": at(f"{s}_{c}_known_cost_{r}") / F.greatest(total, F.lit(1e-6)) for r in RESOURCES}
        spent = F.greatest(sum(totals.values(), F.lit(0.0)), F.lit(1e-6))
        out |= {f"{s}_{c}_spend_frac": total / spent for c, total in totals.items()}
    rows = views.withColumns(out)
    return rows.withColumns({f"diff_{x[6:]}": F.col(x) - F.col(f"slot2_{x[6:]}") for x in out if x.startswith("slot1_")})


def with_cancels(views: DataFrame) -> DataFrame:
    """Cancelled parts of units, technologies and buildings, and net units."""
    at = lambda x: F.coalesce(F.col(x), F.lit(0.0)) if x in views.columns else F.lit(0.0)
    pairs = {"unit": ("intent_unit_production_count", "cancel_item_kind_unit_production_count"), "tech": ("intent_technology_research_count", "cancel_item_kind_technology_research_count"), "building": ("intent_building_count", "cancel_kind_foundation_count")}
    out = {}
    for s in ("slot1", "slot2"):
        out |= {f"{s}_{x}_cancel_rate": at(f"{s}_{gone}") / F.greatest(at(f"{s}_{made}"), F.lit(1.0)) for x, (made, gone) in pairs.items()}
        out[f"{s}_net_unit_production"] = at(f"{s}_intent_unit_production_count") - at(f"{s}_cancel_item_kind_unit_production_count")
    rows = views.withColumns(out)
    return rows.withColumns({f"diff_{x[6:]}": F.col(x) - F.col(f"slot2_{x[6:]}") for x in out if x.startswith("slot1_")})


def milestones(events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(replay_id): first times of age-ups and of units, technologies and buildings of each age, by slot, with differences.

    ``catalogue`` has pbgid, age, is_age_up_building, is_age_up_tech and ageup_to_tier.
    """
    i = lambda x: F.col(f"intent.{x}")
    pbgid = F.when(_kind("building"), i("pbgid")).when(_kind("technology_research"), i("technology_pbgid")).when(_kind("unit_production"), i("unit_pbgid"))
    info = as_dimension(catalogue.select(F.col("pbgid").cast("string").alias("_id"), "age", "is_age_up_building", "is_age_up_tech", "ageup_to_tier"))
    rows = events.withColumn("_id", pbgid).join(info, "_id")
    up_building, up_tech = _kind("building") & F.col("is_age_up_building"), _kind("technology_research") & F.col("is_age_up_tech")
    tier = F.when(up_building, F.col("ageup_to_tier")).when(up_tech, F.col("age"))
    content = F.when(_kind("unit_production"), "unit").when(_kind("technology_research") & ~F.coalesce("is_age_up_tech", F.lit(False)), "tech").when(_kind("building") & ~F.coalesce("is_age_up_building", F.lit(False)), "building")
    rows = rows.withColumns({"_tier": tier, "_content": content})
    first = lambda s, condition: F.min(F.when((F.col("player_slot") == s) & condition, F.coalesce("time_s", F.lit(0.0))))
    names = {f"ageup{n}_commit_s": F.col("_tier") == n for n in TIERS} | {f"first_age{n}_{c}_s": (F.col("_content") == c) & (F.col("age") == n) for n in TIERS for c in ("unit", "tech", "building")}
    out = rows.groupBy("replay_id").agg(*[first(s, condition).alias(f"slot{s}_{x}") for s in (1, 2) for x, condition in names.items()])
    more = {f"slot{s}_age{n}_commit_to_unit_s": F.col(f"slot{s}_first_age{n}_unit_s") - F.col(f"slot{s}_ageup{n}_commit_s") for s in (1, 2) for n in (2, 3)}
    return out.withColumns(more | {f"diff_{x}": F.col(f"slot1_{x}") - F.col(f"slot2_{x}") for x in names})


def phase(minute: Column | str = "minute") -> Column:
    m = F.col(minute) if isinstance(minute, str) else minute
    return F.when(m <= 10, "early").when(m <= 20, "mid").otherwise("late")


def row_weights(rows: DataFrame, match: str = "replay_id") -> DataFrame:
    """1 / rows of the match."""
    return rows.withColumn("row_weight", F.lit(1.0) / F.count("*").over(Window.partitionBy(match)))


def swap_slots(rows: DataFrame, target: str | None = "target") -> DataFrame:
    """Slots exchanged, differences negated, shares as 1 - share; columns keep their order."""

    def of(name: str) -> Column:
        for a, b in (("slot1_", "slot2_"), ("slot2_", "slot1_")):
            if name.startswith(a) and b + name[len(a) :] in rows.columns:
                return F.col(b + name[len(a) :])
        if name.startswith("diff_") or "_diff_" in name:
            return -F.col(name)
        if name.startswith("share_slot1_"):
            return 1.0 - F.col(name)
        return 1 - F.col(name) if name == target else F.col(name)

    return rows.select(*[of(x).alias(x) for x in rows.columns])


def latest_before(rows: DataFrame, minute: int, match: str = "replay_id") -> DataFrame:
    """Each match's last snapshot not after ``minute``."""
    columns = [x for x in rows.columns if x != match]
    return rows.filter(F.col("minute") <= minute).groupBy(match).agg(F.max_by(F.struct(*columns), "minute").alias("r")).select(match, "r.*")


def resolve_labels(sources: list[DataFrame], key: str = "replay_id") -> DataFrame:
    """The first known label of several sources in order of trust, and which one it was."""
    out = None
    for k, df in enumerate(sources):
        named = df.select(key, F.col("target").alias(f"_t{k}"))
        out = named if out is None else out.join(named, key, "full_outer")
    labels = [F.col(f"_t{k}") for k in range(len(sources))]
    which = F.coalesce(*[F.when(x.isNotNull(), F.lit(k)) for k, x in enumerate(labels)])
    return out.select(key, F.coalesce(*labels).alias("target"), which.alias("label_source"))

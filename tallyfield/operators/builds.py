"""Build records from provider payloads whose shape drifts, and the next step of a levelling order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shards that stand in where a payload has none, and the pages that do.
SHARDS, PRIMARY_PAGE, SECONDARY_PAGE = (5008, 5008, 5001), 8000, 8100
RUNES = 9
ABILITIES = ("Q", "W", "E", "R")
BASICS = ABILITIES[:3]


def build_records(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``problem`` and the build: page ids, nine rune ids, spells, starting, core and fourth items.

    Payloads are read as VARIANT: fields may be missing, come as numbers or as texts of numbers, or stand beside unknown ones.
    What a list holds that is no number is left out. A payload without a rune page, without a build in the first page, or with
    fewer than nine runes has a problem and nulls. Absent or empty shards get the usual three.
    """
    v = F.col("__v")
    ids = lambda path: F.filter(F.transform(F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>")), lambda x: x.try_cast("long")), lambda x: x.isNotNull())
    has = lambda path: F.try_variant_get(v, path, "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(v, path, "variant"))
    page, first = "$.rune_pages[0]", "$.rune_pages[0].builds[0]"
    d = payloads.withColumn("__v", F.try_parse_json(payload))
    mods = ids(f"{first}.stat_mod_ids")
    shards = F.when(F.size(mods) > 0, mods).otherwise(F.array(*[F.lit(x).cast("long") for x in SHARDS]))
    d = d.withColumn("__runes", F.slice(F.concat(ids(f"{first}.primary_rune_ids"), ids(f"{first}.secondary_rune_ids"), shards), 1, RUNES))
    problem = F.when(v.isNull(), "not_json").when(~has(page), "no_rune_pages").when(~has(first), "no_build").when(F.size("__runes") < RUNES, "runes")
    number = lambda path, default: F.coalesce(F.try_variant_get(v, path, "string").try_cast("long"), F.lit(default).cast("long"))
    fourth = F.filter(F.array(*[F.get(ids(f"$.last_items[{i}].ids"), F.lit(0)) for i in range(3)]), lambda x: x.isNotNull())
    values = {
        "primary_style_id": number(f"{first}.primary_page_id", PRIMARY_PAGE), "sub_style_id": number(f"{first}.secondary_page_id", SECONDARY_PAGE), "rune_ids": F.col("__runes"),
        "spells": ids("$.summoner_spells[0].ids"), "items_start": ids("$.starter_items[0].ids"), "items_core": ids("$.core_items[0].ids"), "items_fourth": fourth,
    }
    return d.withColumn("problem", problem).withColumns({name: F.when(F.col("problem").isNull(), x) for name, x in values.items()}).drop("__v", "__runes")


def payload_shapes(payloads: DataFrame, *keys: str, payload: str = "payload") -> DataFrame:
    """(keys, payloads, unread, shape): the schema that all payloads of a key fit, as Spark merges their shapes."""
    v = F.try_parse_json(payload)
    return payloads.groupBy(*keys).agg(F.count("*").alias("payloads"), F.count_if(v.isNull()).alias("unread"), F.schema_of_variant_agg(v).alias("shape"))


def next_step(rows: DataFrame, sequence: str = "sequence", ranks: str = "ranks", level: str = "level", priority: str = "priority") -> DataFrame:
    """Adds ``next_step``: the ability to raise next, null when all are at their cap.

    The first entry of the sequence whose running count exceeds what is owned of it (``ranks``: a map, missing is 0). When
    everything scheduled is owned, the general rule decides at the larger of the level and the next point's: the last ability
    if its cap (1 from level 6, 2 from 11, 3 from 16) allows it, else the first basic in the order of priority below half the level, else the
    first below 5, else the last ability below 3. Unknown entries of the sequence count as absent. All inside the row.
    """
    owned = lambda a: F.coalesce(F.try_element_at(F.col(ranks), a), F.lit(0))
    known = F.filter(F.coalesce(sequence, F.array().cast("array<string>")), lambda x: x.isin(*ABILITIES))
    d = rows.withColumn("__s", known)
    ahead = F.filter(F.transform("__s", lambda x, i: F.when(F.size(F.filter(F.slice("__s", F.lit(1), i + 1), lambda y: y == x)) > owned(x), x)), lambda x: x.isNotNull())
    have = {a: owned(F.lit(a)) for a in ABILITIES}
    full = (have["Q"] >= 5) & (have["W"] >= 5) & (have["E"] >= 5) & (have["R"] >= 3)
    target = F.greatest(F.coalesce(level, F.lit(0)), sum(have.values(), F.lit(0)) + 1)
    last = F.when(target >= 16, 3).when(target >= 11, 2).when(target >= 6, 1).otherwise(0)
    cap = F.least(F.lit(5), F.floor((target + 1) / 2))
    order = F.array_distinct(F.concat(F.filter(F.coalesce(priority, F.array().cast("array<string>")), lambda x: x.isin(*BASICS)), F.array(*[F.lit(a) for a in BASICS])))
    below = lambda most: F.get(F.filter(order, lambda a: owned(a) < most), F.lit(0))
    rule = F.coalesce(F.when(have["R"] < last, "R"), below(cap), below(F.lit(5)), F.when(have["R"] < 3, "R"))
    return d.withColumn("next_step", F.coalesce(F.get(ahead, F.lit(0)), F.when(~full, rule))).drop("__s")


def joined(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")

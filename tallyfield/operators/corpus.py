"""Corpora: splits without leakage, blinded pairs, panel consensus, sampling, manifests and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.operators.components import connected_components

SPLITS = (("test", 0.1), ("train", 0.8), ("validation", 0.1))

# Words of a key that tell the outcome, and pairs of neighbouring words that do in either order.
OUTCOME_WORDS = (
    "win", "wins", "won", "winner", "winners", "lose", "loses", "lost", "loss", "losses", "result", "results", "nexus", "victory", "victories",
    "defeat", "defeats", "defeated", "surrender", "surrendered", "surrenders", "remake", "remakes", "outcome", "outcomes",
)
OUTCOME_PHRASES = (("game", "end"), ("game", "over"))


def unit(text: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def assign_splits(edges: DataFrame, game: str, player: str, seed: str = "0", splits: tuple = SPLITS) -> DataFrame:
    """(game, component, split): a match and all its players' matches share one split, drawn by the component's hash."""
    nodes = edges.where(F.col(game).isNotNull() & F.col(player).isNotNull()).select((F.col(game) * 2).alias("src"), (F.col(player) * 2 + 1).alias("dst"))
    comp = connected_components(nodes).where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias(game), "component")
    u, total, out = unit(F.concat_ws(":", F.lit(seed), F.col("component").cast("string"))), 0.0, None
    for name, share in splits:
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return comp.withColumn("split", out.otherwise(splits[-1][0]))


def check_leakage(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that are in more than one split, with the splits."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def check_splits(rows: DataFrame, hard: list[str], soft: list[str], split: str = "split") -> DataFrame:
    """(attribute, value, finding, splits, n, largest_share, entropy): everything that a split gets wrong, and its sizes.

    leak: a value of a ``hard`` attribute (person, match, content) is in several splits. concentrated: a value of a ``soft`` one
    occurs twice or more, in one split only. count: the rows of a split, with its share of all. largest_share and entropy (bits)
    say how a value's rows lie over the splits. Null values are no values. One pass; counts are combined before the shuffle.
    """
    value = lambda c, kind: F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value"), F.lit(kind).alias("kind"))
    each = rows.select(split, F.explode(F.array(*[value(c, "hard") for c in hard], *[value(c, "soft") for c in soft])).alias("x")).select(F.col(split).alias("split"), "x.*").where("value is not null")
    per = each.groupBy("attribute", "value", "kind", "split").agg(F.count("*").alias("n"))
    seen = per.groupBy("attribute", "value", "kind").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.sum("n").alias("total"), F.max("n").alias("most"), F.sum(F.col("n") * F.log2("n")).alias("l"))
    finding = F.when((F.col("kind") == "hard") & (F.size("splits") > 1), "leak").when((F.col("kind") == "soft") & (F.size("splits") == 1) & (F.col("total") > 1), "concentrated")
    found = seen.withColumn("finding", finding).where("finding is not null").select("attribute", "value", "finding", "splits", F.col("total").alias("n"), (F.col("most") / F.col("total")).alias("largest_share"), (F.log2("total") - F.col("l") / F.col("total")).alias("entropy"))
    sizes = rows.groupBy(F.col(split).alias("value")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    counts = sizes.crossJoin(F.broadcast(total)).select(F.lit("split").alias("attribute"), "value", F.lit("count").alias("finding"), F.array("value").alias("splits"), "n", (F.col("n") / F.col("total")).alias("largest_share"), F.lit(0.0).alias("entropy"))
    return found.unionByName(counts)


def near_in_time(rows: DataFrame, time: str, order: str, split: str = "split", seconds: int = 300) -> DataFrame:
    """Consecutive rows in time that are at most ``seconds`` apart and in different splits.

    Rows are ordered inside hours; the first row of the next hour is joined on, so that no task orders the whole table.
    """
    t = F.unix_seconds(F.col(time).cast("timestamp"))
    r = rows.select(F.col(order).alias("id"), t.alias("t"), F.col(split).alias("s"), F.floor(t / 3600).alias("h"))
    me = F.struct("t", "id", "s")
    first = r.groupBy((F.col("h") - 1).alias("h")).agg(F.min(me).alias("f"))
    nxt = F.coalesce(F.lead(me).over(Window.partitionBy("h").orderBy("t", "id")), F.col("f"))
    return r.join(first, "h", "left").select("id", "t", "s", nxt.alias("n")).where(F.col("n").isNotNull() & (F.col("n.t") - F.col("t") <= seconds) & (F.col("n.s") != F.col("s"))).select("id", F.col("n.id").alias("next_id"))


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows dealt round robin over the strata, larger strata first in each round; the order in a stratum is seeded.

    A stratum gives n rows at most, so every task keeps only its n smallest hashes of each before the shuffle.
    """
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    first = rows.withColumn("__h", h).withColumn("round", F.row_number().over(Window.partitionBy(*strata).orderBy("__h", key))).where(F.col("round") <= n)
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("__size")).withColumnsRenamed({s: f"__{s}" for s in strata})
    same = F.lit(True)
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"__{s}"))
    r = first.join(sizes, same)
    return r.orderBy("round", F.desc("__size"), *strata).limit(n).select(*rows.columns, "round")


def blind_pairs(pairs: DataFrame, seed: str = "0") -> DataFrame:
    """Order-free pair id, opaque tokens and a seeded side; the private map keeps which token is whose."""
    a, b = F.least("left_ref", "right_ref").cast("string"), F.greatest("left_ref", "right_ref").cast("string")
    pid = F.substring(F.sha2(F.concat_ws("|", a, b), 256), 1, 20)
    swap = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), pid), 256), 1, 1), 16, 10).cast("int") % 2 == 1
    token = lambda side: F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("pair_id"), F.lit(side)), 256), 1, 12)
    out = pairs.select(pid.alias("pair_id"), F.when(swap, b).otherwise(a).alias("left_ref"), F.when(swap, a).otherwise(b).alias("right_ref")).distinct()
    return out.withColumns({"left_token": token("left"), "right_token": token("right")})


def unblind(labels: DataFrame, tokens: DataFrame) -> DataFrame:
    """Labels with the references of their pair; labels without a pair are left out (count them by a left anti join)."""
    return labels.join(tokens.select("pair_id", "left_ref", "right_ref"), "pair_id")


def panel_consensus(tiers: DataFrame, reviewers: int = 2, share: float = 0.66, max_gap: int = 9) -> DataFrame:
    """Pairs on which enough reviewers agree in both rounds.

    ``tiers`` is (match, round, reviewer, item, tier, confidence). A reviewer prefers the lower tier; a preference counts
    if both rounds give the same one. Kept are pairs with at least ``reviewers`` stable reviewers, a majority share of
    ``share`` and a mean tier gap of at most ``max_gap``.
    """
    laid = tiers.where("match is not null and round is not null and reviewer is not null and item is not null").repartition("match")  # the only exchange
    item = laid.groupBy("match", "reviewer", "item").agg(F.collect_list(F.struct("round", "tier", "confidence")).alias("given"))
    of = item.groupBy("match", "reviewer").agg(F.collect_list(F.struct("item", "given")).alias("items"))
    first = of.select("match", "items", F.explode("items").alias("x"))
    pairs = first.select("match", "x", F.explode(F.filter("items", lambda y: F.col("x.item") < y["item"])).alias("y"))

    def compared(x: Column, y: Column) -> Column:
        apart = y["tier"] - x["tier"]
        return F.struct(x["round"].alias("round"), F.signum(apart).alias("p"), F.abs(apart).cast("double").alias("gap"), F.least(x["confidence"], y["confidence"]).alias("c"))

    prefs = F.flatten(F.transform("x.given", lambda x: F.transform(F.filter("y.given", lambda y: x["round"] == y["round"]), lambda y: compared(x, y))))
    rated = pairs.select("match", F.col("x.item").alias("a"), F.col("y.item").alias("b"), prefs.alias("prefs"))
    gaps = F.filter("prefs.gap", lambda g: g.isNotNull())
    mean = F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g), F.size(gaps))
    agreed = rated.where(F.size(F.array_distinct("prefs.round")) == 2).withColumns({"lo": F.array_min("prefs.p"), "hi": F.array_max("prefs.p")}).where("lo = hi and lo != 0")
    stable = agreed.select("match", "a", "b", "lo", mean.alias("gap"), F.array_min("prefs.c").alias("c"))
    votes = stable.groupBy("match", "a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("lo") > 0).alias("for_a"), F.avg("gap").alias("gap"), F.min("c").alias("confidence"))
    top = F.greatest(F.col("for_a"), F.col("n") - F.col("for_a"))
    kept = votes.where((F.col("n") >= reviewers) & (top >= share * F.col("n")) & (F.col("gap") <= max_gap) & (F.col("for_a") * 2 != F.col("n")))
    return kept.select("match", "a", "b", F.when(F.col("for_a") * 2 > F.col("n"), F.col("a")).otherwise(F.col("b")).alias("winner"), "n", "confidence")


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as one JSON object in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def manifest_conflicts(entries: DataFrame, key: str = "entry_id", digest: str = "content_hash") -> DataFrame:
    """Entries that come with several content hashes."""
    return entries.groupBy(key).agg(F.count_distinct(digest).alias("hashes")).where("hashes > 1")


def key_tokens(name: Column) -> Column:
    """Lower-case words of a snake, kebab or camel name."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.split(F.lower(F.trim(spaced)), " ")


def leaked_keys(rows: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """(id, key) of every key at any depth of a JSON text that tells the outcome."""
    keys = rows.select(id_col, F.explode_outer(F.array_distinct(F.regexp_extract_all(json_col, F.lit(r'"([^"]+)"\s*:'), 1))).alias("key")).where("key is not null")
    t = key_tokens(F.col("key"))
    phrase = F.exists(F.arrays_zip(F.slice(t, 1, 50).alias("x"), F.slice(t, 2, 50).alias("y")), lambda z: F.concat_ws(" ", z["x"], z["y"]).isin(*[" ".join(p) for a, b in OUTCOME_PHRASES for p in ((a, b), (b, a))]))
    return keys.where(F.arrays_overlap(t, F.array(*[F.lit(w) for w in OUTCOME_WORDS])) | phrase)


def leaked_fields(schema: T.StructType, words: tuple[str, ...] = OUTCOME_WORDS) -> list[str]:
    """Paths of a schema whose name holds one of the words; a driver-side walk, no data is read."""
    import re

    found: list[str] = []

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                parts = re.split("[^a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", f.name).lower())
                pairs = {frozenset(p) for p in zip(parts, parts[1:])}
                if set(parts) & set(words) or pairs & {frozenset(p) for p in OUTCOME_PHRASES}:
                    found.append(f"{path}{f.name}")
                walk(f.dataType, f"{path}{f.name}.")
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, path)
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, path)

    walk(schema, "")
    return found


def pseudonym(column: Column, salt: str) -> Column:
    return F.concat(F.lit("p_"), F.substring(F.sha2(F.concat(F.lit(salt), column.cast("string")), 256), 1, 24))


def identity_leaks(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows whose key is no SHA-256 in hex or whose name is not a neutral one."""
    return rows.where(~F.coalesce(F.col(key).rlike("^[0-9a-f]{64}$"), F.lit(False)) | ~F.coalesce(F.col(name).startswith("Player "), F.lit(False)))


def resolvable(pairs: DataFrame, records: DataFrame, ref: str = "item_ref") -> DataFrame:
    """Pairs of which both ends are among the records."""
    left, right = records.select(F.col(ref).alias("left_ref")), records.select(F.col(ref).alias("right_ref"))
    return pairs.join(left, "left_ref", "left_semi").join(right, "right_ref", "left_semi")


def violations(rows: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for every rule that a row breaks; an unknown outcome counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(id_col, F.explode_outer(broken).alias("rule")).where("rule is not null")

"""Preference formatting of conversations.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (same role and text at each place) is
rendered once as the prompt; what follows in each is its completion. Completions come as text together with a loss mask
over their turns: 1 for the assistant's, 0 for the rest.

The prefix is found turn by turn in a join and an aggregate; only then is each conversation, which is one output row, put
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def opening_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id): all conversations two by two, those with the same opening turn first.

    Conversations of one opening are numbered by (md5 of the id, id) and 1 goes with 2, 3 with 4, and so on. Those that
    stay alone in their opening, one at most for each, are paired in the order of their opening's md5. Of an odd number of
    conversations the last in that order has no partner and so no pair. Chosen is the one that ends with the assistant, then
    the one with more turns, then the smaller id. pair_id is the smaller id. Numbers are dealt per slice of an opening and offset by the slices before, so that an
    opening that a third of all conversations share is never in one task.
    """
    valid = turns.where("conv_id is not null and turn is not null")
    shape = valid.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("n"))
    roles = valid.select("conv_id", "turn", "role", "text")
    heads = roles.join(shape, "conv_id").where("turn = first or turn = last")
    ends = heads.groupBy("conv_id").agg(
        F.min(F.when(F.col("turn") == F.col("first"), F.md5(rendered(F.col("role"), F.col("text"))))).alias("opening"),
        F.max(F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), 1).otherwise(0)).alias("answered"),
        F.max("n").alias("n"),
    )
    keyed = ends.withColumn("k", F.md5(F.col("conv_id").cast("string")))
    sliced = keyed.withColumn("slice", F.conv(F.substring("k", 1, 2), 16, 10).cast("int"))
    counts = sliced.groupBy("opening", "slice").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("opening").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    own = F.row_number().over(Window.partitionBy("opening", "slice").orderBy("k", "conv_id"))
    numbered = sliced.withColumn("own", own).join(before, ["opening", "slice"]).withColumn("number", F.col("own") + F.col("before"))
    rank = F.struct((-F.col("answered")).alias("a"), (-F.col("n")).alias("n"), F.col("conv_id").alias("c"))
    two = numbered.select("opening", F.floor((F.col("number") - 1) / 2).alias("seat"), rank.alias("r"))
    seats = two.groupBy("opening", "seat").agg(F.min("r").alias("best"), F.max("r").alias("worst"), F.count("*").alias("m"))
    single = seats.where("m = 1").select("opening", "best", F.substring("opening", 1, 3).alias("slice"))
    sizes = single.groupBy("slice").agg(F.count("*").alias("c"))
    offset = sizes.select("slice", F.coalesce(F.sum("c").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("slice").orderBy("opening")) + F.col("before")
    rest = single.join(F.broadcast(offset), "slice").select(F.floor((place - 1) / 2).alias("seat"), "best")  # 4096 slices at most
    others = rest.groupBy("seat").agg(F.min("best").alias("best"), F.max("best").alias("worst"), F.count("*").alias("m"))
    every = seats.where("m = 2").select("best", "worst").union(others.where("m = 2").select("best", "worst"))
    return every.select(F.least("best.c", "worst.c").alias("pair_id"), F.col("best.c").alias("chosen_id"), F.col("worst.c").alias("rejected_id"))


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, n_shared, prompt, chosen, rejected, chosen_mask, rejected_mask) for each pair.

    ``turns`` has (conv_id, turn, role, text); turns are taken in the order of ``turn``, then role and text where it
    repeats. Null roles and texts are empty; rows without conv_id or turn are left out, and so are pairs of which one side
    has no turns. Masks have a digit for each turn of the completion. An empty completion is an empty text and mask.
    """
    one = turns.where("conv_id is not null and turn is not null").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    sides = pairs.select("pair_id", "chosen_id", "rejected_id")
    a = whole.select(F.col("conv_id").alias("chosen_id"), F.col("t").alias("a"))
    b = whole.select(F.col("conv_id").alias("rejected_id"), F.col("t").alias("b"))
    both = sides.join(a, "chosen_id").join(b, "rejected_id")
    plain = lambda x: F.transform(x, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    same = F.zip_with(plain(F.col("a")), plain(F.col("b")), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    shared = both.withColumn("n_shared", F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.least(F.size("a"), F.size("b"))).cast("int"))
    text = lambda x: F.array_join(F.transform(x, lambda t: rendered(t["role"], t["text"])), "")
    mask = lambda x: F.array_join(F.transform(x, lambda t: F.when(t["role"] == "assistant", "1").otherwise("0")), "")
    rest = lambda c: F.slice(F.col(c), F.col("n_shared") + 1, F.size(c))
    return shared.select("pair_id", "chosen_id", "rejected_id", "n_shared", text(F.slice("a", 1, F.col("n_shared"))).alias("prompt"), text(rest("a")).alias("chosen"), text(rest("b")).alias("rejected"), mask(rest("a")).alias("chosen_mask"), mask(rest("b")).alias("rejected_mask"))


SQL = """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) as r
           from conversations where conv_id is not null and turn is not null),
c as (select conv_id, count(*) as n, min(turn) as f, max(turn) as l from t group by conv_id),
e as (select t.conv_id, min(case when turn = f then md5(r) end) as opening, max(case when turn = l and role = 'assistant' then 1 else 0 end) as answered, max(n) as n
      from t join c using (conv_id) group by t.conv_id),
s as (select *, row_number() over (partition by opening order by md5(cast(conv_id as varchar)), conv_id) as number from e),
o as (select *, row_number() over (partition by opening, (number - 1) // 2 order by answered desc, n desc, conv_id) as place, count(*) over (partition by opening, (number - 1) // 2) as m from s),
g as (select *, (row_number() over (order by opening) - 1) // 2 as seat from o where m = 1),
h as (select *, row_number() over (partition by seat order by answered desc, n desc, conv_id) as side from g),
p as (select least(a.conv_id, b.conv_id) as pair_id, a.conv_id as chosen_id, b.conv_id as rejected_id
      from o a join o b on a.opening = b.opening and (a.number - 1) // 2 = (b.number - 1) // 2 and a.place = 1 and b.place = 2 where a.m = 2
      union all select least(a.conv_id, b.conv_id), a.conv_id, b.conv_id from h a join h b on a.seat = b.seat and a.side = 1 and b.side = 2),
q as (select *, row_number() over (partition by conv_id order by turn, role, text) as i from t),
w as (select p.pair_id, coalesce(min(case when b.r is null or a.r <> b.r then a.i end), max(a.i) + 1) - 1 as k
      from p join q a on a.conv_id = p.chosen_id left join q b on b.conv_id = p.rejected_id and b.i = a.i group by p.pair_id)
select p.pair_id, p.chosen_id, p.rejected_id, cast(w.k as integer) as n_shared,
  coalesce((select string_agg(r, '' order by i) from q where conv_id = p.chosen_id and i <= w.k), '') as prompt,
  coalesce((select string_agg(r, '' order by i) from q where conv_id = p.chosen_id and i > w.k), '') as chosen,
  coalesce((select string_agg(r, '' order by i) from q where conv_id = p.rejected_id and i > w.k), '') as rejected,
  coalesce((select string_agg(case when role = 'assistant' then '1' else '0' end, '' order by i) from q where conv_id = p.chosen_id and i > w.k), '') as chosen_mask,
  coalesce((select string_agg(case when role = 'assistant' then '1' else '0' end, '' order by i) from q where conv_id = p.rejected_id and i > w.k), '') as rejected_mask
from p join w using (pair_id)"""

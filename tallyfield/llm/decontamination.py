"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly, in DataFrame functions only.

A short test item inside a long document has a tiny Jaccard similarity but a large containment, so the two sides are
treated differently. Items are partitioned by size, powers of two of their shingle count. Every item of a class is sketched by
its k smallest shingle hashes (bottom-k MinHash), k being what the class's largest size m needs: m - ceil(threshold * m) + 1.
A document that holds at least the threshold's share of an item misses fewer than k of its shingles, so it holds one of the
sketch for certain: the search loses nothing, whatever the document's length. A document is matched only with the classes whose
smallest items it is long enough to hold. Candidates are then verified on the full shingle sets.

Documents are shingled once against the sketches, the candidates are written down, and only their documents are read
again. Nothing is gathered per item or per shingle, so an item that sits in a third of all documents is an ordinary join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.session import stored

MAX_BROADCAST = 2_000_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words of letters and digits; null is empty."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _runs(hashed: Column, k: int) -> Column:
    """Hashes of all runs of k hashed words; with fewer words, of the whole sequence; none without words."""
    n = F.size(hashed)
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(k)]))
    return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(F.array_join(hashed.cast("array<string>"), " ")))).otherwise(F.array().cast("array<long>"))


def _shingled(df: DataFrame, id_col: str, text_col: str, name: str, k: int) -> DataFrame:
    """Rows with a null id carry nothing. Words are hashed in a step of their own, so that runs only combine longs.

    To be exploded with ``explode_outer``: for ``explode`` Spark infers a filter on the array and pushes it below this
    step, where every run would hash the whole text again.
    """
    hashed = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(name), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("w"))
    return hashed.select(name, _runs(F.col("w"), k).alias("s"))


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """(item_id, size_class, least, h): the bottom-k of each item's distinct shingles ``s``, k set by its size class.

    Class c holds the items of 2^c to 2^(c+1) - 1 shingles; a document with fewer than ``least`` holds none of them.
    """
    n = F.size("s")
    sized = items.where(n > 0).select("item_id", "s", F.floor(F.log2(n)).cast("int").alias("size_class"))
    low, high = F.expr("shiftleft(1, size_class)"), F.expr("shiftleft(2, size_class) - 1")
    share = lambda m: F.ceil(m * percent / 100).cast("int")
    order = F.transform(F.col("s"), lambda x: F.struct(F.xxhash64(x, F.lit(17)).alias("r"), x.alias("h")))
    taken = F.slice(F.array_sort(order), 1, high - share(high) + 1)
    return sized.select("item_id", "size_class", share(low).alias("least"), F.explode_outer(taken).alias("e")).select("item_id", "size_class", "least", "e.h")


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) of every document that holds at least ``percent`` of an item's shingles.

    A text's words are its lower-case runs of letters and digits, its shingles the distinct runs of ``k`` words (the whole
    sequence if shorter). n_shingles counts the item's, n_shared those also in the document. Null ids, and texts without
    words, are on neither side. Rows of one id are alternatives of which the best counts. Sketches are broadcast only up to
    ``MAX_BROADCAST`` rows; beyond that the join is shuffled.
    """
    item_sets = _shingled(items, item_col, item_text, "item_id", k).select("item_id", F.array_distinct("s").alias("s"))
    sketch = sketches(item_sets, percent).select("h", "item_id", "least").distinct()
    small = sketch.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    seen = _shingled(docs, id_col, text_col, "doc_id", k).select("doc_id", F.size("s").alias("runs"), F.explode_outer("s").alias("h"))
    met = seen.join(F.broadcast(sketch) if small else sketch, "h").where("runs >= least").select("doc_id", "item_id").distinct()
    candidates = stored(met, "contained")

    ids = _bounded(candidates.select(F.col("doc_id").alias(id_col)).distinct())
    again = _shingled(docs.join(ids, id_col, "left_semi"), id_col, text_col, "doc_id", k).select("doc_id", F.array_distinct("s").alias("d"))
    items_ = F.broadcast(item_sets) if small else item_sets
    shared = F.size(F.array_intersect("s", "d"))
    pairs = candidates.join(again, "doc_id").join(items_, "item_id").select("doc_id", "item_id", F.size("s").alias("n_shingles"), shared.alias("n_shared"))
    return pairs.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent).select("doc_id", "item_id", "n_shingles", "n_shared")


def _bounded(ids: DataFrame) -> DataFrame:
    """``ids`` to be broadcast if there are at most ``MAX_BROADCAST``, else as they are."""
    return F.broadcast(ids) if ids.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else ids


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold an item. Rows with a null id stay."""
    found = stored(contained_items(docs, items, k, percent, id_col).select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return docs.join(_bounded(found), id_col, "left_anti").select(*docs.columns)


def sql(k: int = 5, percent: int = 80) -> str:
    """The same by an exact join of all shingles, over the tables of DuckDB."""

    def side(table: str, key: str) -> str:
        more = "".join(f", lead(x, {j}) over w as x{j}" for j in range(1, k))
        run = " || ' ' || ".join(["x", *[f"x{j}" for j in range(1, k)]])
        return f"""
{key}_plain as (select {key}, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as t from {table} where {key} is not null),
{key}_lists as (select {key}, string_split(t, ' ') as l from {key}_plain where t != ''),
{key}_words as (select {key}, len(l) as n, unnest(l) as x, unnest(range(1, len(l) + 1)) as i, case when len(l) < {k} then array_to_string(l, ' ') end as t from {key}_lists),
{key}_runs as (select {key}, n, i, t, x{more} from {key}_words window w as (partition by {key} order by i)),
{key}_sets as (select distinct {key}, case when n >= {k} then {run} else t end as s from {key}_runs where i <= greatest(n - {k} + 1, 1))"""

    return f"""
with {side("documents", "doc_id")}, {side("benchmark", "item_id")},
sizes as (select item_id, count(*) as n from item_id_sets group by item_id)
select d.doc_id, i.item_id, cast(z.n as integer) as n_shingles, cast(count(*) as integer) as n_shared
from doc_id_sets d join item_id_sets i using (s) join sizes z on z.item_id = i.item_id
group by d.doc_id, i.item_id, z.n having count(*) * 100 >= z.n * {percent}"""

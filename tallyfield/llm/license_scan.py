"""Licence scans by canonical digest lookup, in DataFrame functions only.

An entire text is brought to a canonical form: lower case, copyright notices dropped, everything but letters and digits one
blank, equivalent spellings replaced. A notice is a line that begins with "copyright" before (c), a year, a placeholder or a
colon, with (c) before "copyright", a year or a placeholder, or with the sign; and a line "all rights reserved". Lines that
merely begin with the word are text, and so is a notice without a year. Its SHA-256 is looked up among the digests of known licences by a hash join. The
units looked up are each document as a whole and each of its lines as a whole (a licence notice is one line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.license_texts import HEADERS, NOTICES, SPDX, SPELLINGS, TEXTS

MAX_BROADCAST = 50_000

COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright[ \t]*(:|\(c\)|©|[0-9<\[{]).*|\(c\)[ \t]*(copyright|[0-9<\[{]).*|©.*|all rights reserved\.?[ \t]*)$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    # two blanks between words, so that each has its own and equal spellings may follow each other
    out = F.concat(F.lit(" "), F.regexp_replace(out, NOT_WORD, "  "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} ".replace(" ", "  ")[1:-1]), F.lit(f" {new} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the fixed texts."""
    return spark.createDataFrame(fixed_texts(), "license_id string, text string")


def fixed_texts() -> list[tuple[str, str]]:
    """Notices, SPDX lines, and whole licences with and without their title line."""
    lines = [(i, f"SPDX-License-Identifier: {i}") for i in sorted({*SPDX, *[i for i, *_ in TEXTS]})]
    return [*NOTICES, *lines, *HEADERS, *[(i, f"{title}\n\n{body}") for i, title, body in TEXTS if title], *[(i, body) for i, _, body in TEXTS]]


def digests(known: DataFrame) -> DataFrame:
    """(digest, license_id), one row per digest; texts that say nothing are left out, ties go to the first id."""
    form = known.where("license_id is not null").select("license_id", canonical(F.col("text")).alias("form")).where("form != ''")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_license, line_licenses, n_license_lines), one row per distinct id, a null id among them.

    text_license is the licence that the whole text is, or null; line_licenses the sorted distinct licences that lines of
    it are, joined by a comma, empty if none. Null, empty and blank texts match nothing. Rows of one id count together.
    The known digests are broadcast only up to ``MAX_BROADCAST`` of them, else the join is shuffled.
    """
    lookup = digests(known)
    if lookup.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        lookup = F.broadcast(lookup)
    lines = F.transform(F.split(F.col(text_col).cast("string"), "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit")))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.col(text_col).cast("string").alias("unit")))
    units = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(F.concat(whole, F.coalesce(lines, F.array()))).alias("u"))
    found = units.select("doc_id", "u.whole", F.sha2(canonical(F.col("u.unit")), 256).alias("digest")).join(lookup, "digest", "left")
    # a document of one line is that line too
    by_line = F.when(~F.col("whole"), F.col("license_id"))
    return found.groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("text_license"),
        F.array_join(F.sort_array(F.collect_set(by_line)), ",").alias("line_licenses"),
        F.count(by_line).alias("n_license_lines"),
    )


def sql() -> str:
    """The same over the tables of DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"' ' || regexp_replace(regexp_replace(lower({column}), {quote(COPYRIGHT_LINE)}, '', 'g'), {quote(NOT_WORD)}, ' ', 'g') || ' '"
        out = f"replace({out}, ' ', '  ')"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quote(' ' + old.replace(' ', '  ') + ' ')}, {quote(' ' + new.replace(' ', '  ') + ' ')})"
        return f"trim(replace(replace({out}, '   ', ' '), '  ', ' '))"

    rows = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in fixed_texts())
    return f"""
with known as (select sha256({form("t")}) as digest, min(i) as license_id from (values {rows}) v(i, t) group by 1),
units as (select doc_id, true as whole, text as unit from documents
          union all select doc_id, false, unnest(string_split(text, chr(10))) from documents),
found as (select u.doc_id, u.whole, k.license_id from units u left join known k on sha256({form("u.unit")}) = k.digest)
select doc_id, min(license_id) filter (whole) as text_license,
       coalesce(string_agg(distinct license_id, ',' order by license_id) filter (not whole and license_id is not null), '') as line_licenses,
       count(license_id) filter (not whole) as n_license_lines
from found group by doc_id"""

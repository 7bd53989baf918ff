import textwrap

from pyspark.sql import functions as F

from tallyfield.llm import license_scan as ls
from tallyfield.llm.license_texts import TEXTS


def test_whole_texts_lines_and_spellings(spark):
    title, body = next(x[1:] for x in TEXTS if x[0] == "MIT")
    mit = f"{title}\n\nCopyright (c) <year> <copyright holders>\n\n{body}"
    rows = [
        (1, mit.replace("Copyright (c) <year> <copyright holders>", "Copyright (c) 2001 Somebody\n(C) 2002 Another").upper()),
        (2, "words\n  released under the M.I.T... no\nReleased under the MIT Licence!\nmore"),
        (3, "Licensed under the Apache License Version 2.0"),
        (4, None), (5, ""), (6, " \n\n"), (7, "Copyright 2020 X"), (8, mit + " and more"),
        (9, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nlicensed under cc by nc 4.0"), (9, "Licensed under CC BY-NC 4.0."), (None, "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(*x, "d") for x in rows], "doc_id long, text string, digest string")
    got = {r.doc_id: (r.text_license, r.line_licenses, r.n_license_lines) for r in ls.scan(df, ls.known_licenses(spark)).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, "MIT", 1) and got[3] == ("Apache-2.0", "Apache-2.0", 1)
    assert all(got[i] == (None, "", 0) for i in (4, 5, 6, 7)) and got[8][0] is None
    assert got[9] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0,MIT", 4) and got[None] == ("MIT", "MIT", 1)
    assert ls.scan(df.limit(0), ls.known_licenses(spark)).count() == 0
    assert ls.scan(df, ls.known_licenses(spark).limit(0)).where("n_license_lines > 0").count() == 0


def test_every_text_in_any_wrapping(spark):
    """Re-wrapped at 40 columns a line may begin with "copyright notice"; titles and notices may be there or not."""
    rows, want = [], {}
    for i, (name, title, body) in enumerate(TEXTS):
        for j, text in enumerate((body, textwrap.fill(body, 40), f"{title}\nCopyright (c) 2019 A. Person. All rights reserved.\n\n{textwrap.fill(body, 60)}", f"Copyright 2020-2021 X\nAll rights reserved.\n{body.lower()}")):
            rows.append((10 * i + j, text))
            want[10 * i + j] = name
    rows.append((9000, "x. " * 2_000_000))
    got = {r.doc_id: r.text_license for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string"), ls.known_licenses(spark)).collect()}
    assert got == want | {9000: None}
    isc = next(b for i, _, b in TEXTS if i == "ISC")
    assert any(x.startswith("copyright notice") for w in range(40, 90) for x in textwrap.wrap(isc, w))


def test_equal_spellings_side_by_side(spark):
    df = spark.createDataFrame([("licence licence sub licence  Licence. SUB-LICENCE",), ("copyright holder",), ("copyright 2020",)], "t string")
    got = [r[0] for r in df.select(ls.canonical(F.col("t"))).collect()]
    assert got == ["license license sublicense license sublicense", "copyright holder", ""]


def test_main_path_is_native(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = ls.scan(df, ls.known_licenses(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))

import random

from pyspark.sql import functions as F

from tallyfield.operators.paging import KeysetTable
from tallyfield.session import scratch


def table(spark, rows, size):
    df = spark.createDataFrame(rows, "creation long, id long, part_of string")
    return KeysetTable.write(df, F.col("creation"), F.col("id"), scratch(spark, "pages"), size)


def walk(pages, n):
    after, out = None, []
    while True:
        page = [tuple(r) for r in pages.page(after, n).orderBy(F.desc("k1"), F.desc("k2")).collect()]
        if not page:
            return out
        out.append(page)
        after = page[-1][-2:]


def test_pages_joined_are_the_whole_order(spark):
    r = random.Random(4)
    rows = [(r.randint(0, 40), i, "x") for i in range(230)] + [(None, 1000, "y"), (None, None, "z")]
    pages = walk(table(spark, rows, 40), 50)
    flat = [x[:3] for page in pages for x in page]
    low = -(1 << 63)
    assert flat == sorted(rows, key=lambda x: (x[0] if x[0] is not None else low, x[1] if x[1] is not None else low), reverse=True)
    assert [len(p) for p in pages] == [50] * 4 + [32]


def test_a_page_reads_few_parts(spark):
    pages = table(spark, [(i // 3, i, "x") for i in range(3000)], 200)
    deep = pages.page((500, 1501), 25)
    assert [r.id for r in deep.orderBy(F.desc("k1"), F.desc("k2")).collect()] == list(range(1500, 1475, -1))
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "LessThanOrEqual(k1,500)" in plan
    everything = spark.read.parquet(f"{pages.path}/rows").select("part").distinct().count()
    assert everything >= 10 and len(pages._parts((500, 1501), 25)) <= 2


def test_limits_and_an_empty_table(spark):
    assert table(spark, [], 10).page().collect() == []
    few = table(spark, [(1, i, "x") for i in range(150)], 1000)
    assert few.page(n=0).count() == 1 and few.page(n=1000).count() == 100 and few.page((1, 0)).count() == 0

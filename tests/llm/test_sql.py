import duckdb
import pytest

from tallyfield.llm.registry import QUERIES, SQL
from tests.oracle import TABLES, compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.01") > 0


def test_shared_openings_equal_sql(spark, tmp_path):
    """Half of the conversations get one opening turn, a third of the rest another."""
    turns = duckdb.connect().execute("select * from '/root/testdata/sf0.01/conversations.parquet'").to_arrow_table()
    con = duckdb.connect()
    con.execute("create table t as select conv_id, turn, role, case when turn = 0 and conv_id % 2 = 0 then 'Hello' when turn = 0 and conv_id % 3 = 0 then 'Hi' else text end as text from turns")
    con.execute(f"copy t to '{tmp_path}/conversations.parquet' (format parquet)")
    for name in TABLES:
        if name != "conversations":
            (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.01/{name}.parquet")
    assert compare(spark, QUERIES["op6_chat_preference"], SQL["op6_chat_preference"], str(tmp_path)) == len(set(turns["conv_id"].to_pylist())) // 2

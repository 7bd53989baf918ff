import shutil

import duckdb
import pytest

import tallyfield.plans  # noqa: F401
from tallyfield.catalog import QUERIES, SQL
from tests.oracle import TABLES, compare


@pytest.fixture(scope="module")
def whole_milliseconds(tmp_path_factory):
    """Events at whole multiples of 40 ms: 8.04 and 16.08 seconds lie just below a millisecond as binary fractions."""
    path = tmp_path_factory.mktemp("clock")
    for t in TABLES:
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", path / f"{t}.parquet")
    rows = f"select i event_id, timestamp '2024-01-01' + to_microseconds(i * 40000) ts, user_id, event_type, value, props from '/root/testdata/sf0.001/events.parquet' e join range(1500) r(i) on e.event_id = i % 100"
    (path / "events.parquet").unlink()
    duckdb.connect().execute(f"copy ({rows}) to '{path}/events.parquet'")
    return path


def test_signed_evidence_on_whole_milliseconds(spark, whole_milliseconds):
    assert compare(spark, QUERIES["u2_signed_evidence"], SQL["u2_signed_evidence"], whole_milliseconds) > 0


def test_documents_of_events_on_whole_milliseconds(spark, whole_milliseconds):
    assert compare(spark, QUERIES["s2_p14_timeline_events"], SQL["s2_p14_timeline_events"], whole_milliseconds) > 0

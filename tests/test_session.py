import os
import subprocess
import sys

from tallyfield import session


def test_what_was_put_aside_is_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_MADE", [])
    df = session.stored(spark.range(3), "kept")
    folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder) and df.count() == 3
    assert session.release(spark) == 1 and not os.path.exists(folder)
    assert session.release(spark) == 0


def test_the_end_of_a_program_removes_it(tmp_path):
    code = f"""
from tallyfield.session import build, stored
spark = build("x", "local[1]", **{{"spark__checkpoint__dir": "file://{tmp_path}"}})
print(stored(spark.range(3), "kept").count())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("3"), out.stderr[-500:]
    assert os.listdir(tmp_path / "tallyfield") == []


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        session.bound_batches(spark)
        assert int(spark.conf.get(name).removesuffix("b")) == session.ARROW_BYTES
        spark.conf.set(name, "1000")
        session.bound_batches(spark)
        assert spark.conf.get(name).removesuffix("b") == "1000"
    finally:
        spark.conf.set(name, before)

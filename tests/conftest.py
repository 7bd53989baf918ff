import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest

from tallyfield.session import build


@pytest.fixture(scope="session")
def spark():
    return build("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="4g")

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from cinderlog.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "cinderlog-llm-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

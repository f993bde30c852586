import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowkeel.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("flowkeel-tests", cores=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("FLOWKEEL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def flows(spark, sf_dir):
    from flowkeel.sources import tables

    return tables.flows_view(spark, sf_dir).cache()

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fieldlens.session import local_session

    session = local_session(8, "fieldlens-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from fieldlens.plans.tables import Tables

    return Tables(spark, SF)

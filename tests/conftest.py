import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")  # many workers share the cores
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rollbook.plans.adapters import Tables  # noqa: E402
from rollbook.runtime import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("8", app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def t(spark):
    return Tables(spark, SMALL)

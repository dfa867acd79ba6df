"""Puts the repository on the path of the tests and of the Python workers that they start."""

import os
import sys

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

import pytest  # noqa: E402

from reelwright.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(4, 4, **{"spark.driver.memory": "4g"})
    yield s
    s.stop()

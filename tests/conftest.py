import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from clickloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def split_keys(spark):
    """Limits so low that nothing is broadcast by size and common keys count as hot."""
    spark.conf.set("spark.clickloom.broadcastRows", "0")
    spark.conf.set("spark.clickloom.hotRows", "3")
    yield
    spark.conf.unset("spark.clickloom.broadcastRows")
    spark.conf.unset("spark.clickloom.hotRows")


@pytest.fixture
def clicks(spark):
    """Build a small log from (user, seconds) pairs."""

    def build(pairs, user="u"):
        rows = [(i, u, t, 0) for i, (u, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, "instance_id long, user_id string, context_timestamp long, day_idx int")

    return build

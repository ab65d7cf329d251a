import datetime as dt
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.schema import BARS  # noqa: E402
from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def bar_rows(symbol, closes, start=dt.date(2023, 1, 1)):
    return [
        (start + dt.timedelta(days=i), symbol, c, c * 1.01, c * 0.98, c, 1000 + i)
        for i, c in enumerate(closes)
    ]


def random_walk(seed, n, start=100.0):
    steps = np.random.default_rng(seed).normal(0, 0.02, n)
    return [float(x) for x in start * np.exp(np.cumsum(steps))]


@pytest.fixture
def make_panel(spark):
    def make(series, start=dt.date(2023, 1, 1)):
        rows = [r for s, closes in series.items() for r in bar_rows(s, closes, start)]
        return spark.createDataFrame(rows, BARS)

    return make

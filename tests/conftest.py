from __future__ import annotations

import os
import sys
from datetime import date, timedelta

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DATA = os.environ.get("BARLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from barloom.session import builder

    s = (
        builder("tests").master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def walk(entities=("A", "B", "C"), days=300, seed=5):
    """Random-walk bars as rows; every 7th day is missing for entity B."""
    rng = np.random.default_rng(seed)
    rows = []
    for e in entities:
        close = 50.0
        for i in range(days):
            open_ = close * (1 + rng.normal(0, 0.005))
            close = open_ * (1 + rng.normal(0, 0.02))
            high, low = max(open_, close) * (1 + rng.random() * 0.01), min(open_, close) * (1 - rng.random() * 0.01)
            if e == "B" and i % 7 == 3:
                continue
            rows.append((e, date(2020, 1, 1) + timedelta(days=i), open_, high, low, close, float(rng.integers(0, 50)), 1.0))
    return rows


BAR = "entity string, date date, open double, high double, low double, close double, volume double, amount double"


@pytest.fixture(scope="session")
def bars(spark):
    return spark.createDataFrame(walk(), BAR)


def flat_bar(entity, day, close, volume=1.0):
    return (entity, date(2021, 1, 1) + timedelta(days=day), close, close, close, close, volume, 0.0)

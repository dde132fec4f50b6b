import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfcast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_panel(spark):
    """Build a panel from {(store, item): [sales, ...]}, one row per day from 2022-01-01."""

    def build(series, start=dt.date(2022, 1, 1), kind="bigint"):
        rows = [
            (start + dt.timedelta(days=i), store, item, value)
            for (store, item), values in series.items()
            for i, value in enumerate(values)
        ]
        return spark.createDataFrame(rows, f"date date, store int, item int, sales {kind}")

    return build

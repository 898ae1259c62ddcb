import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fluxgauge.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        settings={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hours():
    """``hours(spark, values, site)``: an hourly table from a list of values."""
    import datetime as dt

    def build(session, values, site="A", start=dt.datetime(2024, 1, 1)):
        rows = [(site, start + dt.timedelta(hours=i), v) for i, v in enumerate(map(float, values))]
        return session.createDataFrame(rows, "site string, timestamp timestamp_ntz, total_gbps double")

    return build


def at_last(df, *columns):
    """The given columns of the newest row."""
    return df.orderBy(df.timestamp.desc()).select(*columns).first()

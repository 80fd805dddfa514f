import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidecast.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def day(text, k=0):
    return date.fromisoformat(text) + timedelta(days=k)


def series(spark, start, values, name="a", col="revenue"):
    """A daily series from a list; ``...`` leaves the day out, None keeps it as NULL."""
    rows = [(name, day(start, i), None if v is None else float(v)) for i, v in enumerate(values) if v is not ...]
    return spark.createDataFrame(rows, f"series_id STRING, ds DATE, {col} DOUBLE")


def column(df, name, by="ds"):
    return [r[name] for r in df.orderBy(by).select(name).collect()]

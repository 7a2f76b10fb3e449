import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelgraph.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "panelgraph-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.session.timeZone": "UTC",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """rows + DDL -> DataFrame."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)


def rows_by(df, *keys):
    out = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        assert key not in out, f"duplicate {key}"
        out[key if len(keys) > 1 else key[0]] = row
    return out

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scalefold import build_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        app="tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def noise():
    """Three series of different length, as {name: values}."""
    import numpy as np

    rng = np.random.default_rng(7)
    return {
        "long": rng.normal(size=5000),
        "walk": np.cumsum(rng.normal(size=3001)),
        "short": rng.lognormal(size=333),
    }


@pytest.fixture(scope="session")
def samples(spark, noise):
    rows = [(name, i, float(v)) for name, values in noise.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, idx bigint, value double").repartition(5)
    return df.cache()


def by_series(df, order="idx", value="value"):
    """{series_id: list of values in order}"""
    out = {}
    for row in sorted(df.select("series_id", order, value).collect(), key=lambda r: (r[0], r[1])):
        out.setdefault(row[0], []).append(row[2])
    return out

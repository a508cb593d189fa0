import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from speciframe.session import build_session

    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def points(spark):
    """300 vectors of 6 dimensions around 5 centres, with two exact copies."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(0, 4, (5, 6))
    rows = []
    for i in range(300):
        label = int(rng.integers(0, 5)) if i % 3 else 0
        rows.append((i, [float(x) for x in centres[label] + rng.normal(0, 1, 6)], label))
    rows[7] = (7, rows[5][1], rows[7][2])
    return spark.createDataFrame(
        rows, "id bigint, v array<double>, label int"
    ).repartition(5)

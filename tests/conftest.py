import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from clicklens.session import local_session

    session = local_session(
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def model(spark):
    from clicklens.functions.plan import local_rows
    from clicklens.operators.model import Head, Model
    from clicklens.schemas import WEIGHTS

    rows = [
        ("ad", "finance", 0.1),
        ("ad", "travel", -0.1),
        ("domain", "news.example", 0.05),
        ("domain", "tech.example", -0.05),
        ("context", "personal_finance", 0.08),
        ("context", "gaming", -0.08),
    ]
    head = Head("unit", -3.8918202981106265, 0.02)
    return Model(head, local_rows(spark, rows, WEIGHTS), len(rows))

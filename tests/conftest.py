import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import build

    scratch = tmp_path_factory.mktemp("scratch")
    more = {"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(scratch), "spark.sql.warehouse.dir": str(scratch / "warehouse")}
    session = build("local[4]", time_zone="UTC", **more)
    yield session
    session.stop()


@pytest.fixture
def shanghai(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

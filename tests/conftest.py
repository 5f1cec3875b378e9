import os
import tempfile

import pytest

from retort.session import get_session


def local_session():
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "retort-tests",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="retort-tests-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return local_session()

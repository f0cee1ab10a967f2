import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leadloom import session


@pytest.fixture(scope="session")
def spark():
    spark = session.build(
        "leadloom-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def apply(spark):
    """Evaluate a column function on one value."""

    def run(function, *values, kind="string"):
        from pyspark.sql import functions as F

        names = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {kind}" for n in names))
        return df.select(function(*[F.col(n) for n in names]).alias("r")).first()["r"]

    return run

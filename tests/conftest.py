import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailwatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def long(spark):
    """Builds a (feature, value) table from keyword lists."""

    def build(**features):
        rows = [(f, None if v is None else float(v)) for f, values in features.items() for v in values]
        from mailwatch.functions.numeric import nan_to_null
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "feature string, value double")
        return df.select("feature", nan_to_null(F.col("value")).alias("value"))

    return build

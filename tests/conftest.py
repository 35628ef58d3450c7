import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from laborlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("4", "tests", shared=str(tmp_path_factory.mktemp("shared")))
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def one(spark):
    """Evaluate a column over one row of named values."""

    def run(make, ddl="x string", *values):
        df = spark.createDataFrame([tuple(values)], ddl)
        return df.select(make.alias("out")).first()["out"]

    return run

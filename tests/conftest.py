import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from voxlake.session import get_spark

    s = get_spark("local[4]", 4, **{"spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """Rows to a DataFrame with a schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)

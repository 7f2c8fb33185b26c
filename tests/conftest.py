import os
import sys
import tempfile

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

@pytest.fixture(scope="session")
def spark():
    from martflow.session import get_session
    ckpt = tempfile.mkdtemp(prefix="martflow-test-ckpt-")
    s = get_session("local[4]", app="martflow-tests", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def pipe(spark):
    from helpers import SF_SMALL

    from martflow.plans.pipeline import Pipeline
    return Pipeline.fixture(spark, SF_SMALL)

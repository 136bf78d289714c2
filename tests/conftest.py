import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """Partitions aren't joined together, so small tables still spread over several tasks."""
    from ledgerloom.session import local_session

    s = local_session("tests", "4", partitions=5, **{"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"
